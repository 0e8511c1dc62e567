"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import first_of


def human_size(n: Column) -> Column:
    """One decimal, steps of 1024."""
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = [(n < 1024 ** (k + 1), F.format_string(f"%.1f {u}", F.bround(n / float(1024**k), 1))) for k, u in enumerate(units)]
    return first_of(cases, F.format_string("%.1f PB", F.bround(n / float(1024**5), 1)))


def duration(seconds: Column) -> Column:
    """Days, hours and minutes, or minutes and seconds below an hour."""
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %ds", m, F.pmod(s, F.lit(60))))


def clock(seconds: Column) -> Column:
    """hh:mm:ss, or mm:ss below an hour; never negative."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the rate so far."""
    left = F.greatest(F.lit(0), total - done) / F.greatest(done / F.greatest(elapsed, F.lit(1e-6)), F.lit(1e-6))
    return F.when((done <= 0) | (total <= 0), "--:--").otherwise(clock(left))


def percent(c: Column) -> Column:
    return F.bround(c * 100).cast("int")


def confidence_bucket(c: Column) -> Column:
    p = F.round(c * 100)
    return F.when(p >= 80, "high").when(p >= 50, "mid").otherwise("low")
