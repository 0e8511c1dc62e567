"""Dates found in strings, as six digits year, month, day; ``date_unknown`` if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import let

UNKNOWN = "date_unknown"
#: Months and days, two digits first.
_MM, _DD = r"(1[0-2]|0?[1-9])", r"(3[01]|[12]\d|0?[1-9])"
_M2, _D2 = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
_YYYY = r"(20\d{2}|19\d{2})"
#: Patterns in the order in which they are tried, with the groups of year, month and day (0: the first).
PATTERNS = [
    (rf"(?U){_YYYY}[.\-/년\s]+{_MM}[.\-/월\s]+{_DD}", 1, 2, 3),
    (rf"{_YYYY}{_M2}{_D2}(?!\d)", 1, 2, 3),
    (rf"(?U)\b(\d{{2}})[.\-/\s]+{_MM}[.\-/\s]+{_DD}\b", 1, 2, 3),
    (rf"(?U)\b{_DD}[.\-/\s]+{_MM}[.\-/\s]+{_YYYY}\b", 3, 2, 1),
    (rf"(?<!\d)(\d{{2}}){_M2}{_D2}(?!\d)", 1, 2, 3),
    (rf"(?U){_YYYY}[.\-/년\s]+{_MM}(?:[.\-/월\s]|$)", 1, 2, 0),
    (rf"{_YYYY}{_M2}(?!\d)", 1, 2, 0),
    (rf"(?U)\b(\d{{2}})[.\-/\s]+{_MM}\b", 1, 2, 0),
]
#: What every match of one of these holds, so that a text without it has no date.
NEEDED = r"(?U)(?:19|20)\d{2}(?:[.\-/년\s]|[01]\d)|[.\-/\s](?:19|20)\d{2}|\d{2}[.\-/\s]+\d|\d{2}[01]\d[0-3]\d"
SUFFIX = r"_(\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))$"


def full_year(yy: Column) -> Column:
    """Two digits up to 39 are of this century."""
    return F.when(F.length(yy) == 4, yy).when(yy <= "39", F.concat(F.lit("20"), yy)).otherwise(F.concat(F.lit("19"), yy))


def six_digits(year: Column, month: Column, day: Column) -> Column:
    """yymmdd if the day is in the calendar, else null."""
    text = F.concat(full_year(year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    date = F.try_to_date(text, "yyyyMMdd") if hasattr(F, "try_to_date") else F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    return F.date_format(date, "yyMMdd")


def _found(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    """The first match of the pattern as a date, or null."""
    group = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(c.rlike(pattern), six_digits(group(y), group(m), group(d) if d else F.lit("01")))


def infer_date(c: Column) -> Column:
    """The first pattern in order whose first match is in the calendar decides, wherever it stands."""
    return let(F.coalesce(c, F.lit("")), lambda s: F.when(s.rlike(NEEDED), F.coalesce(*(_found(s, *p) for p in PATTERNS), F.lit(UNKNOWN))).otherwise(UNKNOWN))


def given_date(c: Column, compat: bool = True) -> Column:
    """A date that an enricher gave.  ``compat``: YYYYMM is tried before YYMMDD, so 200303 is March 2003."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?U)[.\-/년월일\s]", "")
    tries = [(rf"^((?:19|20)\d{{2}}){_M2}{_D2}$", 1, 2, 3), (rf"^((?:19|20)\d{{2}}){_M2}$", 1, 2, 0), (rf"^(\d{{2}}){_M2}{_D2}$", 1, 2, 3), (rf"^(\d{{2}}){_M2}$", 1, 2, 0)]
    if not compat:
        tries[1], tries[2] = tries[2], tries[1]
    return let(bare, lambda s: F.when((s == "") | (F.lower(s) == UNKNOWN), UNKNOWN).otherwise(F.coalesce(*(_found(s, *t) for t in tries), infer_date(c))))


def suffix_date(stem: Column) -> Column:
    """Six digits at the end that look like a date, or empty."""
    return F.regexp_extract(stem, SUFFIX, 1)


def suffix_is_valid(stem: Column) -> Column:
    """The same, if in the calendar."""
    s = suffix_date(stem)
    return (s != "") & six_digits(F.substring(s, 1, 2), F.substring(s, 3, 2), F.substring(s, 5, 2)).isNotNull()


def year_of(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{6}$"), full_year(F.substring(c, 1, 2)).cast("int"))


def document_date(stem: Column, file_name: Column, given: Column, text: Column) -> Column:
    """Suffix of the name; else the given date, unless more than five years off the name's; else what name and text show."""
    body = infer_date(F.concat(file_name, F.lit("\n"), F.coalesce(text, F.lit(""))))

    def chosen(d: Column) -> Column:
        far = F.coalesce(F.abs(year_of(d["told"]) - year_of(d["named"])) > 5, F.lit(False))
        return F.when(far, d["named"]).otherwise(d["told"])

    of_given = let(F.struct(infer_date(file_name).alias("named"), given_date(given).alias("told")), chosen)
    return F.when(suffix_date(stem) != "", suffix_date(stem)).when(F.trim(F.coalesce(given, F.lit(""))) != "", of_given).otherwise(body)
