"""Path columns: parts, prefixes, ancestors and natural order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL, RulePack
from folioforge.functions.text import any_of, blank_to_null, collapse, sanitize, strip_status_tag


def file_name(c: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def extension(c: Column) -> Column:
    """Lower-case suffix with its dot, or empty; a dot that begins or ends a name makes none."""
    return F.lower(F.regexp_extract(file_name(c), r"[^.](\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"([^.])\.[^.]+$", "$1")


def folder(c: Column) -> Column:
    """What precedes the last slash, or empty."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"[^/]*$", ""), "/$", "")


def folder_parts(c: Column) -> Column:
    return F.filter(F.split(folder(c), "/"), lambda p: p != "")


def ancestors(c: Column) -> Column:
    """Every folder above a path in ``c`` (a folder path), itself included, shortest first."""
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def provider_folder(c: Column) -> Column:
    """Folder path without a provider's drive prefix."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^/drives/[^/]+/root:", "")


def site_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(https?://[^/]+(?:/sites/[^/?#]+)?)", 1)


def share_token(url: Column) -> Column:
    """URL-safe base64 without padding and in one line, as share links want it; Spark breaks its own after 76 characters."""
    return F.concat(F.lit("u!"), F.rtrim(F.translate(F.base64(url.cast("binary")), "+/\r\n", "-_"), F.lit("=")))


def natural_key(c: Column, digits: int = 20) -> Column:
    """A string that sorts digit runs as numbers and the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, digits, "0")).otherwise(r)), "")


def in_rename_scope(path: Column, rules: RulePack = NEUTRAL) -> Column:
    """No folder of the path is of the excluded kind."""
    return ~F.exists(folder_parts(path), lambda p: strip_status_tag(p).rlike(rules.excluded_folder))


def under_any(path: Column, prefixes: Iterable[str]) -> Column:
    """Equal to one of the folders or below it; without folders everything is."""
    given = [p.strip("/") for p in prefixes]
    return any_of((path == p) | path.startswith(p + "/") for p in given) if given else F.lit(True)


def in_rollback_scope(path: Column, folders: Iterable[str]) -> Column:
    """A folder of that name is part of the path or ends it; an empty one takes all."""
    given = list(folders)
    if not given or "" in given:
        return F.lit(True)
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return any_of(F.contains(p, F.lit(f"/{f.strip('/')}/")) | p.endswith("/" + f.strip("/")) for f in given)


def case_name(path: Column) -> Column:
    """Second folder, else the first."""
    parts = folder_parts(path)
    return sanitize(strip_status_tag(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit(""))))


def folder_hint(path: Column) -> Column:
    """The deepest folder from the third on that is not numbered and has two letters."""
    below = F.reverse(F.slice(F.concat(folder_parts(path), F.array().cast("array<string>")), 3, 1000))
    good = F.filter(F.transform(below, strip_status_tag), lambda p: ~p.rlike(r"^\s*\d+\s*[.\-]") & (F.regexp_count(sanitize(p), F.lit("[A-Za-z가-힣]")) >= 2))
    return F.coalesce(F.substring(sanitize(F.get(good, F.lit(0))), 1, 20), F.lit(""))


def revision_note(name: Column, rules: RulePack = NEUTRAL) -> Column:
    """The first revision mark in the order of the rules, without spaces; empty if none."""
    s = stem(name)
    marks = [blank_to_null(F.regexp_extract(s, p, 1)) for p in rules.revisions]
    return sanitize(F.regexp_replace(F.coalesce(*marks, F.lit("")), r"(?U)\s+", ""))


def existing_prefix(name: Column, project: Column, rules: RulePack = NEUTRAL) -> Column:
    """Struct ``prefix, tail``: a prefix that the name has already, else that of organisation and project."""
    s, org = stem(name), sanitize(F.lit(rules.org_name))
    parts = F.split(s, "_")
    has = (org != "") & (F.size(parts) >= 2) & (sanitize(F.get(parts, F.lit(0))) == org)
    made = F.array_join(F.filter(F.array(org, sanitize(project)), lambda p: p != ""), "_")
    kept = sanitize(F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    tail = F.trim(F.array_join(F.slice(parts, 3, 1000), "_"))
    return F.struct(F.when(has, kept).otherwise(made).alias("prefix"), F.when(has, tail).otherwise(s).alias("tail"))


def clean_tail(tail: Column) -> Column:
    """A title from what is left of a name: no generic words, no numbers, two letters at least."""
    t = sanitize(F.replace(F.coalesce(tail, F.lit("")), F.lit("_"), F.lit(" ")))
    t = F.regexp_replace(t, r"(?i)(?<![A-Za-z])(scan|copy|img|image|file|doc|page|final|draft|rev(?:ision)?|ver(?:sion)?|v)\d*(?![A-Za-z])", " ")
    t = F.btrim(collapse(F.regexp_replace(t, r"(?U)\b\d{2,8}\b", " ")), F.lit(" -_"))
    return F.when(F.regexp_count(t, F.lit("[A-Za-z가-힣]")) < 2, "").otherwise(F.substring(t, 1, 30))


def build_name(prefix: Column, title: Column, original: Column, date: Column, revision: Column, ext: Column, institution: Column, rules: RulePack = NEUTRAL) -> Column:
    """prefix_(institution)title_original_date_revision.ext, without the empty slots and an unknown date."""
    inst, shown = sanitize(institution), F.coalesce(blank_to_null(title), F.lit(rules.default_title))
    head = F.when((inst != "") & (inst != rules.org_name), F.concat(F.lit("("), inst, F.lit(")"), shown)).otherwise(shown)
    dated = F.when(F.coalesce(date, F.lit("")) != "date_unknown", date).otherwise("")
    slots = F.transform(F.array(prefix, head, original, dated, revision), sanitize)
    return F.concat(F.array_join(F.filter(slots, lambda s: s != ""), "_"), F.coalesce(ext, F.lit("")))
