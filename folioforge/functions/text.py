"""String columns: cleaning, sentence tests and scores.  Every function is Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL, RulePack

SENTENCE_END = r"(?<=[.!?。！？])\s+|\n+"
#: Fixed value: characters that a file name can't hold.
FORBIDDEN = r'[\\/:*?"<>|]'
#: Fixed value: prefix of names that begin with a date.
DATED = r"^\d{6,8}[_\-\s\[\(]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White-space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars_of(c: Column, kind: str) -> Column:
    """How many characters are of a class, which is written as one: what the text loses without them."""
    return F.length(c) - F.length(F.regexp_replace(c, f"(?U){kind}+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_of(cases: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def sanitize(c: Column) -> Column:
    """A component of a file name: no forbidden characters, single spaces, no dots or underscores at the ends."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), FORBIDDEN + "+", " ")
    return F.btrim(collapse(spaced), F.lit("._"))


def valid_file_name(c: Column) -> Column:
    return (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0) & ~F.coalesce(c, F.lit("")).rlike(FORBIDDEN)


def strip_status_tag(c: Column) -> Column:
    """Without the bracketed marks at its front."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*(\[[^\]]*\]\s*)+", ""))


def is_boilerplate(c: Column, rules: RulePack = NEUTRAL) -> Column:
    """Fewer than eight characters, or one of the patterns that say nothing; so null is."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(s) < 8) | any_of(s.rlike(p) for p in rules.boilerplate)


def is_garbled(c: Column) -> Column:
    """Of three words or more, 40 % without a vowel or 70 % of three letters.

    A word is a run of three letters or more; each kind is counted by a pattern,
    without an array of the words.
    """
    mute = count_of(c, "(?<![A-Za-z])[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{3,}(?![A-Za-z])")
    short = count_of(c, "(?<![A-Za-z])[A-Za-z]{3}(?![A-Za-z])")
    return let(count_of(c, "[A-Za-z]{3,}"), lambda n: (n >= 3) & ((mute / n >= 0.4) | (short / n >= 0.7)))


def is_file_name_phrase(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (s != "") & (s.rlike(DATED) | (s.rlike(r"\[[^\]]{2,30}\]") & s.rlike(r"\d{6,8}")))


def is_noise(c: Column) -> Column:
    """Runs of signs, too few letters, a fifth of signs, or half of the tokens of one or two characters."""

    def test(s: Column) -> Column:
        signs = chars_of(s, r"[^A-Za-z가-힣0-9\s.,;:!?()\-]")
        return (
            (s == "")
            | s.rlike(r"(?U)[\|`~^_=]{2,}|[^\w\s가-힣A-Za-z.,;:!?()\-]{4,}")
            | (chars_of(s, "[A-Za-z가-힣0-9]") < 10)
            | (signs / F.greatest(F.lit(1), F.length(s)) >= 0.2)
            | let(count_of(s, "[A-Za-z가-힣0-9]+"), lambda n: (n > 0) & (count_of(s, "(?<![A-Za-z가-힣0-9])[A-Za-z가-힣0-9]{1,2}(?![A-Za-z가-힣0-9])") / n >= 0.5))
        )

    return let(F.trim(F.coalesce(c, F.lit(""))), test)


def source_quality(c: Column) -> Column:
    """Share of plain characters, less a penalty for broken words; 0 to 1."""

    def score(s: Column) -> Column:
        valid = chars_of(s, r"[A-Za-z가-힣0-9\s.,;:!?()\-]")
        hits = count_of(s, r"(?U)\b[a-z]{1,2}\b|[A-Za-z]{8,}[0-9]{2,}|[0-9]{5,}")
        share = valid / F.greatest(F.lit(1), F.length(s)) - F.least(F.lit(0.5), hits / 40.0)
        return F.when(s == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))

    return let(collapse(c), score)


def sentences(c: Column) -> Column:
    """Array of the sentences of the collapsed text, empty ones left out."""
    return F.filter(F.split(collapse(c), SENTENCE_END), lambda s: F.trim(s) != "")


def clean_for_summary(c: Column, rules: RulePack = NEUTRAL) -> Column:
    keep = F.filter(sentences(c), lambda s: ~is_boilerplate(s, rules) & ~is_garbled(s) & ~is_noise(s))
    return F.array_join(keep, " ")


def summary_seed(c: Column) -> Column:
    """A given summary without file-name prefix, bracketed marks and (year.month)."""
    s = F.regexp_replace(collapse(c), DATED, "")
    s = F.trim(F.regexp_replace(s, r"\[[^\]]{0,40}\]", ""))
    return collapse(F.regexp_replace(s, r"\(\d{4}[.\-/]\d{1,2}(?:[.\-/]\d{1,2})?\)", ""))


def has_hangul(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[가-힣]")


def summary_acceptable(c: Column, prefer_hangul: Column, rules: RulePack = NEUTRAL) -> Column:
    """Eight characters or more, no file name, noise, broken words, empty phrase or long number, and Hangul where that is preferred; null is not."""

    def test(s: Column) -> Column:
        bad = is_file_name_phrase(s) | is_noise(s) | is_garbled(s) | s.rlike(rules.low_value_summary) | s.rlike(r"(?U)\b\d{4,}\b|\+\d{1,3}\s?\d")
        return (F.length(s) >= 8) & ~bad & (~prefer_hangul | has_hangul(s))

    return let(F.rtrim(collapse(c), F.lit(".")), test)


def ended(c: Column, limit: int) -> Column:
    """One full stop at the end, within ``limit`` characters."""
    return let(F.rtrim(c, F.lit(" .!?。！？,;:")), lambda s: F.concat(F.when(F.length(s) >= limit, F.rtrim(F.substring(s, 1, limit - 1))).otherwise(s), F.lit(".")))


def keyword_token(c: Column, rules: RulePack = NEUTRAL) -> Column:
    """A keyword in normal form, or empty if it is of no use."""

    def test(t: Column) -> Column:
        low = F.lower(t)
        names = let(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*rules.company_words)))
        bad = (chars_of(t, "[A-Za-z]") < 3) | (F.size(F.split(t, " ")) > 6) | low.isin(*rules.low_value_words, *rules.company_words) | t.rlike(rules.keyword_noise) | names
        return F.when(bad, "").otherwise(t)

    return let(sanitize(c), test)


def keyword_useful(c: Column, rules: RulePack = NEUTRAL) -> Column:
    k = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(k)
    plain = (chars_of(k, "[A-Za-z]") >= 4) & ~low.rlike(rules.keyword_useful)
    return (k != "") & ~low.isin(*rules.company_words) & ~low.rlike(r"\b(?:" + "|".join(rules.low_value_words) + r")\b") & ~plain


def keyword_supported(keyword: Column, text: Column) -> Column:
    """The text holds the keyword, or half of its parts of four letters or more."""
    k, t = collapse(F.lower(keyword)), F.lower(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(k, " "), lambda p: F.length(p) >= 4)
    hits = F.size(F.filter(parts, lambda p: F.contains(t, p)))
    return (k != "") & (t != "") & (F.contains(t, k) | ((F.size(parts) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)))))


def squeezed_title(c: Column, limit: int, rules: RulePack = NEUTRAL) -> Column:
    """Letters alone, three or more of a kind as two, cut."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{rules.letters}]", ""), r"(.)\1{2,}", "$1$1")
    return F.when(s == "", rules.default_title).otherwise(F.substring(s, 1, limit))


def is_vague(c: Column, rules: RulePack = NEUTRAL) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return (s == "") | s.isin(*rules.vague_titles)


def is_doc_type_word(c: Column, rules: RulePack = NEUTRAL) -> Column:
    """The text is a document type and nothing else, but for blanks and case; null is empty."""
    squeezed = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    return squeezed.isin(*("".join(w.split()).lower() for w in rules.doc_types))


def first_contained(words: Iterable[str], c: Column) -> Column:
    """The first of ``words`` that the text holds in any case; empty if none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_of(((F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words), F.lit(""))


def mapped_title(c: Column, rules: RulePack = NEUTRAL) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_of(((F.contains(low, F.lit(k.lower())), squeezed_title(F.lit(v), 10, rules)) for k, v in rules.titles), F.lit(""))


def title_from_words(c: Column, limit: int = 10, rules: RulePack = NEUTRAL) -> Column:
    """Whole words put together while they fit; the first word cut if none does."""
    words = F.filter(F.split(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)[^{rules.letters}\s]", "")), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(a: Column, w: Column) -> Column:
        fits = ~a["done"] & (F.length(a["s"]) + F.length(w) <= limit)
        return F.struct(F.when(fits, F.concat(a["s"], w)).otherwise(a["s"]).alias("s"), (~fits).alias("done"))

    made = F.aggregate(words, start, step, lambda a: a["s"])
    return F.when(F.size(words) == 0, "").when(made != "", made).otherwise(F.substring(F.get(words, F.lit(0)), 1, limit))


def structured_summary(doc_type: Column, case_name: Column, institution: Column, keyword: Column, limit: int = 80, rules: RulePack = NEUTRAL) -> Column:
    """A summary from the fields, for documents whose text gives none."""
    word = F.when(keyword_useful(keyword, rules), keyword).otherwise("")
    context = F.coalesce(blank_to_null(case_name), blank_to_null(institution))
    parts = F.filter(F.array(case_name, institution, doc_type, word), lambda p: F.coalesce(p, F.lit("")) != "")
    text = (
        F.when(F.size(parts) == 0, rules.default_title)
        .when((F.coalesce(doc_type, F.lit("")) != "") & context.isNotNull(), F.concat(context, F.lit(" "), doc_type, F.when(word != "", F.concat(F.lit(" - "), word)).otherwise("")))
        .otherwise(F.concat(F.array_join(parts, " "), F.lit(" related document")))
    )
    return let(collapse(text), lambda t: ended(F.when(F.length(t) >= limit, F.rtrim(F.substring(t, 1, limit - 1))).otherwise(t), limit + 1))


def strip_html(c: Column) -> Column:
    """Visible text: no styles, scripts and tags; entities replaced one after the other."""
    s = F.coalesce(c, F.lit(""))
    for tag in ("style", "script"):
        s = F.regexp_replace(s, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        s = F.replace(s, F.lit(a), F.lit(b))
    return collapse(s)


def escape_html(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def masked_key(c: Column) -> Column:
    """First six and last four characters of a long key."""
    return F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 6), F.lit("..."), F.right(c, F.lit(4)))).otherwise(F.lit("***"))


def yes_no(c: Column, rules: RulePack = NEUTRAL) -> Column:
    return F.when(c, rules.yes).otherwise(rules.no)
