"""Sentences and keywords: ranking within a document, and excerpts under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL, RulePack
from folioforge.functions import text as T


def _first_of_each(items: Column) -> Column:
    """Structs with ``k`` and ``s``, of equal keys the first, in their order: ``i, s``."""
    numbered = F.transform(F.filter(items, lambda x: x["k"] != ""), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["s"].alias("s")))
    once = T.let(F.array_sort(numbered), lambda a: F.filter(a, lambda x, n: (n == 0) | (F.get(a, n - 1)["k"] != x["k"])))
    return F.array_sort(F.transform(once, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))


def best_sentence(c: Column, target: int = 34, prefer_hangul: Column | None = None, rules: RulePack = NEUTRAL, cleaned: bool = False) -> Column:
    """The sentence with the best score; of equal scores the first; empty if there is none.

    Boilerplate and garbled sentences are out, and repeats by letters and
    digits.  Scores in order: domain words and preferred script, structure
    words, closeness to ``target`` characters, length up to 80.  ``cleaned``: the
    text comes from :func:`T.clean_for_summary`, so that its sentences, which split
    again where they did, need not be tested again.
    """
    prefer = F.lit(False) if prefer_hangul is None else prefer_hangul
    good = T.sentences(c) if cleaned else F.filter(T.sentences(c), lambda s: ~T.is_boilerplate(s, rules) & ~T.is_garbled(s))
    keyed = F.transform(good, lambda s: F.struct(s.alias("s"), F.regexp_replace(F.lower(s), "[^a-z0-9가-힣]+", "").alias("k")))
    once = _first_of_each(keyed)

    def scored(x: Column) -> Column:
        s = x["s"]
        words = F.when(s.rlike(rules.summary_words), 2).otherwise(0) + F.when(prefer & T.has_hangul(s), 3).otherwise(0)
        return F.struct(words.alias("a"), F.when(s.rlike(rules.structure_words), 1).otherwise(0).alias("b"), F.greatest(F.lit(0), F.lit(40) - F.abs(F.length(s) - target)).alias("c"), F.least(F.length(s), F.lit(80)).alias("d"), (-x["i"]).alias("e"), s.alias("s"))

    return F.coalesce(F.array_max(F.transform(once, scored))["s"], F.lit(""))


def best_hangul_phrase(c: Column, target: int = 28, rules: RulePack = NEUTRAL) -> Column:
    """The core of the sentence with most Hangul near the target length; six syllables at least."""
    good = F.filter(T.sentences(c), lambda s: T.has_hangul(s) & ~T.is_boilerplate(s, rules) & ~T.is_noise(s))
    cores = F.transform(good, lambda s: F.trim(F.regexp_replace(s, r"(?U)[^가-힣A-Za-z0-9\s]", "")))
    scored = F.transform(cores, lambda s, i: F.struct((T.chars_of(s, "[가-힣]") + F.greatest(F.lit(0), F.lit(20) - F.abs(F.length(s) - target))).alias("n"), (-i).alias("i"), s.alias("s"), T.chars_of(s, "[가-힣]").alias("k")))
    return F.coalesce(F.array_max(F.filter(scored, lambda x: x["k"] >= 6))["s"], F.lit(""))


def excerpt(c: Column, limit: int = 8000) -> Column:
    """A text within ``limit`` characters whole; else its head and the best sentences of the rest under a budget.

    The head takes 60 %, 400 characters at least.  Sentences are taken in order
    of score; one that does not fit is passed over; the walk ends at 90 % of
    the budget.
    """
    head = max(400, int(limit * 0.6))
    budget = limit - head

    def clean(x: Column) -> Column:
        return (F.length(x) >= 12) & ~x.rlike(NEUTRAL.mail_words) & ~x.rlike(r"[\|`~^_=]{2,}") & (T.count_of(x, "[A-Za-z가-힣0-9]+") >= 4)

    def rank(x: Column) -> Column:
        s = x["s"]
        return F.struct((-F.when(s.rlike(NEUTRAL.summary_words), 3).otherwise(0)).alias("a"), (-F.greatest(F.lit(0), F.lit(45) - F.abs(F.length(s) - 34))).alias("b"), (-T.chars_of(s, "[A-Za-z가-힣0-9]")).alias("c"), x["i"].alias("i"), s.alias("s"))

    def take(a: Column, x: Column) -> Column:
        n = F.length(x["s"]) + 1
        ok = (a["used"] < budget * 0.9) & (a["used"] + n <= budget)
        return F.struct(F.when(ok, a["used"] + n).otherwise(a["used"]).alias("used"), F.when(ok, F.concat(a["parts"], F.array(x["s"]))).otherwise(a["parts"]).alias("parts"))

    def made(s: Column) -> Column:
        rest = F.split(F.substring(s, head + 1, 2147483647), T.SENTENCE_END)
        keyed = F.transform(F.filter(F.transform(rest, T.collapse), clean), lambda x: F.struct(x.alias("s"), F.regexp_replace(F.lower(x), "[^a-z0-9가-힣]+", "").alias("k")))
        ranked = F.array_sort(F.transform(_first_of_each(keyed), rank))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))
        parts = F.aggregate(ranked, start, take, lambda a: a["parts"])
        return F.when(F.length(s) <= limit, s).otherwise(F.concat_ws("\n...\n", F.substring(s, 1, head), T.blank_to_null(F.array_join(parts, "\n"))))

    return T.let(T.collapse(c), made)


def keyword(name: Column, text: Column, rules: RulePack = NEUTRAL, chars: int | None = 12000) -> Column:
    """The most telling phrase of name and text: domain words first, then count, then length, then place.

    Of the text the first ``chars`` characters; all of it if that is None.
    """
    given = F.coalesce(text, F.lit(""))
    source = F.regexp_replace(F.concat(name, F.lit("\n"), given if chars is None else F.substring(given, 1, chars)), r"(?i)PAGE\s+\d+", " ")
    found = F.transform(F.regexp_extract_all(source, F.lit(r"([A-Za-z][A-Za-z0-9\- ]{2,40})"), F.lit(1)), lambda t: T.keyword_token(t, rules))
    used = F.array_sort(F.filter(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] != ""))
    # equal tokens stand together now: a run's length is its count
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.struct(F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("l"), F.lit(0).alias("i"), F.lit("").alias("t")).alias("best"))

    def step(a: Column, x: Column) -> Column:
        again = a["t"] == x["t"]
        n, first = F.when(again, a["n"] + 1).otherwise(1), F.when(again, a["first"]).otherwise(x["i"])
        here = F.struct(F.when(x["t"].rlike(rules.keyword_positive), 2).otherwise(0).alias("p"), n.alias("n"), F.length(x["t"]).alias("l"), (-first).alias("i"), x["t"].alias("t"))
        return F.struct(x["t"].alias("t"), n.alias("n"), first.alias("first"), F.greatest(a["best"], here).alias("best"))

    return F.substring(T.sanitize(F.aggregate(used, start, step, lambda a: a["best"]["t"])), 1, 40)


def top_tokens(docs: DataFrame, k: int = 1, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = "([a-z]{4,})") -> DataFrame:
    """The k most frequent tokens of each document; ties by length, then alphabet.

    Counting is one aggregation by document and token; the ranking then keeps
    the best k in an aggregate, so a document's tokens are never sorted at once.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(1))).alias("token"))
    n = words.groupBy("id", "token").agg(F.count("*").alias("n"))
    if k == 1:
        order = F.struct("n", F.length("token"), F.col("token"))
        return n.groupBy("id").agg(F.max(order).alias("m")).select(F.col("id").alias(id_col), F.col("m.token").alias("token"), F.col("m.n").alias("n"))
    ranked = n.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), (-F.length("token")).alias("l"), "token", "n"))).alias("all"))
    return ranked.select(F.col("id").alias(id_col), F.posexplode(F.slice("all", 1, k)).alias("rank", "x")).select(id_col, (F.col("rank") + 1).alias("rank"), "x.token", "x.n")


def normal_summary(given: Column, text: Column, name: Column, limit: int = 80, least: int = 24, rules: RulePack = NEUTRAL) -> Column:
    """The first source that has a summary: given, best sentence, Hangul phrase, cleaned text, name; one sentence with a full stop."""
    end = r"(?<=[.!?。！？])\s+"

    def from_sources(seed: Column, cleaned: Column, prefer: Column) -> Column:
        good = (seed != "") & ~T.is_boilerplate(seed, rules) & ~T.is_garbled(seed) & ~T.is_file_name_phrase(seed) & (~prefer | T.has_hangul(seed))
        return F.coalesce(
            F.when(good, seed),
            T.blank_to_null(best_sentence(cleaned, max(30, limit - 6), prefer, rules, True)),
            F.when(prefer, T.blank_to_null(best_hangul_phrase(cleaned, max(24, limit - 8), rules))),
            T.blank_to_null(T.collapse(cleaned)),
            T.sanitize(F.regexp_replace(name, r"\.[^.]+$", "")),
        )

    def enriched(first: Column, cleaned: Column, prefer: Column) -> Column:
        longer = lambda extra: F.when((extra != "") & (extra != first), F.get(F.split(F.concat(first, F.lit(" "), extra), end), F.lit(0))).otherwise(first)
        return F.when(F.length(first) >= least, first).otherwise(T.let(best_sentence(cleaned, limit, prefer, rules, True), longer))

    def finished(first: Column) -> Column:
        cut = F.when(F.length(first) > limit, F.rtrim(F.substring(first, 1, limit))).otherwise(first)
        return T.ended(F.when(cut == "", "No summary").otherwise(cut), limit)

    def whole(x: Column) -> Column:
        base = T.let(T.collapse(from_sources(x["seed"], x["cleaned"], x["prefer"])), lambda b: F.coalesce(F.get(F.split(b, end), F.lit(0)), F.lit("")))
        return T.let(T.let(base, lambda f: enriched(f, x["cleaned"], x["prefer"])), finished)

    cleaned = T.clean_for_summary(text, rules)
    parts = T.let(cleaned, lambda c: F.struct(T.summary_seed(given).alias("seed"), c.alias("cleaned"), (T.has_hangul(c) | T.has_hangul(name)).alias("prefer")))
    return T.let(parts, whole)
