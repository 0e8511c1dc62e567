"""Scalar functions against values worked out by hand."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from folioforge.config import KOREAN, RulePack
from folioforge.functions import dates, fmt, paths
from folioforge.functions import text as T
from folioforge.operators import ranking


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_sanitize_is_idempotent(spark):
    raw = ["a/b:c", "  ..x..  ", "_a  b_", None, "", 'q"<>|?*', "a　b"]
    once = values(spark, raw, T.sanitize)
    assert once == ["a b c", "x", "a b", "", "", "q", "a b"]
    assert values(spark, once, T.sanitize) == once


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Statement of Claim 2024.05.14", "240514"),
        ("x 19991231 y", "991231"),
        ("05.06.07", "050607"),
        ("14-05-2019", "190514"),
        ("signed 200303 here", "200303"),
        ("1993년 4월 5일", "930405"),
        ("1993-04", "930401"),
        ("2023-02-30", "230201"),  # not in the calendar: the next patterns
        ("nothing", "date_unknown"),
        ("", "date_unknown"),
        (None, "date_unknown"),
        ("2019/12/10", "191210"),
    ],
)
def test_infer_date(spark, text, expected):
    assert values(spark, [text], dates.infer_date) == [expected]


def test_given_date_order(spark):
    assert values(spark, ["200303", "2020-03-03", "", "date_unknown", "9304"], dates.given_date) == ["030301", "200303", "date_unknown", "date_unknown", "930401"]
    assert values(spark, ["200303"], lambda c: dates.given_date(c, compat=False)) == ["200303"]


def test_suffix(spark):
    assert values(spark, ["sample_231024", "a_230231", "x"], dates.suffix_date) == ["231024", "230231", ""]
    assert values(spark, ["sample_231024", "a_230231", "x"], dates.suffix_is_valid) == [True, False, False]


def test_paths(spark):
    p = ["a/b/c.PDF", "c.tar.gz", "x", "a\\b\\c.txt", ""]
    assert values(spark, p, paths.extension) == [".pdf", ".gz", "", ".txt", ""]
    assert values(spark, p, paths.stem) == ["c", "c.tar", "x", "c", ""]
    assert values(spark, p, paths.folder) == ["a/b", "", "", "a/b", ""]
    assert values(spark, ["a/b/c", "a"], paths.ancestors) == [["a", "a/b", "a/b/c"], ["a"]]
    assert values(spark, ["f10", "f9", "F2"], paths.natural_key) == ["f" + "10".zfill(20), "f" + "9".zfill(20), "f" + "2".zfill(20)]
    assert values(spark, ["a/[done] 4. cat/x", "a/5. cat/x"], paths.in_rename_scope) == [False, True]
    assert values(spark, ["top/[x] case/1. files/Deep Dir/f.pdf"], paths.folder_hint) == ["Deep Dir"]
    assert values(spark, ["top/[x] case/f.pdf", "f.pdf"], paths.case_name) == ["case", ""]
    assert values(spark, ["a rev. 2.pdf", "b_v3.doc", "c final.pdf", "final_x ver 2.pdf", "finalist.pdf"], paths.revision_note) == ["rev.2", "v3", "final", "ver2", ""]
    assert values(spark, ["scan001_Lease 20190101 copy"], paths.clean_tail) == ["Lease"]
    korean = values(spark, ["a/4. 기타문서/x", "a/기타/x"], lambda c: paths.in_rename_scope(c, KOREAN))
    assert korean == [False, True]


def test_text_tests(spark):
    assert values(spark, ["Dear Sir, this is", "short", "A fine sentence here"], T.is_boilerplate) == [True, True, False]
    assert values(spark, ["xyz brt klm fgh", "plain readable words stand here"], T.is_garbled) == [True, False]
    assert values(spark, ["||| noise ===", "A plain line of words"], T.is_noise) == [True, False]
    assert values(spark, ["&amp;lt;b <i>x</i><script>no</script>"], T.strip_html) == ["<b x"]
    assert values(spark, ["aaaab 1c"], lambda c: T.squeezed_title(c, 10)) == ["aabc"]
    assert values(spark, ["one two three four"], T.title_from_words) == ["onetwo"]
    assert values(spark, ["extraordinarily long"], T.title_from_words) == ["extraordin"]


def test_best_sentence_and_excerpt(spark):
    text = "Dear all. This agreement is made between the parties. Other words follow in this text. This agreement is made between the parties."
    assert values(spark, [text], ranking.best_sentence) == ["This agreement is made between the parties."]
    long = "Intro words stand here. " * 30 + "The notice of claim was served today. " + "Plain filler sentence number one here. " * 20
    (out,) = values(spark, [long], lambda c: ranking.excerpt(c, 600))
    head, rest = out.split("\n...\n")
    assert len(head) == 400 and rest.split("\n")[0] == "The notice of claim was served today." and len(rest) + 1 <= 201
    assert values(spark, ["short", None], lambda c: ranking.excerpt(c, 600)) == ["short", ""]


def test_keyword_counts_phrases(spark):
    assert values(spark, ["alpha; beta\nalpha; Legal Notice"], lambda c: ranking.keyword(F.lit("x.pdf"), c)) == ["Legal Notice"]
    assert values(spark, ["alpha; beta; alpha; gamma"], lambda c: ranking.keyword(F.lit("1.pdf"), c)) == ["alpha"]


def test_formats(spark):
    size = lambda c: fmt.human_size(c.cast("long"))
    assert values(spark, ["0", "1023", "1280", "1048576"], size) == ["0.0 B", "1023.0 B", "1.2 KB", "1.0 MB"]
    assert values(spark, ["59", "3600", "-1"], lambda c: fmt.clock(c.cast("long"))) == ["00:59", "01:00:00", "00:00"]
    assert values(spark, ["0.795", "0.5", "0.4949"], lambda c: fmt.confidence_bucket(c.cast("double"))) == ["high", "mid", "low"]
    assert values(spark, ["90061", "3661", "61"], lambda c: fmt.duration(c.cast("long"))) == ["1d 1h 1m", "1h 1m", "1m 1s"]


def test_prefix_is_kept(spark):
    rules = RulePack(org_name="Org")
    out = values(spark, ["Org_Case_rest of it.pdf", "plain.pdf"], lambda c: paths.existing_prefix(c, F.lit("Project"), rules))
    assert [(r["prefix"], r["tail"]) for r in out] == [("Org_Case", "rest of it"), ("Org_Project", "plain")]


def test_share_tokens_of_long_addresses(spark):
    """57 bytes fill a line of base64; longer addresses and other letters stay in one."""
    urls = ["https://x.example/" + "a" * n for n in (0, 38, 39, 40, 41, 200)] + ["https://x.example/통지?>>>" * 20, None]
    expected = ["u!" + base64.urlsafe_b64encode(u.encode()).decode().rstrip("=") for u in urls[:-1]] + [None]
    assert values(spark, urls, paths.share_token) == expected


def test_texts_without_dates_are_passed_over(spark):
    """Against every pattern on strings of digits and signs."""
    draw = random.Random(5)
    made = ["".join(draw.choice(["20", "19", "1", "0", "5", "12", "3", "x", ".", "-", "/", " ", "년", "월", "_", "٣", "\u00a0"]) for _ in range(draw.randint(2, 9))) for _ in range(20000)]
    plain = lambda c: F.coalesce(*(dates._found(c, *p) for p in dates.PATTERNS), F.lit(dates.UNKNOWN))
    pairs = values(spark, made, lambda c: F.struct(dates.infer_date(c), plain(c), c.rlike(dates.NEEDED)))
    assert [p[0] for p in pairs] == [p[1] for p in pairs] and sum(p[1] != dates.UNKNOWN for p in pairs) > 300 and any(not p[2] for p in pairs)
