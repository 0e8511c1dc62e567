"""Ranking of sentences and keywords against a plain-Python model, on every document of a table."""

import re

import pytest
from pyspark.sql import functions as F

from folioforge.config import KOREAN, NEUTRAL, RulePack
from folioforge.functions import text as T
from folioforge.operators import quick, ranking
from folioforge.plans import catalog

SF = "/root/testdata/sf0.001"
TYPICAL = "The agreement of 2019 was signed. Dear all. Please find it here, thanks. This agreement is made between the two parties of the sale; see page 12. xyz brt klm. ||| === "


@pytest.fixture(scope="module")
def texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [r["text"] for r in d] + [None, "", " ", TYPICAL, TYPICAL * 20, "a. b. c.", "통지 계약서 내용입니다. " * 40]


def apply(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def squeezed(s):
    return re.sub(r"\s+", " ", s or "").strip(" ")


def split(s):
    return [x for x in re.split(r"(?<=[.!?。！？])\s+|\n+", s)]


def key(s):
    return re.sub("[^a-z0-9가-힣]+", "", s.lower())


def unique(items):
    seen = set()
    for s in items:
        if key(s) and key(s) not in seen:
            seen.add(key(s))
            yield s


def boilerplate(s):
    return len(s.strip(" ")) < 8 or any(re.search(p, s.strip(" ")) for p in NEUTRAL.boilerplate)


def garbled(s):
    w = re.findall("[A-Za-z]{3,}", s)
    return len(w) >= 3 and (sum(not re.search("[aeiouAEIOU]", x) for x in w) / len(w) >= 0.4 or sum(len(x) == 3 for x in w) / len(w) >= 0.7)


def noise(s):
    s = s.strip(" ")
    t = re.findall("[A-Za-z가-힣0-9]+", s)
    signs = len(re.findall(r"[^A-Za-z가-힣0-9\s.,;:!?()\-]", s))
    return not s or bool(re.search(r"[\|`~^_=]{2,}|[^\w\s.,;:!?()\-]{4,}", s)) or len("".join(t)) < 10 or signs / len(s) >= 0.2 or sum(len(x) <= 2 for x in t) / len(t) >= 0.5


def excerpt(text, limit):
    s = squeezed(text)
    if len(s) <= limit:
        return s
    head = max(400, int(limit * 0.6))
    pool = [squeezed(x) for x in split(s[head:])]
    pool = [x for x in pool if len(x) >= 12 and not re.search(NEUTRAL.mail_words, x) and not re.search(r"[\|`~^_=]{2,}", x) and len(re.findall("[A-Za-z가-힣0-9]+", x)) >= 4]
    ranked = sorted(enumerate(unique(pool)), key=lambda p: (-3 * bool(re.search(NEUTRAL.summary_words, p[1])), -max(0, 45 - abs(len(p[1]) - 34)), -len(re.findall("[A-Za-z가-힣0-9]", p[1])), p[0]))
    used, taken = 0, []
    for _, x in ranked:
        if used >= (limit - head) * 0.9:
            break
        if used + len(x) + 1 <= limit - head:
            used += len(x) + 1
            taken.append(x)
    return s[:head] + ("\n...\n" + "\n".join(taken) if taken else "")


def best(s, target, hangul):
    good = unique([x for x in split(squeezed(s)) if x.strip(" ") and not boilerplate(x) and not garbled(x)])
    score = lambda p: (2 * bool(re.search(NEUTRAL.summary_words, p[1])) + 3 * (hangul and bool(re.search("[가-힣]", p[1]))), bool(re.search(NEUTRAL.structure_words, p[1])), max(0, 40 - abs(len(p[1]) - target)), min(len(p[1]), 80), -p[0])
    return max(enumerate(good), key=score, default=(0, ""))[1]


def phrase(s, target):
    cores = [re.sub(r"[^가-힣A-Za-z0-9\s]", "", x).strip(" ") for x in split(squeezed(s)) if x.strip(" ") and re.search("[가-힣]", x) and not boilerplate(x) and not noise(x)]
    kept = [(len(re.findall("[가-힣]", c)) + max(0, 20 - abs(len(c) - target)), -i, c) for i, c in enumerate(cores) if len(re.findall("[가-힣]", c)) >= 6]
    return max(kept, default=(0, 0, ""))[2]


def summary(text, stem, limit=80, least=24):
    cleaned = " ".join(x for x in split(squeezed(text)) if x.strip(" ") and not boilerplate(x) and not garbled(x) and not noise(x))
    hangul = bool(re.search("[가-힣]", cleaned + stem))
    base = squeezed(best(cleaned, max(30, limit - 6), hangul) or (phrase(cleaned, max(24, limit - 8)) if hangul else "") or squeezed(cleaned) or stem)
    first = re.split(r"(?<=[.!?。！？])\s+", base)[0]
    if len(first) < least:
        extra = best(cleaned, limit, hangul)
        first = re.split(r"(?<=[.!?。！？])\s+", f"{first} {extra}")[0] if extra and extra != first else first
    first = first[:limit].rstrip(" ") if len(first) > limit else first
    s = (first or "No summary").rstrip(" .!?。！？,;:")
    return (s[: limit - 1].rstrip(" ") if len(s) >= limit else s) + "."


def test_excerpts(spark, texts):
    for limit in (600, 1000, 8000):
        assert apply(spark, texts, lambda c: ranking.excerpt(c, limit)) == [excerpt(t, limit) for t in texts]


def test_summaries(spark, texts):
    assert apply(spark, texts, lambda c: ranking.normal_summary(F.lit(""), c, F.lit("plain name.pdf"))) == [summary(t, "plain name") for t in texts]


def test_hangul_phrases_and_noise(spark, texts):
    assert apply(spark, texts, lambda c: ranking.best_hangul_phrase(c)) == [phrase(t, 28) for t in texts]
    assert apply(spark, texts, T.is_noise) == [noise(t or "") for t in texts]


def keyword(name, text):
    source = re.sub(r"(?i)PAGE\s+\d+", " ", f"{name}\n{(text or '')[:12000]}")
    found = []
    for t in re.findall(r"([A-Za-z][A-Za-z0-9\- ]{2,40})", source):
        t = squeezed(re.sub(r'[\\/:*?"<>|]+', " ", t)).strip("._")
        words = re.findall("[a-z]+", t.lower())
        bad = len(re.findall("[A-Za-z]", t)) < 3 or len(t.split(" ")) > 6 or t.lower() in (*NEUTRAL.low_value_words, *NEUTRAL.company_words) or re.search(NEUTRAL.keyword_noise, t) or (words and all(w in NEUTRAL.company_words for w in words))
        if not bad:
            found.append(t)
    scored = [(2 * bool(re.search(NEUTRAL.keyword_positive, t)), found.count(t), len(t), -found.index(t), t) for t in dict.fromkeys(found)]
    return max(scored, default=(0, 0, 0, 0, ""))[4][:40]


def test_keywords(spark, texts):
    assert apply(spark, texts, lambda c: ranking.keyword(F.lit("x1.pdf"), c)) == [keyword("x1.pdf", t) for t in texts]


ODD = [
    "The report\x1cof 2020 holds. \x1f\x1d A decision\u00a0was\u2028made by all of them.", "Toé quick brown foxes jump. To the quick brown foxes. Fro\u0301m the hills it came. From\u0301 the hills it came. This\u0301 agreement is long.",
    "Same words here, then. SAME WORDS HERE THEN! same; words; here; then? Same words here, then.", "İstanbul Kelvin meets \u212aelvin scale. kelvin meets kelvin scale here.", "\U0001f600\U0001f600\U0001f600\U0001f600 faces in a long sentence here. Four marks a\u0301\u0301\u0301\u0301\u0301 in a longer sentence here.",
    "हिन्दी में एक लंबा वाक्य है this agreement. ⒶⒷⒸⒹⒺ letters in circles are no noise at all. ①②③④⑤ numbers in circles are noise here.", "계약서 내용입니다 그리고 더. This contract of 2019 is about 통지서 and more. 가나다라마바사아자차카타파하 좋습니다!", "x" * 300 + ". " + "ab cd ef gh. " * 50,
    "land  sale page 12 memo - memo memo-memo, Company Limited; inc llc. PAGE  7 hello world, hello there", "no end of it and no end of it! Then！ And。 Then some more words, which are many. dear reader of this. Dearest reader of this.", "a | b || c __ d. Please copy: any form of notice, ,  copy it. All  rights reserved by the many firms.", "\n\n. . ! ? 。", "limited company; international corporation; page 1",
]


def test_quick_summaries_and_keywords(spark, texts):
    """Against the column functions, with odd texts and names and a pack of other patterns."""
    everything = texts[-60:] + ODD
    assert [quick.portable(p) for p in (NEUTRAL, KOREAN, RulePack(summary_words="a.b"), RulePack(keyword_noise="[a-z&&[^b]]"))] == [True, False, False, False]
    own = RulePack(boilerplate=(r"(?i)\bthe\b", "Notice$"), summary_words=r"\bof\b|한", structure_words=r"[0-9]{4}", keyword_positive=r"(?i)an\w+")
    for rules, name, limit, least in ((NEUTRAL, F.lit("plain name.pdf"), 80, 24), (NEUTRAL, F.lit("통지 PAGE 12 report.v2.pdf"), 80, 24), (own, F.lit(None).cast("string"), 40, 60)):
        told = lambda c: F.struct(quick.summary(c, name, limit, least, rules), ranking.normal_summary(F.lit(""), c, name, limit, least, rules), quick.keyword(name, c, rules), ranking.keyword(name, c, rules))  # noqa: B023, E731
        for s, t, k, m in apply(spark, everything, told):
            assert (s, k) == (t, m)


def test_keywords_and_summaries_of_whole_texts(spark, texts, tmp_path):
    """The query, on texts of which what counts stands behind the first 12,000 characters."""
    plain = "Some grey birds sat by a quiet lake; " * 400
    long = [plain + "The lease agreement ends. ", plain.replace(";", ".") + "old notice; new notice; new notice; ", "land report, " * 900 + "sea report, " * 1000, "." * 11995 + " agreement", "\U0001f600 " * 7000 + "grey memo", plain * 20 + "certificate of the land"]
    everything = texts + long
    spark.createDataFrame(list(enumerate(everything)), "doc_id int, text string").withColumn("source", F.lit("x1")).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["summaries"](spark, str(tmp_path)).orderBy("doc_id").collect()
    whole = [keyword(f"x1.pdf\n{t or ''}", "") for t in everything]  # the model cuts its text, not its name
    assert [r["keyword"] for r in got] == whole
    assert whole[-6:] == ["The lease agreement ends", "new notice", "sea report", "agreement", "grey memo", "certificate of the land"]
    assert [r["summary"] for r in got] == [summary(t, "x1") for t in everything]
    assert apply(spark, everything, lambda c: ranking.keyword(F.lit("x1.pdf"), c, chars=None)) == whole
    assert apply(spark, long[:1], lambda c: quick.keyword(F.lit("x1.pdf"), c, KOREAN, None)) == whole[-6:-5]  # a pack that is not portable


def test_few_sentences_are_tested():
    """The query tests sentences in the order of their scores and no more than it needs."""
    s = quick.Sentences(" ".join(f"Sentence number {k} of a long text has some words in it." for k in range(3000)), [quick._pattern(p, False) for p in NEUTRAL.boilerplate], quick._pattern(NEUTRAL.summary_words, False), quick._pattern(NEUTRAL.structure_words, False))
    assert len(s.all) == 3000 and s.best(74, False).startswith("Sentence number 1000 ") and len(s.tested) < 5
