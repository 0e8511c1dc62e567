"""The ten operators and the pipeline against plain Python, on rows with nulls, blanks, long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import math
import random
import re
import tarfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import bpe, jaccard_join, language_id, licenses, line_dedup, media, packing, secrets, warc
from folioforge.llm.components import components
from folioforge.llm.digest_index import DigestIndex
from folioforge.llm.queries import oracle_sql, queries, vocabulary
from folioforge.llm.shingles import shingle_sets
from folioforge.llm.storage import fresh_path
from folioforge.llm.tokenize import decode, digests, encode

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, digest string, rank int"
rng = random.Random(7)
WORDS = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def near(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE.replace(" ", "\n")), (3, BASE.upper()), (4, near(BASE, 2, 2)), (5, near(BASE, 3, 3)), (6, prose(80, 4)), (7, None), (8, ""), (9, "  \n\t"),
    (10, "one two"), (11, "one  two "), (12, "one two three four five"), (13, prose(6000, 5)), (14, "😀 漢字 don't <|endoftext|> x"), (15, "12345 !!"), (None, prose(50, 6)), (None, BASE),
    (6, prose(80, 4)), (16, "A" * 3000), (17, "the passage " + prose(40, 9)), (18, prose(40, 9)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], "s", len(t or ""), "r", "i", "d", 1) for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < -1")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# -- 1 -----------------------------------------------------------------------------


def test_language_id(spark, docs, none):
    model = language_id.fit(docs)
    assert sorted(model) == ["en", "fr"] and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in model.values())
    out = language_id.identify(docs.withColumn("score", F.lit(1)), model)
    assert sorted(out.columns) == sorted([*docs.columns, "lang_pred", "score"])
    for r in out.collect():
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and 0 <= r["score"] <= 1 and (has or r["score"] == 0)
    assert language_id.fit(none) == {} and language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_text_vector_is_the_bundle_of_bound_letters():
    v = language_id.Bundler().vector("Ab")
    codes = [32, ord("a"), ord("b"), 32]
    letter = lambda c: language_id.letter_vectors(np.array([c]))[0].astype(int)
    expected = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert (v == expected).all()


def test_spans_of_a_long_text_give_its_vector(monkeypatch):
    r = random.Random(8)
    for n in range(60):
        text = "".join(r.choice("ab  .éßИ漢\n1") for _ in range(r.randint(0, 40)))
        monkeypatch.setattr(language_id, "SPAN", 1 << 20)
        whole = language_id.Bundler().vector(text)
        monkeypatch.setattr(language_id, "SPAN", 1 + n % 7)
        spans = language_id.Bundler().vector(text)
        assert (whole is None and spans is None) or (whole == spans).all(), text


def test_language_id_equals_plain_python(spark):
    """Prototypes and predictions from dictionaries of trigrams, one document at a time."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = [r for r in d.collect()]
    letter = functools.cache(lambda c: language_id.letter_vectors(np.array([c]))[0].astype(np.int64))

    def profile(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            return None
        s = f" {' '.join(words)} "
        return sum(k * np.roll(letter(ord(a)), 2) * np.roll(letter(ord(b)), 1) * letter(ord(c)) for (a, b, c), k in Counter(zip(s, s[1:], s[2:], strict=False)).items()).astype(float)

    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] and r["text"]]
    sums = defaultdict(lambda: np.zeros(language_id.DIM))
    for r in learn:
        if (v := profile(r["text"])) is not None:
            sums[r["lang"]] += v / np.linalg.norm(v)
    model = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = {r["doc_id"]: r for r in queries()["op1_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        v, out = profile(r["text"]), got[r["doc_id"]]
        assert out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if v is None:
            assert (out["lang_pred"], out["score"]) == ("und", 0)
            continue
        cos = {k: float(p @ v) / np.linalg.norm(v) for k, p in model.items()}
        assert abs(out["score"] - max(cos.values())) < 1e-4 and cos[out["lang_pred"]] > max(cos.values()) - 1e-4


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = language_id.fit(d.filter(language_id.remainder() != 0))
    held = language_id.identify(d.filter(language_id.remainder() == 0), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# -- 2 -----------------------------------------------------------------------------


def test_secret_spans(spark, docs, none):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    cases = {
        f'x token = "{key}" y': [("assign", 2, 11 + len(key)), ("hex", 11, 11 + len(key)), ("guess", 11, 11 + len(key))],
        "secret: qwertyuiop1999 ok": [("assign", 0, 22)],
        "secret: kZ8fQ1mW3xT9 ok": [("assign", 0, 20), ("guess", 8, 20)],
        "the token is international": [],
        "PassWord:abc12": [],
        "PassWord:abc123": [("assign", 0, 15)],
        "AKIA" + "A" * 16: [("access", 0, 20)],
        "AKIA" + "A" * 15: [],
        "token=token:abcdefgh": [],  # the first match takes the second keyword
        "é token: 'abcdef'": [("assign", 2, 16)],
        "my pwd is xK9#mQ2$vL7pR4 ok": [("guess", 10, 24)],
        "my pwd is qwertyuiop ok": [],
        "": [],
    }
    for text, spans in cases.items():
        assert secrets.find(text) == spans, text
    out = secrets.summary(secrets.scan(docs))
    assert out.count() == len(TEXTS) and {r["base_sha256"] for r in out.collect()} == {sha("")}
    assert secrets.scan(none).count() == 0
    one = spark.createDataFrame([(1, f"a token={key} b", "x")], "doc_id long, text string, spans string")
    assert secrets.mask(one).first()["text"] == "a <secret> b"
    assert secrets.mask(docs.filter("text IS NULL")).first()["text"] is None


def all_segmentations(value, words):
    """The least cost by trying every segmentation."""
    guess = secrets.Guesser(words)

    def segment(x):
        own = [1.0] if len(x) == 1 else []
        if len(x) >= 3:
            own.append(guess.word(x))
        if (m := secrets.DATE.match(value, value_at[0])) and m[0] == x:
            own.append(secrets.DATE_COST)
        for w in range(1, secrets.UNIT + 1):
            if len(x) >= max(3, 2 * w) and len(x) % w == 0 and x.lower() == x[:w].lower() * (len(x) // w):
                own.append(guess.unit(x[:w].lower()) + math.log10(len(x) // w))
        low, near = x.lower(), secrets.neighbours()
        if len(x) >= 3 and all(b in near.get(a, ()) for a, b in zip(low, low[1:], strict=False)):
            own.append(secrets.WALK_COST + secrets.KEY_COST * (len(x) - 1))
        return min(own, default=math.inf)

    value_at = [0]
    best = {0: 0.0}
    for j in range(1, len(value) + 1):
        best[j] = math.inf
        for i in range(j):
            value_at[0] = i
            best[j] = min(best[j], best[i] + segment(value[i:j]))
    return best[len(value)]


def test_guess_cost_is_the_least_over_segmentations():
    r, words = random.Random(11), ["pass", "sab", "abab", "asd", "word"]
    for n in range(400):
        value = "".join(r.choice(["a", "b", "A", "s", "d", "@", "1", "as", "pass", "word", "1999", "20010203", "x9"][: 6 + n % 8]) for _ in range(r.randint(0, 14)))
        least = all_segmentations(value, words)
        assert abs(secrets.Guesser(words).log10(value) - least) < 1e-9, value
        for enough in (2.0, 5.0):
            assert (secrets.Guesser(words).log10(value, enough) > enough) == (least > enough), value
    cost = secrets.guesser().log10
    assert cost("password") < 1 and cost("aaaaaaaaaa") < 3 and cost("qwertyuiop") < 5 and cost("lovelovelove") < 4 and cost("") == 0
    assert abs(cost("xK9#mQ2$") - 8) < 1e-9


@pytest.mark.parametrize("unit", ["a", "as", "asdf", "qwertyuiop", "12", "password", "xK9#mQ2$v", "aab"])
def test_long_values_take_linear_time(unit):
    took = []
    for n in (20_000, 80_000):
        value = (unit * n)[:n]
        began = time.perf_counter()
        secrets.find(f"token={value}")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2


# -- 3 -----------------------------------------------------------------------------


def test_exact_dedup(spark, docs, none):
    index = DigestIndex(spark)
    out = index.add(docs).collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[sha(re.sub(r"[\x20\x09-\x0D]", "", t or ""))].append((i, t))
    assert len(out) == len(TEXTS)
    for r in out:
        g = groups[r["digest"]]
        named = [(-len(t or ""), i is None, i or 0) for i, t in g]
        keep = min(named)
        assert r["group_size"] == len(g) and r["keep_id"] == (None if keep[1] else keep[2])
    assert sum(r["kept"] for r in out) == len(groups)
    again = index.add(docs).collect()
    assert not any(r["kept"] for r in again) and {(r["digest"], r["keep_id"]) for r in again} == {(r["digest"], r["keep_id"]) for r in out}
    more = spark.createDataFrame([(99, "brand new"), (98, BASE)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in index.add(more).collect()} == {99: True, 98: False}
    assert index.table().count() == len(groups) + 1
    index.drop()
    assert DigestIndex(spark).add(none).count() == 0
    kept = DigestIndex(spark).kept(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_kept_rows_of_a_table_of_files(spark, docs):
    path = fresh_path(spark, "docs")
    docs.write.parquet(path)
    rows = DigestIndex(spark).kept(spark.read.parquet(path), fixed=True).collect()
    assert len(rows) == DigestIndex(spark).kept(docs).count() == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in rows})


def test_digest_index_is_opened_again(spark):
    """Three batches, the index closed and opened by its path between them, and compacted; with the least and the largest identifier."""
    least, largest = -(1 << 63), (1 << 63) - 1
    first = DigestIndex(spark, buckets=3)
    batch = spark.createDataFrame([(largest, "a"), (least, "a"), (5, "b"), (None, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in first.add(batch).collect()} == {(largest, least, False), (least, least, True), (5, 5, True), (None, None, True)}
    first.drop()
    again = DigestIndex(spark.newSession(), path=first.path, buckets=3)
    batch = spark.createDataFrame([(1, "a "), (2, "d"), (3, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again.add(batch).collect()} == {(1, least, False), (2, 2, True), (3, None, False)}
    small = again.compact(fresh_path(spark, "index"))
    again.drop()
    assert sorted(r["digest"] for r in small.table().collect()) == sorted(sha(x) for x in "abcd") and len(small.table().inputFiles()) <= 3
    assert [r["kept"] for r in small.add(batch).collect()] == [False] * 3
    small.drop()


# -- 4 -----------------------------------------------------------------------------


def brute(texts):
    sets = []
    for _, t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = label[a], label[b]
            label = [x if z == y else z for z in label]
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted((-1 if i is None else i, len(s), least.get(label[k], -1)) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True)))


def joined(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_jaccard_components(spark, docs, none):
    assert joined(jaccard_join.jaccard_components(docs)) == brute(TEXTS)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_components_with_common_tokens(spark, monkeypatch):
    """Families, a passage and a line that many share, and chains near the threshold, with nearly all shared tokens common."""
    line, passage = prose(9, 50), prose(60, 51)
    texts = [(k, near(BASE, 1 + k % 9, 100 + k)) for k in range(60)]
    texts += [(100 + k, line + " " + prose(8 + k % 5, 200 + k)) for k in range(40)]
    texts += [(200 + k, passage + " " + prose(4 + k, 300 + k)) for k in range(40)]
    texts += [(300 + k, line) for k in range(20)] + [(400 + k, near(passage, k % 4, 400 + k)) for k in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 15)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    for least in (2, 10, 10**6):
        monkeypatch.setattr(jaccard_join, "COMMON_FROM", least)
        assert joined(jaccard_join.jaccard_components(df)) == brute(texts), least


def test_texts_without_an_identifier_link_others(spark):
    """The middle of a chain, and a copy of it, have no identifier; so has a family that nobody else is in."""
    far = near(BASE, 4, 71)
    mid = " ".join(a if k % 2 else b for k, (a, b) in enumerate(zip(BASE.split(), far.split(), strict=True)))
    texts = [(1, BASE), (None, mid), (None, mid), (5, far), (None, prose(90, 72)), (None, near(prose(90, 72), 1, 73)), (7, prose(50, 74)), (None, None), (None, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert joined(jaccard_join.jaccard_components(df)) == brute(texts)


@pytest.mark.parametrize("seed,block,pairs,long_list", [(1, 2, 3, 8), (2, 5, 40, 12), (3, 2048, 1 << 18, 1 << 17)])
def test_random_families(spark, monkeypatch, seed, block, pairs, long_list):
    """Families that drift from their first member, with lists cut into small blocks and, if they are long, dealt out."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "COMMON_FROM", 8)
    monkeypatch.setattr(jaccard_join, "LIKELY", [0.25, 2.0, 0.25][seed - 1])  # 2: no star round finds a pair
    r, texts = random.Random(seed), []
    for family in range(12):
        text = prose(r.randint(6, 60), seed * 1000 + family)
        for _ in range(r.randint(1, 9)):
            texts.append((r.choice([None, *range(len(texts), len(texts) + 20)]), text))
            text = near(text, r.randint(0, 2), r.random())
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert joined(jaccard_join.jaccard_components(df)) == brute(texts)


def test_long_lists_are_the_same_dealt_out(spark):
    r = random.Random(5)
    groups = [(r.randrange(1 << 40), r.randrange(1 << 40), r.choice([20, 21, 30, 31, 90])) for _ in range(60)]
    rows = {(t, n, g, g2, (1 + (g + t) % 3 << 32) | t % 7) for t in range(5) for g, g2, n in (groups if t else groups[:1])}
    postings = spark.createDataFrame([x for x in rows for _ in range(2)], "token long, n int, g long, g2 long, info long").repartition(3)
    plain, dealt = (sorted(map(tuple, jaccard_join.shared_runs(postings, x).collect())) for x in ([], [0, 1, 3]))
    assert plain == dealt and len(plain) == 4 * len(groups)


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_members_of_two_labels_meet_once(spark, block):
    """Every two members of a list that have two labels meet in one cell, and blocks of one large label in none."""
    r = random.Random(block)
    label = {g: 0 if g < 30 else 1 if g < 42 else r.randrange(2, 9) for g in range(60)}
    rows = [(t, label[g], 9, g, -g, 5, 3) for t in (1, 2) for g in range(60)] + [(3, 0, 9, g, -g, 5, 3) for g in range(30)]
    runs = spark.createDataFrame(rows, "token long, label long, n long, g long, g2 long, last long, info long")
    found = jaccard_join.in_cells(runs, block).collect()
    cells = {}
    for x in found:
        cells.setdefault((x["token"], x["cell"]), []).append(x)
    met = Counter()
    for (token, _), members in cells.items():
        for x, y in itertools.combinations(members, 2):
            if x["label"] != y["label"] and (x["own"] or x["block"] != y["block"]):
                met[token, *sorted((x["g"], y["g"]))] += 1
            assert x["label"] != 0 or y["label"] != 0 or block >= 30 or x["block"] == y["block"]
    assert met == Counter({(t, a, b): 1 for t in (1, 2) for a, b in itertools.combinations(range(60), 2) if label[a] != label[b]})


def test_shingles_do_not_depend_on_the_batch():
    texts = [t.encode() for _, t in TEXTS if t is not None]
    alone = [shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(shingle_sets(texts), alone, strict=True))


def test_shingles_of_a_batch_of_few_words(spark):
    for n in range(6):
        text = " ".join(WORDS[:n])
        assert [len(s) for s in shingle_sets([text.encode()])] == [min(n, 1)] and (shingle_sets([text.encode()])[0] == shingle_sets([text.encode(), BASE.encode()])[0]).all()
    for n in range(1, 5):
        texts = [(1, " ".join(WORDS[:n]))]
        assert joined(jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u int, v int")
    out = {r["node"]: r["label"] for r in components(edges).collect()}
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# -- 5 -----------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    r = random.Random(3)
    texts = [x or "" for _, x in TEXTS] + ["it's we'll 's", "a  b\n\n c", "\x1c\x1d", " ", "'s", "x's's", "　é  "] + ["".join(r.choice("ab sdtmrvel'’ \n\t.,!0129éß漢😀À_-") for _ in range(r.randint(0, 50))) for _ in range(2000)]
    coder = bpe.ByteBPE(vocabulary(), slots=1 << 8)
    ids, n = coder.encode_batch([x.encode() for x in texts])
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got == expected and coder.failed > 0
    words = [x.encode() for x in WORDS]
    assert coder.encode_words(words) == [coder.merge_exactly(w) for w in words]
    out = encode(docs, vocabulary(), decode=True)
    rows = sorted(((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests(out).collect()))
    assert rows == sorted((len(e), sha(",".join(map(str, e))), sha(t.decode(e, skip_special_tokens=False))) for e in expected[: len(TEXTS)])
    assert {r["text"] for r in decode(out, vocabulary()).collect()} == {x or "" for _, x in TEXTS}
    assert encode(none, vocabulary()).count() == 0


def test_bpe_cuts_long_texts_where_words_begin(monkeypatch):
    from tokenizers import Tokenizer

    t, coder, r = Tokenizer.from_file(vocabulary()), bpe.ByteBPE(vocabulary()), random.Random(4)
    texts = ["".join(r.choice(["it's", " we", "ll ", "'s", "\n", "\n\n", " ", "a b", "漢。字", "，語", "<|endoftext|>", "12", "x" * 20]) for _ in range(400)) for _ in range(20)]
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for step in (1, 30, 1000):
        monkeypatch.setattr(bpe, "STEP", step)
        ids, n = coder.encode_batch([x.encode() for x in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == expected, step


# -- 6 -----------------------------------------------------------------------------


def test_warc(spark):
    big = "".join(prose(50, k) + "\r\n\r\n" for k in range(700))
    rows = [(5, "x" * 100), (3, "x" * 100), (4, "x" * 99), (2, "x" * 99), (1, None), (6, ""), (7, big), (9, big), (None, "y" * 200), (8, "y" * 200)]
    pages = spark.createDataFrame([(i, h, "z") for i, h in rows], "page_id long, html string, digest string").repartition(2)
    archives, folder = warc.archive_pages(pages)
    chunks = warc.read(archives, folder).collect()
    text = defaultdict(list)
    for c in sorted(chunks, key=lambda c: c["chunk_no"]):
        assert len(c["data"]) <= warc.CHUNK
        text[c["record_id"]].append(c)
    assert len(text["7"]) == -(-len(big) // warc.CHUNK)
    first = {5: 3, 9: 7}
    for i, h in rows:
        if i is None:
            assert text["None"][-1]["refers_to"] == "8"
            continue
        parts, payload = text[str(i)], (h or "").encode()
        assert parts[-1]["payload_digest"] == sha(payload) and parts[-1]["payload_bytes"] == len(payload)
        if i in first:
            assert parts[-1]["record_type"] == "revisit" and parts[-1]["refers_to"] == str(first[i])
        else:
            assert b"".join(c["data"] for c in parts) == payload and parts[-1]["crc32_so_far"] == zlib.crc32(payload) and parts[-1]["record_type"] == "response"
    empty, folder = warc.archive_pages(pages.filter("page_id < 0"))
    assert warc.read(empty, folder).count() == 0


def test_warc_writer_rejects_chunks_that_are_not_the_payload(spark):
    records = warc.plan_records(spark.createDataFrame([(1, "x" * 300)], "page_id long, html string")).withColumn("digest", F.lit("0" * 64))
    with pytest.raises(Exception, match="are not its payload"):
        warc.write(records, fresh_path(spark, "warc-test"))


def test_every_archive_is_read_by_a_task_of_its_own(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.repeat(F.col("id").cast("string"), 2000).alias("html")).repartition(5)
    folder = fresh_path(spark, "warc-test")
    archives = warc.write(warc.plan_records(pages), folder, archive_bytes=64)
    assert archives.count() == 40 and warc.read(archives, folder).rdd.getNumPartitions() == 40


def test_warc_rejects_damage():
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    raw = z.compress(warc.head("1", 9, 9, "d", None) + b"abc") + z.flush()
    with pytest.raises(EOFError):
        [list(b) for _, b in warc.records_in(io.BytesIO(raw))]


# -- 7 -----------------------------------------------------------------------------


def test_packing(spark, docs, none):
    coder = bpe.load(vocabulary())
    rows = packing.pack(docs, vocabulary(), 256, 0, rank_buckets=4).collect()
    want = Counter()
    for i, t in TEXTS:
        ids, _ = coder.encode_batch([(t or "").encode()])
        ids = np.append(ids, 0).astype("<u4")
        first = (len(ids) - 1) % 256 + 1
        for p, at in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[at : first if p == 0 else at + 256]
            want[(i, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= -(-sum(n for (*_, n, _), k in want.items() for _ in range(k)) // 256) + 1
    assert packing.pack(none, vocabulary(), 256, 0).count() == 0


def test_fullest_is_the_best_subset():
    r = random.Random(5)
    for _ in range(200):
        items = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
        room = r.randint(0, 30)
        counts = np.bincount(np.array([*items, 0]), minlength=31)
        counts[0] = 0
        used = packing.fullest(counts, room)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(n * k for n, k in used.items()) == best and all(counts[n] >= k for n, k in used.items())


# -- 8 -----------------------------------------------------------------------------


def test_line_dedup(spark, none):
    block = [prose(8, 900 + k) for k in range(4)]
    texts = {1: ["head one two three", *block, "tail a b c"], 2: ["other start here now", *block, "own end of two"], 3: ["short"], 4: [*block], 5: ["alone in the world " + prose(9, 77)], 6: []}
    rows = [(i, "\n".join(t)) for i, t in texts.items()] + [(7, None), (8, "\n".join(texts[1]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1]["removed"] == [] and out[2]["removed"] == [1, 2, 3, 4] and out[4]["removed"] == [0, 1, 2, 3] and out[8]["removed"] == [0, 1, 2, 3, 4, 5]
    assert out[2]["text"] == "other start here now\nown end of two" and out[8]["text"] == "" and out[7]["n_lines"] == 0 and out[5]["removed"] == []
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_lines_that_very_many_share(spark):
    p, q = ([prose(8, 950 + 10 * k + n) for n in range(3)] for k in range(2))
    minor = prose(5, 990)
    texts = {1: p, 2: q, 3: [*p, *q], 4: [minor], 5: [minor, *p]} | {k: [*p, *q] for k in range(6, 1100)} | {k: q for k in range(1100, 1110)}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert out[1] == out[2] == out[4] == [] and out[5] == [1, 2, 3]
    assert all(out[k] == [0, 1, 2, 3, 4, 5] for k in (3, *range(6, 1100))) and all(out[k] == [0, 1, 2] for k in range(1100, 1110))


def test_line_dedup_finds_blocks_of_a_later_pair(spark):
    """Each line of the block has an earlier holder elsewhere, or too few words to lead to one."""
    a, b, verse = prose(7, 970), prose(7, 971), [prose(1 + k % 2, 980 + k) for k in range(8)]
    texts = {1: [a, "x"], 2: [b, "y"], 3: ["p", a, b, "q"], 4: ["r", "s", a, b], 5: ["t", *verse], 6: [*verse, "u"], 7: ["one two three four five six seven eight nine ten", "v"], 8: ["one two three four five six seven eight nine ten", "", "w w"], 9: ["k", "one two three four five six seven eight nine ten", "", "w w"]}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert out == {1: [], 2: [], 3: [], 4: [2, 3], 5: [], 6: list(range(8)), 7: [], 8: [0], 9: [1, 2, 3]}


def test_line_dedup_against_all_pairs(spark):
    """Families of overlapping documents: nothing goes that no pair aligns, and nearly all that some pair aligns goes."""
    r, texts, ours, best = random.Random(12), [], 0, 0
    for family in range(40):
        lines = [prose(r.randint(1, 12), 5000 + 100 * family + k) for k in range(14)] + ["", "- - -"]
        for _ in range(r.randint(2, 6)):
            a = r.randint(0, 10)
            text = lines[a : a + r.randint(2, 8)]
            for _ in range(r.randint(0, 3)):
                text.insert(r.randint(0, len(text)), r.choice([r.choice(lines), prose(6, r.random())]))
            texts.append(text)
    ids = [None, *r.sample(range(10_000), len(texts) - 1)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").repartition(5)
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(df).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    for n, (i, x) in enumerate(order):
        every = set()
        for _, y in order[:n]:
            every.update(line_dedup.blocks(line_dedup.patience(x, y), [len(t.split()) for t in x], 10))
        got = set(out[i]["removed"])
        assert got <= every and out[i]["text"] == "\n".join(t for k, t in enumerate(x) if k not in got)
        ours, best = ours + len(got), best + len(every)
    assert best > 200 and ours >= 0.97 * best, (ours, best)


def test_line_dedup_of_a_long_text(spark):
    block = [prose(11, 7000 + k) for k in range(20)]
    long = [x for k in range(4000) for x in (block[k % 20], f"own line {k}")]
    df = spark.createDataFrame([(1, "\n".join(block)), (2, "\n".join(long)), (2, "\n".join(long))], "doc_id long, text string")
    began = time.perf_counter()
    rows = line_dedup.dedup_lines(df).collect()
    assert time.perf_counter() - began < 60 and sorted(len(r["removed"]) for r in rows)[::2] == [0, 8000]
    for r in rows:
        gone = set(r["removed"])
        assert r["text"] == "\n".join(x for k, x in enumerate(long if r["n_lines"] == 8000 else block) if k not in gone)


def test_keys_cover_every_line_of_every_block():
    r = random.Random(4)
    for _ in range(100):
        docs_ = [[(r.randint(0, 5), 0) for _ in range(r.randint(0, 12))] for _ in range(3)]
        docs_ = [[(v, [0, 1, 2, 4, 7, 12][v]) for v, _ in d] for d in docs_]
        flat = [x for d in docs_ for x in d]
        h, w = np.array([(v + 1) * 0x1234567 for v, _ in flat], np.int64), np.array([n for _, n in flat], np.int32)
        rows, keys = line_dedup.keys_of(h, w, np.array([len(d) for d in docs_]), 3, 10)
        got = [set(keys[rows == k].tolist()) for k in range(3)]
        for x, y in itertools.permutations(range(3), 2):
            shares = any(docs_[x][i:j] == docs_[y][k : k + j - i] and sum(n for _, n in docs_[x][i:j]) >= 10 for i in range(len(docs_[x])) for j in range(i + 1, len(docs_[x]) + 1) for k in range(len(docs_[y])))
            lines = {v for v, n in docs_[x] if n >= 3} & {v for v, n in docs_[y] if n >= 3}
            assert bool(got[x] & got[y]) == (shares or bool(lines))
    assert len(line_dedup.keys_of(np.array([], np.int64), np.array([], np.int32), np.array([0, 0]), 3, 10)[0]) == 0


def test_patience_aligns_equal_lines_in_order():
    r = random.Random(2)
    for _ in range(300):
        x, y = ([r.randint(0, 6) for _ in range(r.randint(0, 9))] for _ in range(2))
        pairs = line_dedup.patience(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


# -- 9 -----------------------------------------------------------------------------


def feature_of(raw):
    """Feature of the samples, counted one by one."""
    n = Counter(raw)
    entropy = -sum(k / len(raw) * math.log2(k / len(raw)) for k in n.values())
    return f"gray8 576x{len(raw) // 576} mean={sum(raw) / len(raw):.4f} entropy={entropy:.4f} levels={len(n)}"


def test_media(spark, docs, none):
    out = media.store_and_read(docs).collect()
    want = Counter()
    for i, t in TEXTS:
        raw = (t or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want[(i, len(raw), len(p), sha(p), zlib.crc32(p[-32:]), feature_of(p).split(" entropy")[0], 576, len(p) // 576, 8)] += 1
        assert all(abs(float(r["feature"].split("entropy=")[1].split()[0]) - float(feature_of(p).split("entropy=")[1].split()[0])) < 1e-3 for r in out if r["payload_sha256"] == sha(p))
    assert want == Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"].split(" entropy")[0], r["width"], r["height"], r["bits"]) for r in out)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["shard"], r["offset"]) for r in out}) == len({r["payload_sha256"] for r in out})
    assert media.store_and_read(none).count() == 0


def test_shards_are_tar_files_and_headers_suffice(spark, docs, monkeypatch):
    monkeypatch.setattr(media, "REMEMBERED", 1)
    folder = fresh_path(spark, "media-test")
    kept = media.store(docs, folder, shard_bytes=4096)
    images = media.places(kept)
    assert images.count() == kept.select("media_sha256").distinct().count() < kept.count()
    for shard in {r["shard"] for r in kept.collect()}:
        name = f"{folder.removeprefix('file://')}/{shard}"
        with tarfile.open(name) as tar:
            for m in tar:
                assert m.name.endswith(sha(tar.extractfile(m).read()) + ".png")
        with tarfile.open(name) as tar, open(name, "r+b") as f:  # samples are no longer there
            for m in tar:
                f.seek(m.offset_data + media.HEAD)
                f.write(b"\0" * (m.size - media.HEAD))
    heights = {r["media_sha256"]: r["height"] for r in media.metadata(images, folder).collect()}
    assert all(heights[r["media_sha256"]] == max(1, -(-r["n_bytes"] // 576)) for r in kept.collect())
    with pytest.raises(Exception, match="is damaged"):
        media.features(images, folder).collect()


# -- 10 ----------------------------------------------------------------------------


def test_licenses(spark, docs, none):
    mit = licenses.KNOWN["MIT"][0]
    texts = {1: mit, 2: "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), 3: "Some prose.\nReleased under the MIT Licence.\nMore.", 4: mit + " extra", 5: "Licensed under CC BY-NC 4.0.", 6: None, 7: "", 8: "This work is licensed under the GNU General Public License, version 3."}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, licenses string")
    out = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: r["licenses"] for i, r in out.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: [], 5: ["CC-BY-NC-4.0"], 6: [], 7: [], 8: ["GPL-3.0"]}
    assert out[1]["whole_license"] == out[2]["whole_license"] == "MIT" and out[3]["whole_license"] is None
    assert all(any(w in t.lower() for w in licenses.WORDS) for v in licenses.KNOWN.values() for t in v)
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == len(TEXTS)


def plain_canonical(text):
    t = regex.sub(licenses.COPYRIGHT_LINE, " ", text.lower())
    for a, b in licenses.SPELLINGS:
        t = t.replace(a, b)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub(r"\ball rights reserved\b", " ", t)).strip(" ")


def test_licenses_equal_plain_python(spark):
    """Every text of the table, and licences of several paragraphs inside longer texts, by comparing canonical texts."""
    parts = licenses.KNOWN["MIT"][0].split("\n")
    more = ["A file.\n\n" + "\n\n".join(parts) + "\n\nint main()", "\n \n".join(parts), "\n\n\n".join(licenses.KNOWN["BSD-3-Clause"][0].split("\n")), "x\n\n" + "\n\n".join(parts[:-1]), "\n\n".join([*parts, *parts])]
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + more
    known = {plain_canonical(t): k for k, v in sorted(licenses.KNOWN.items(), reverse=True) for t in v}
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = 0
    for i, t in enumerate(texts):
        paragraphs = [p for p in regex.split(r"\n[ \t\r]*\n\s*", t) if p.strip(" ")]
        runs = [" ".join(plain_canonical(p) for p in paragraphs[a : a + k]).strip() for k in range(1, licenses.PARAGRAPHS + 1) for a in range(len(paragraphs) - k + 1)]
        found = [known[c] for c in [*map(plain_canonical, regex.split(r"\r?\n", t)), *runs] if c in known]
        whole = known.get(plain_canonical(t))
        assert (out[i]["licenses"], out[i]["whole_license"], out[i]["n_units"]) == (sorted({*found, *([whole] if whole else [])}), whole, len(found)), t[:200]
        assert out[i]["canonical_sha256"] == sha(plain_canonical(t))
        hits += bool(found)
    assert hits > 5 and [out[len(texts) - len(more) + k]["licenses"] for k in range(5)] == [["MIT"], ["MIT"], ["BSD-3-Clause"], [], ["MIT"]]


def test_full_texts_of_long_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in files.values()):
        pytest.skip("no licence texts on this machine")
    rows = [(k, (folder / f).read_text().upper().replace("\n", "\r\n  ")) for k, f in files.items()]
    assert {r["doc_id"]: r["whole_license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == {k: k for k in files}
    own = licenses.scan(spark.createDataFrame([(1, "My  own LICENCE")], "doc_id long, text string"), texts={"Mine": ["my own license"]}, digests={}).first()
    assert own["whole_license"] == "Mine" and "Broadcast" in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"))._jdf.queryExecution().toString()


# -- queries and pipeline --------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in columns]) for r in rel.fetchall())


def test_pipeline_stages(spark, docs, none):
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == columns, name
    left = sorted((r["doc_id"], r["text"]) for r in now.filter("doc_id IS NOT NULL").collect())
    texts = [(i, t) for i, t in TEXTS if t and any(c.isalpha() for c in t)]
    seen, kept = {}, []
    for i, t in sorted(texts, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        if key not in seen:
            seen[key] = i
            kept.append((i, t))
    component = {i: c for i, _, c in brute(kept)}
    assert left == sorted((i, t) for i, t in kept if i is not None and component[i] == i)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.collect()}
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        if "text" in empty.columns:
            empty = none
