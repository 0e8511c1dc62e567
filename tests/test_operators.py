"""Plans, change feeds and proposals on small frames, and every query against DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge import config
from folioforge.operators import delta, records, rename, review, survey
from folioforge.plans import catalog
from folioforge.plans.proposals import propose, resolve
from folioforge.sources.scratch import scratch
from folioforge.streaming import progress

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    return sorted(repr([norm(r[c]) for c in columns]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    rel = duck.sql(catalog.SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert rows_of(columns, [r.asDict() for r in got]) == rows_of(columns, expected)


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """The documents under numbers of which some read as dates, such as 13 10 22."""
    path = str(tmp_path_factory.mktemp("numbered"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 131000).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["review_reason", "badges", "review_tab_auto", "review_tab_counts", "two_key_counts"])
def test_numbers_of_items_are_no_dates(spark, numbered, name):
    """Against the SQL of the query."""
    df = catalog.QUERIES[name](spark, numbered)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{numbered}/documents.parquet/*.parquet'")
    columns, rel = sorted(df.columns), con.sql(catalog.SQL[name])
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert expected and rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, expected)


@pytest.fixture(scope="module")
def altered(spark, tmp_path_factory):
    """Runs a query and its SQL over other documents: ``(name, rows) -> (got, expected)``."""

    def run(name, rows):
        path = str(tmp_path_factory.mktemp("altered"))
        rows.write.parquet(f"{path}/documents.parquet")
        df = catalog.QUERIES[name](spark, path)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        columns, rel = sorted(df.columns), con.sql(catalog.SQL[name])
        expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
        return rows_of(columns, [r.asDict() for r in df.collect()]), rows_of(columns, expected)

    return run


@pytest.fixture(scope="module")
def repeated(spark):
    """Two documents under each number."""
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.expr("doc_id div 2"))


def test_badges_of_repeated_and_missing_numbers(spark, altered, repeated):
    """A badge for each row: none meets another of its number, and none is left out for want of one."""
    got, expected = altered("badges", repeated)
    assert len(expected) == repeated.count() and got == expected
    got, expected = altered("badges", repeated.withColumn("doc_id", F.when(F.col("doc_id") % 9 != 4, F.col("doc_id"))))
    assert len(expected) == repeated.count() and got == expected


@pytest.fixture(scope="module")
def dated(spark):
    """Documents of a source whose name ends as one with a date does."""
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("src_240101"))


def test_review_tab_auto_of_sources_like_dates(altered, dated, repeated):
    got, expected = altered("review_tab_auto", dated)
    assert expected and got == expected
    got, expected = altered("review_tab_auto", repeated)
    assert expected and got == expected


def test_review_tab_counts_of_repeated_numbers(altered, dated, repeated):
    """Each row counts once, whatever its source is called."""
    got, expected = altered("review_tab_counts", repeated)
    assert got == expected
    got, expected = altered("review_tab_counts", dated)
    assert got == expected


def test_two_key_counts_of_repeated_numbers(altered, dated, repeated):
    """Each row counts once, with the reason that SQL gives it."""
    for rows in (repeated, dated):
        got, expected = altered("two_key_counts", rows)
        assert expected and got == expected


def proposal(spark, name, text="Statement of Claim 2024.05.14", **more):
    row = {"item_id": 1, "path": f"case/{name}", "folder": "case", "name": name, "ext": ".pdf", "extraction_status": "success", "text_excerpt": text} | more
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if k == 'item_id' else 'string'}" for k in row))
    return propose(df).first()


def test_name_has_suffix_and_org(spark):
    r = proposal(spark, "sample.pdf")
    assert r["suggested"].endswith(".pdf") and "ORG" in r["suggested"] and r["document_date"] == "240514"


def test_date_at_the_end_of_a_name_wins(spark):
    r = proposal(spark, "sample_231024.pdf")
    assert r["document_date"] == "231024" and "240514" not in r["suggested"] and "date unknown" not in r["reason"]


def test_date_inside_a_name_does_not(spark):
    assert proposal(spark, "sample_231024_rev2.pdf")["document_date"] == "240514"


def test_without_enricher_confidence_is_too_low(spark):
    r = proposal(spark, "sample.pdf")
    assert r["needs_review"] and r["confidence"] == 0.72 and "confidence 72% < 78%" in r["reason"]


def test_only_rows_with_a_text_are_enriched(spark):
    rows = [(1, "c/a.pdf", "success", "Some text of a memo"), (2, "c/b.pdf", "success", "  "), (3, "c/c.pdf", "error:parse", "text"), (4, "c/d.pdf", None, None)]
    df = spark.createDataFrame([(i, p, "c", p[2:], ".pdf", s, t) for i, p, s, t in rows], "item_id int, path string, folder string, name string, ext string, extraction_status string, text_excerpt string")
    out = {r["item_id"]: r for r in propose(df, enrich=lambda d: d.withColumns({"document_title": F.lit("Given Title"), "confidence": F.lit(0.9)})).collect()}
    assert [out[i]["document_title"] == "Given Title" for i in (1, 2, 3, 4)] == [True, False, False, False] and out[1]["confidence"] == 0.9 and out[2]["confidence"] == 0.72


def test_collisions_number_every_member(spark):
    df = spark.createDataFrame([(1, "d", "A.pdf"), (2, "d", "a.pdf"), (3, "e", "a.pdf"), (4, "d", "b")], "seq int, folder string, suggested string")
    out = {r["seq"]: (r["conflict"], r["final_name"]) for r in review.number_collisions(df).collect()}
    assert out == {1: (True, "A(1).pdf"), 2: (True, "a(2).pdf"), 3: (False, "a.pdf"), 4: (False, "b")}


def test_resolve_caps_confidence(spark):
    df = spark.createDataFrame([(i, f"d/x{i}", "d", "same.pdf", "s", "c", "", 0.9, False) for i in range(2)], "item_id int, path string, folder string, suggested string, summary string, case_name string, institution string, confidence double, needs_review boolean")
    assert {(r["confidence"], r["needs_review"], r["status"]) for r in resolve(df).collect()} == {(0.84, True, "duplicate_conflict")}


def test_apply_gives_old_less_deleted_plus_added(spark):
    cols = "item_id int, folder string, name string, ext string, path string, size int, modified string"
    old = spark.createDataFrame([(i, "f", f"n{i}", "", f"f/n{i}", i, "t0") for i in range(6)], cols)
    feed = spark.createDataFrame([(1, "f", "n1", "", "f/n1", 1, "t1", "upsert"), (2, None, None, None, None, None, None, "delete"), (9, "f", "n9", "", "f/n9", 9, "t0", "upsert"), (8, None, None, None, None, None, None, "delete"), (3, "f", "n3", "", "f/n3", 99, "t0", "upsert")], cols + ", op string")
    kinds = {r["item_id"]: r["change"] for r in delta.classify(old, feed).collect()}
    assert kinds == {1: "modified", 2: "deleted", 9: "added", 8: "ignored", 3: "unchanged"}
    assert {r["item_id"] for r in delta.apply(old, feed).collect()} == {0, 1, 3, 4, 5, 9}


def test_rollback_undoes_a_rename(spark):
    inv = spark.createDataFrame([(1, 1, "d", "a", "d/a", "b", "Y"), (2, 2, "d", "c", "d/c", "bad:x", "Y"), (3, 3, "d", "e", "d/e", "a", "y "), (4, 4, "d", "z", "d/z", "q", "")], "seq int, item_id int, folder string, name string, path string, suggested string, approval string")
    log = rename.plan(inv, inv)
    assert {r["seq"]: r["status"] for r in log.collect()} == {1: "success", 2: "invalid_filename", 3: "target_exists"}
    done = rename.rollback_rows(log)
    after = inv.join(done.select("seq"), "seq", "left_anti").select("path").union(done.select("new_path"))
    back = rename.rollback_plan(done, after, []).collect()
    assert [(r["path"], r["status"]) for r in back] == [("d/a", "restored")]


def test_seq_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["seq"] for r in survey.with_seq(df, "k").orderBy("k").collect()] == list(range(1, 1001))
    assert survey.with_seq(df.filter("k < 0"), "k").count() == 0


def test_numbers_are_dense_where_ranges_are_sampled(spark):
    """Two million wide rows, written with all their columns: no number is missing or comes twice."""
    n = 2_000_000
    path = scratch(spark, "seq-test")
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("row"), F.lit(1).alias("part"))
    survey.with_seq(df, "key", parts=8).write.parquet(f"{path}/seq")
    delta.running(df, {"done": F.lit(1), "odd": F.col("row") % 2}, "key", parts=8).write.parquet(f"{path}/running")
    seq, done = (spark.read.parquet(f"{path}/{x}") for x in ("seq", "running"))
    assert seq.columns == ["key", "row", "part", "seq"] and done.columns == ["key", "row", "part", "done", "odd"]
    assert seq.agg(F.countDistinct("seq"), F.min("seq"), F.max("seq"), F.countDistinct("row")).first() == (n, 1, n, n)
    assert done.agg(F.countDistinct("done"), F.min("done"), F.max("done"), F.max("odd")).first() == (n, 1, n, n // 2)
    assert seq.join(done, "key").filter("seq <> done").isEmpty()  # both follow the order of the key
    low = seq.filter("seq <= 1000").agg(F.max("key")).first()[0]
    assert df.filter(F.col("key") <= low).count() == 1000


def test_numbers_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("a", 4), (None, 5)], "k string, seq int")
    rows = survey.with_seq(df, "k", parts=3).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [1, 2, 3, 4, 5] and [r["k"] for r in rows] == [None, None, "a", "a", "b"]
    flags = delta.running(spark.createDataFrame([(1, None), (2, True), (3, False), (4, True)], "i int, ok boolean"), {"ok": F.col("ok")}, "i")
    assert [tuple(r) for r in flags.orderBy("i").collect()] == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_the_last_row_of_a_feed_counts(spark):
    old = spark.createDataFrame([(k, "f", f"n{k}", "", f"f/n{k}", k, "t0") for k in (1, 2, 3)], "item_id int, folder string, name string, ext string, path string, size int, modified string")
    up = lambda k, name, seq: (k, "f", name, "", f"f/{name}", 1, "t1", "upsert", seq)
    gone = lambda k, seq: (k, None, None, None, None, None, None, "delete", seq)
    feed = spark.createDataFrame([up(2, "b", 1), up(2, "c", 2), up(1, "z", 3), gone(1, 4), gone(3, 5), up(3, "n3", 6), gone(9, 8), up(9, "q", 7), up(None, "x", 9), up(None, "y", 10)], "item_id int, folder string, name string, ext string, path string, size int, modified string, op string, seq int").repartition(3)
    assert sorted((r["item_id"] or 0, r["name"]) for r in delta.apply(old, feed).collect()) == [(0, "x"), (0, "y"), (2, "c"), (3, "n3")]
    assert sorted((r["item_id"] or 0, r["change"]) for r in delta.classify(old, feed).collect()) == [(0, "added"), (0, "added"), (1, "deleted"), (2, "modified"), (3, "modified"), (9, "ignored")]


def test_edits_and_generic_summaries_keep_other_columns(spark):
    rows = spark.createDataFrame([("a", "s1", "e"), ("b", "s2", "e")], "path string, suggested string, _edit string")
    out = {r["path"]: r for r in rename.with_edits(rows, spark.createDataFrame([("b", "mine", 1)], "path string, name string, suggested int")).collect()}
    assert (out["a"]["suggested"], out["a"]["manually_edited"], out["b"]["suggested"], out["b"]["manually_edited"], out["b"]["_edit"]) == ("s1", False, "mine", True, "e")
    generic = config.NEUTRAL.generic_summaries[0]
    rows = spark.createDataFrame([("p1", generic + ".", "Case", "", True), ("p2", generic.upper(), "", "Inst", True), ("p3", "own summary", "Case", "", False), ("p4", None, "Case", "", False)], "path string, summary string, case_name string, institution string, _often boolean")
    out = {r["path"]: r for r in review.rewrite_generic(rows, limit=80).collect()}
    assert out["p1"]["summary"] == f"Case {generic}." and out["p2"]["summary"] == f"Inst {generic.upper()}." and out["p3"]["summary"] == "own summary" and out["p4"]["summary"] is None and not out["p3"]["_often"]


def test_rollback_history_is_newest_first(spark):
    maps = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "file string, mtime int")
    runs = spark.createDataFrame([("a", 5, 2), ("a", 7, 1)], "file string, ts int, restored int")
    assert [(r["file"], r["times"], r["last"], r["restored"]) for r in rename.rollback_history(maps, runs).collect()] == [("b", 0, None, 0), ("c", 0, None, 0), ("a", 2, 7, 3)]


def test_stream_rewrites_only_what_it_touches(spark):
    """Micro-batches in order, one of them run again, against the batch operator; a bucket of which nothing is left."""
    cols = "item_id int, folder string, name string, ext string, path string, size int, modified string"
    old = spark.createDataFrame([(k, "f", f"n{k}", "", f"f/n{k}", k, "t0") for k in range(40)], cols)
    snapshot, source, mark = (scratch(spark, t) for t in ("snapshot", "feed", "mark"))
    progress.start_snapshot(old, snapshot, 16)
    rows = [(k, "f", f"m{k}", "", f"f/m{k}", k, "t1", "delete" if k % 3 else "upsert", k) for k in (*range(0, 12), 45, 46)] + [(3, None, None, None, None, None, None, "delete", 100), (1, "f", "back", "", "f/back", 1, "t2", "upsert", 101)]
    schema = f"{cols}, op string, seq int"
    state = old
    for n in range(0, len(rows), 4):
        batch = spark.createDataFrame(rows[n : n + 4], schema).coalesce(1)
        batch.write.mode("append").parquet(source)
        state = spark.createDataFrame(delta.apply(state, batch).collect(), cols)
        progress.upsert_stream(progress.file_stream(spark, source, batch.schema, 1), snapshot, mark, 16)
        assert sorted(map(tuple, progress.snapshot_rows(spark, snapshot).collect())) == sorted(map(tuple, state.collect()))
    assert {len(v) for v in progress._versions(spark, snapshot).values()} <= {1, 2}
    everything = spark.createDataFrame([(k, None, None, None, None, None, None, "delete", 200) for k in range(50)], schema)
    everything.coalesce(1).write.mode("append").parquet(source)
    progress.upsert_stream(progress.file_stream(spark, source, everything.schema, 1), snapshot, mark, 16)
    assert progress.snapshot_rows(spark, snapshot).isEmpty()


def test_a_cancelled_stream_goes_on_where_it_stopped(spark):
    source, out, mark = (scratch(spark, t) for t in ("source", "out", "mark"))
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: progress.file_stream(spark, source, spark.range(1).schema, 1)
    assert not progress.run_cancellable(stream(), out, mark, lambda: True, 0.01)
    assert progress.run_cancellable(stream(), out, mark, lambda: False)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(60))


def test_pages_that_came_too_late(spark):
    rows = [(1, 0, "x" * 50, 10.0, False), (1, 1, "", 0.0, True), (2, 0, "", 0.0, True), (3, 0, "y" * 50, 20.0, None)]
    df = spark.createDataFrame(rows, "item_id int, page int, text string, confidence double, late boolean")
    assert {r["item_id"]: r["status"] for r in records.merge_pages(df, timed_out=F.col("late")).collect()} == {1: "timeout_partial", 2: "ocr_empty_text", 3: "success"}


def test_image_fits(spark):
    df = spark.createDataFrame([(2000, 3000), (400, 600)], "w int, h int")
    fit = lambda n: [(r[0]["width"], r[0]["height"]) for r in df.select(records.fitted(F.col("w"), F.col("h"), n)).collect()]
    assert fit(1000) == [(666, 1000), (400, 600)] and fit(0) == [(2000, 3000), (400, 600)]


def test_name_pairs_and_rollback_items(spark):
    html = '<table><tr><td class="x cell-name" title="a/b.pdf">b.pdf</td><td class="cell-name" title="a/c.pdf"><b>c</b>.pdf</td></tr><tr><td>no</td></tr></table>'
    (r,) = records.name_pairs(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert tuple(r) == (1, "a/b.pdf", "b.pdf", "a/c.pdf", "c.pdf")
    item = '{"original_full_path":"a","new_full_path":"b"}'
    raw = spark.createDataFrame([(f"[{item}]",), (f'{{"site_url":"s","items":[{item},{item}]}}',)], "value string")
    assert sorted((r["site_url"] or "", r["new_full_path"]) for r in records.rollback_items(raw).collect()) == [("", "b"), ("s", "b"), ("s", "b")]
