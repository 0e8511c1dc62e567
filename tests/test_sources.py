"""Scans, extraction and sinks on files made here."""

import io
import json
import zipfile

import pytest

from folioforge.config import Settings
from folioforge.sources import extract, inventory, scratch, sinks


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


DOCX = zipped(word__document='<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
XLSX = zipped(xl__workbook='<workbook><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings="<sst><si><t>name</t></si><si><t>x</t></si></sst>", xl__worksheets__sheet1='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
PPTX = zipped(ppt__slides__slide1='<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>', ppt__notesSlides__notesSlide1='<n xmlns:a="a"><a:p><a:t>said</a:t></a:p></n>')
EML = b"Subject: Hi\r\nFrom: a@b\r\nMIME-Version: 1.0\r\nContent-Type: text/html\r\n\r\n<p>One&nbsp;<b>two</b></p>"


def test_readers():
    assert extract.docx_text(DOCX) == "Hello there\na | b"
    assert extract.xlsx_text(XLSX) == "[Sheet] One\nname | n\nx | 7"
    assert extract.workbook_rows(XLSX) == [{"name": "x", "n": "7"}] and extract.workbook_rows(b"no") == []
    assert extract.pptx_text(PPTX) == "[Slide 1]\nTitle\n[Notes] said"
    assert extract.eml_text(EML) == "Subject: Hi\nFrom: a@b\nOne two"


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "c" / "4. cat").mkdir(parents=True)
    for name, data in {"c/a.docx": DOCX, "c/b.eml": EML, "c/~$a.docx": DOCX, "c/4. cat/x.xlsx": XLSX, "c/bad.docx": b"no zip", "c/l.doc": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    from pyspark.sql import functions as F

    from folioforge.functions.paths import in_rename_scope

    inv = inventory.scan_folder(spark, f"file://{tmp_path}")
    rows = {r["path"]: r for r in inv.collect()}
    assert sorted(r["seq"] for r in rows.values()) == [1, 2, 3, 4, 5, 6]
    assert rows["c/a.docx"]["supported"] and not rows["c/~$a.docx"]["supported"] and rows["c/4. cat/x.xlsx"]["folder"] == "c/4. cat"
    whole = inv.join(inventory.contents(spark, f"file://{tmp_path}"), "full_path").withColumn("in_scope", in_rename_scope(F.col("path")))
    out = {r["full_path"].rpartition("/")[2]: r["extraction_status"] for r in extract.extract(whole).collect()}
    assert out == {"a.docx": "success", "b.eml": "success", "~$a.docx": "unsupported_inference", "x.xlsx": "skipped_out_of_scope", "bad.docx": "error:BadZipFile", "l.doc": "manual_review_required"}


HWPX = zipped(Contents__section0='<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:t>First </hp:t><hp:t>line</hp:t></hp:run></hp:p><hp:p/></hs:sec>', Contents__section10="<s><p><t>last</t></p></s>", Contents__section2="<s><p><t>second</t></p></s>")


def test_word_processor_files():
    assert extract.hwpx_text(HWPX) == "First line\nsecond\nlast"
    one = lambda ext, data: extract._one(ext, data, Settings(), False)[:2]
    assert one(".hwpx", HWPX) == ("success", "First line\nsecond\nlast") and one(".hwpx", b"no zip") == ("manual_review_required", "")
    assert one(".docx", extract.LEGACY_HEADER + b" rest") == ("manual_review_required", "") and one(".hwp", b"") == ("manual_review_required", "")


def test_caches_and_downloads(spark, tmp_path):
    files = spark.createDataFrame([("a/b", "x.pdf", ".pdf", 5), ("a", "y", "", 7)], "folder string, name string, ext string, size long")
    sinks.survey_cache(files, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "headline")).first()["total_files"] == 2
    assert {r["node"]: r["total_files"] for r in spark.read.parquet(str(tmp_path / "s" / "folders")).collect()} == {"a": 2, "a/b": 1}
    sinks.json_lines(spark.createDataFrame([(1, None)], "i int, t string"), str(tmp_path / "j"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"i": 1, "t": None}]
    sinks.mapping_csv(spark.createDataFrame([("a,b", 'q"')], "old string, new string"), str(tmp_path / "m"))
    assert tuple(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).first()) == ("a,b", 'q"')


def test_scratch_is_cleared_by_age_and_within_its_folder(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "other").write_text("stays")
    root = f"file://{tmp_path / 'in'}"
    for name in ("../other", "", "/etc", ".", "a/../../other", "file:/etc"):
        with pytest.raises(ValueError):
            scratch.delete_inside(spark, root, name)
    assert scratch.delete_inside(spark, root, "x") and (tmp_path / "other").exists() and (tmp_path / "in").exists()
    old = scratch.written(spark.range(3), "old")
    assert scratch.clear_old(spark, 1000) == 0 and old.count() == 3


def test_workbook_logs_and_settings(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "r.xlsx").write_bytes(XLSX)
    assert [r.asDict() for r in inventory.review_rows(spark, str(tmp_path / "w" / "r.xlsx")).collect()] == [{"n": "7", "name": "x"}]
    log = spark.createDataFrame([(1, "a", "success"), (2, None, "target_exists")], "seq int, path string, status string")
    sinks.rename_log(log, str(tmp_path / "log"))
    sinks.rename_log(log.limit(1), str(tmp_path / "log"))
    back = inventory.json_log(spark, str(tmp_path / "log" / "json"), "seq int, path string, status string")
    assert sorted(r["seq"] for r in back.collect()) == [1, 1, 2] and spark.read.option("header", True).csv(str(tmp_path / "log" / "csv")).count() == 3
    assert json.loads(sinks.summary_json(log.groupBy().count())) == {"count": 2}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "k")], "item_id int, cache_key string")
    sinks.review_table(df, str(tmp_path / "r"))
    assert set(inventory.review_rows(spark, str(tmp_path / "r")).columns) == {"item_id", "cache_key", "approval", "reviewer_comment"}
    assert not sinks.rollback_map(df.filter("item_id = 0"), str(tmp_path / "b")) and sinks.rollback_map(df, str(tmp_path / "b"))
    sinks.cache(df, str(tmp_path / "c"), 10)
    sinks.cache(df, str(tmp_path / "c"), 11)
    assert inventory.versioned(spark, str(tmp_path / "c"), 11).count() == 1 and spark.read.parquet(str(tmp_path / "c")).count() == 2
