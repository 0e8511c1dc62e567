"""Text of office files, mails and web pages, from their bytes with the standard library.

A row's extension picks the reader; scope and support are decided before, in
columns, so that only rows to read reach Python, in Arrow batches.  Recognition of
images, legacy binary formats and protected files give a status and no text.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.config import IMAGES, Settings

_LOCAL = re.compile(r"\{[^}]*\}")


def _tag(e: ET.Element) -> str:
    return _LOCAL.sub("", e.tag)


def _texts(e: ET.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def _member(data: bytes, names: Callable[[str], bool]) -> Iterator[tuple[str, ET.Element]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        key = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        for n in sorted(filter(names, z.namelist()), key=key):
            yield n, ET.fromstring(z.read(n))


def docx_text(data: bytes) -> str:
    """Paragraphs, then the rows of tables."""
    (_, root), lines, rows = next(_member(data, lambda n: n == "word/document.xml")), [], []
    inside = {id(p) for t in root.iter() if _tag(t) == "tbl" for p in t.iter() if _tag(p) == "p"}
    for p in root.iter():
        if _tag(p) == "p" and id(p) not in inside and (s := _texts(p).strip()):
            lines.append(s)
        elif _tag(p) == "tr" and (cells := [c for c in (_texts(x).strip() for x in p if _tag(x) == "tc") if c]):
            rows.append(" | ".join(cells))
    return "\n".join([*lines, *rows])


def pptx_text(data: bytes) -> str:
    """For each slide its number and shapes; speaker notes after them."""
    notes = {re.sub(r"\D", "", n): _texts(r).strip() for n, r in _member(data, lambda n: re.fullmatch(r"ppt/notesSlides/notesSlide\d+\.xml", n) is not None)}
    out = []
    for name, root in _member(data, lambda n: re.fullmatch(r"ppt/slides/slide\d+\.xml", n) is not None):
        k = re.sub(r"\D", "", name.rpartition("/")[2])
        out.append(f"[Slide {k}]")
        out += [s for s in (_texts(p).strip() for p in root.iter() if _tag(p) == "p") if s]
        if notes.get(k):
            out.append(f"[Notes] {notes[k]}")
    return "\n".join(out)


def _sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    shared = [_texts(si) for _, r in _member(data, lambda n: n == "xl/sharedStrings.xml") for si in r if _tag(si) == "si"]
    names = [s.get("name", "") for _, r in _member(data, lambda n: n == "xl/workbook.xml") for s in r.iter() if _tag(s) == "sheet"]
    for k, (_, root) in enumerate(_member(data, lambda n: re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n) is not None)):
        rows = []
        for row in (x for x in root.iter() if _tag(x) == "row"):
            cells: list[str] = []
            for c in (x for x in row if _tag(x) == "c"):
                column = 0
                for ch in re.sub(r"\d", "", c.get("r", "")):
                    column = column * 26 + ord(ch) - 64
                value = next((x.text or "" for x in c if _tag(x) == "v"), "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _texts(c)
                cells += [""] * (column - 1 - len(cells)) + [value]
            rows.append(cells)
        yield names[k] if k < len(names) else f"Sheet{k + 1}", rows


def xlsx_text(data: bytes) -> str:
    out = []
    for name, rows in _sheets(data):
        out.append(f"[Sheet] {name}")
        out += [" | ".join(c for c in cells if c.strip()) for cells in rows if any(c.strip() for c in cells)]
    return "\n".join(out)


def workbook_rows(data: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by its header; what isn't a workbook has none."""
    if not data or data[:2] != b"PK":
        return []
    _, rows = next(_sheets(data))
    head = rows[0] if rows else []
    return [{h: v for h, v in zip(head, [*r, *[""] * len(head)], strict=False) if h} for r in rows[1:] if any(r)]


def html_text(html: str) -> str:
    for tag in ("style", "script"):
        html = re.sub(rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ", html)
    html = re.sub(r"<[^>]+>", " ", html)
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        html = html.replace(a, b)
    return re.sub(r"\s+", " ", html).strip()


def eml_text(data: bytes) -> str:
    """Headers, plain parts or else stripped HTML, and names of attachments."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Cc", "Date") if m[k]]
    plain, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            files.append(part.get_filename())
        elif part.get_content_type() == "text/plain":
            plain.append(part.get_content().strip())
        elif part.get_content_type() == "text/html":
            html.append(html_text(part.get_content()))
    body = [x for x in (plain if any(plain) else html) if x]
    return "\n".join(["\n".join(head), *body, *([f"Attachments: {', '.join(files)}"] if files else [])]) if body or files else ""


def hwpx_text(data: bytes) -> str:
    """Paragraphs of all sections of a zipped word-processor file, in the order of the sections' numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sections = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sections:
            raise ValueError("no sections")
        out = []
        for name in sections:
            for p in ET.fromstring(z.read(name)).iter():
                if p.tag.rpartition("}")[2] == "p":
                    out.append("".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t"))
    return "\n".join(x for x in out if x)


READERS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pptx": pptx_text, ".xlsx": xlsx_text, ".eml": eml_text, ".html": lambda d: html_text(d.decode("utf-8", "replace"))}
#: Formats that need a person or another program.
BY_HAND = (".doc", ".ppt", ".xls", ".hwp")
#: Fixed value: how a file of the oldest word-processor format begins, whatever its name says.
LEGACY_HEADER = b"HWP Document File V3.00"


def pdf_text(data: bytes, limit: int) -> tuple[str, int] | None:
    """Text layer and pages, or None without a PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    pages = PdfReader(io.BytesIO(data)).pages
    out, size = [], 0
    for p in pages:
        out.append(p.extract_text() or "")
        size += len(out[-1])
        if size >= limit:
            break
    return "\n".join(out), len(pages)


def _one(ext: str, data: bytes, settings: Settings, ocr: bool) -> tuple[str, str, int]:
    try:
        if ext in BY_HAND or data.startswith(LEGACY_HEADER):
            return "manual_review_required", "", 0
        if ext == ".hwpx":
            try:
                text = hwpx_text(data)
            except Exception:  # protected or damaged: a person can still open it
                return "manual_review_required", "", 0
            return ("success" if text.strip() else "empty_text"), text, 0
        if ext == ".pdf":
            got = pdf_text(data, settings.excerpt_chars)
            if got is None:
                return "missing_dependency:pypdf", "", 0
            enough = len(re.sub(r"\s", "", got[0])) >= settings.force_ocr_chars
            return ("success" if enough else "ocr_empty_text" if ocr else "insufficient_text_no_ocr"), got[0], got[1]
        if ext in IMAGES:
            return "missing_dependency:ocr" if ocr else "insufficient_text_no_ocr", "", 1
        if ext not in READERS:
            return "unsupported", "", 0
        text = READERS[ext](data)
        return ("success" if text.strip() else "empty_text"), text, 0
    except Exception as e:  # a broken file is a row with its error, not a failed job
        return f"error:{type(e).__name__}", "", 0


def extract(files: DataFrame, settings: Settings | None = None, ocr: bool = False, key: str = "full_path") -> DataFrame:
    """``key, extraction_status, extracted_text, text_excerpt, page_count`` of rows with ``ext, content``.

    Columns ``in_scope`` and ``supported``, if there, short-circuit: such rows
    never reach Python.
    """
    s = settings or Settings()
    skip = F.lit(None).cast("string")
    if "supported" in files.columns:
        skip = F.when(~F.col("supported"), "unsupported_inference").otherwise(skip)
    if "in_scope" in files.columns:
        skip = F.when(~F.col("in_scope"), "skipped_out_of_scope").otherwise(skip)
    files = files.withColumn("_skip", skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_one(e, bytes(c), s, ocr) for e, c in zip(b["ext"], b["content"], strict=True)]
            yield pd.DataFrame({key: b[key], "extraction_status": [g[0] for g in got], "extracted_text": [g[1] for g in got], "text_excerpt": [g[1][: s.excerpt_chars] for g in got], "page_count": [g[2] for g in got]})

    kind = files.schema[key].dataType.simpleString()
    spec = f"{key} {kind}, extraction_status string, extracted_text string, text_excerpt string, page_count int"
    read = files.filter("_skip IS NULL").select(key, "ext", "content").mapInPandas(run, spec)
    rest = files.filter("_skip IS NOT NULL").select(key, F.col("_skip").alias("extraction_status"), F.lit("").alias("extracted_text"), F.lit("").alias("text_excerpt"), F.lit(0).alias("page_count"))
    return read.unionByName(rest)
