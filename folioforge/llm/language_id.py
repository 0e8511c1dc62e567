"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point.  A trigram is bound by multiplying the vectors of its letters, permuted by
their place; a text is the bundle, the sum, of its trigrams, and a language the
bundle of its documents.  A document gets the language whose prototype has the
largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folioforge.llm.batches import ending, only, pieces
from folioforge.llm.shingles import mix

DIM = 1024
GAP = 32
#: What a text without a letter gets.
UNKNOWN = "und"
#: Rows of each language, in expectation, that a fit reads.
FIT_ROWS = 2000
#: A document is worked on in spans of so many characters.
SPAN = 1 << 20
#: Vectors of documents are added as whole numbers of this fraction, so that their order changes nothing.
UNIT = 1 << 32


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code point."""
    words = mix(codes.astype(np.uint64)[:, None] * np.uint64(DIM // 64 + 1) + np.arange(1, DIM // 64 + 1, dtype=np.uint64))
    return np.unpackbits(words.view(np.uint8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def bound(trigrams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams given as rows of three code points."""
    codes, back = np.unique(trigrams, return_inverse=True)
    letters = letter_vectors(codes)
    a, b, c = (letters[back.reshape(trigrams.shape)[:, k]] for k in range(3))
    return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c


def symbols(text: str, before: np.ndarray | None = None, ends: bool = True) -> np.ndarray:
    """Lower-case letters as code points, anything between them as one gap, and a gap at both ends.

    A text can come in spans: ``before`` are the last symbols of the span before,
    ``ends`` says that no other follows.
    """
    low = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    gap = np.array([GAP], np.int64)
    codes = np.concatenate([gap if before is None else before, np.where(_letters()[low], low, GAP), gap[: int(ends)]])
    return codes[np.append(True, (codes[1:] != GAP) | (codes[:-1] != GAP))]


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


class Bundler:
    """Text vectors; keeps the vectors of trigrams it has met, up to a bound."""

    def __init__(self, keep: int = 30_000):
        self.keep, self.known = keep, {}
        self.rows = np.empty((1024, DIM), np.int8)

    def vector(self, text: str) -> np.ndarray | None:
        """Sum of the trigram vectors, or None without a letter; spans of a long text give those of the whole."""
        total, any_letter, tail = np.zeros(DIM, np.float32), False, None
        for at in range(0, max(1, len(text)), SPAN):
            s = symbols(text[at : at + SPAN], tail, at + SPAN >= len(text))
            tail = s[-2:]
            if len(s) < 3:
                continue
            any_letter = True
            key, n = np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True)
            total += n.astype(np.float32) @ self._rows(key).astype(np.float32)
        return total if any_letter else None

    def _rows(self, key: np.ndarray) -> np.ndarray:
        where = np.fromiter(map(self.known.get, key.tolist(), [-1] * len(key)), np.int64, len(key))
        new = np.flatnonzero(where < 0)
        if len(new):
            if len(self.known) + len(new) > self.keep:
                self.known.clear()
                if len(key) > self.keep:
                    k = key
                    return bound(np.stack([k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF], axis=1))
                where[:], new = -1, np.arange(len(key))
            at = len(self.known)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            k = key[new]
            self.rows[at : at + len(new)] = bound(np.stack([k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF], axis=1))
            where[new] = np.arange(at, at + len(new))
            self.known.update(zip(k.tolist(), where[new].tolist(), strict=True))
        return self.rows[where]


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Prototype of each language, of unit length, from the rows of ``labelled`` that have one.

    Of a language with more than ``fit_rows`` rows a share is read that makes
    ``fit_rows`` of them in expectation, picked by a hash of ``key_col``; this
    bounds what is shuffled and what the driver gets.  Rows without a text or a
    language are not read; repeated rows count each; no rows give no prototype.
    """
    rows = only(labelled, key=key_col, lang=lang_col, text=text_col).filter("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: min(1.0, fit_rows / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return {}
    dice = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 20))
    limit = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 20))))))[F.col("lang")]
    picked = rows.filter(dice < limit).select("lang", "text").repartition(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        bundler = Bundler()
        for whole in batches:
            for b in pieces(whole, "text"):
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if (v := bundler.vector(text)) is not None and (size := float(np.linalg.norm(v))):
                        sums[lang] = sums.get(lang, np.zeros(DIM, np.int64)) + np.rint(v * (UNIT / size)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    sums: dict[str, np.ndarray] = {}
    for r in picked.mapInArrow(ending(run), "lang string, v array<long>").collect():
        sums[r["lang"]] = sums.get(r["lang"], np.zeros(DIM, np.int64)) + np.array(r["v"])
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its cosine, 0 at least, from the text alone.

    A text that is null or has no letter, and any text if there is no prototype,
    gets ``und`` and 0.  Of equal cosines the language first in alphabetical order
    wins.  All columns of ``docs`` but those two names are kept.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIM)
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]
    given = docs.select(*kept)
    spec = StructType([*given.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for whole in batches:
            for b in pieces(whole, text_col):
                pred, score = [], []
                for text in b.column(text_col).to_pylist():
                    v = bundler.vector(text) if text and names else None
                    size = 0.0 if v is None else float(np.linalg.norm(v))
                    if v is None:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    cos = matrix @ v / size if size else np.zeros(len(names))
                    best = int(cos.argmax())
                    pred.append(names[best])
                    score.append(min(1.0, max(0.0, float(cos[best]))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, pred_col, score_col])

    return given.mapInArrow(ending(run), spec)


def remainder(key: str = "doc_id") -> F.Column:
    """crc32 of the identifier as text, modulo 5: 0 is the held-out fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5
