"""Token columns: byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import bpe
from folioforge.llm.batches import as_list, ending, only, pieces


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Ids of each text, as the ``tokenizers`` library gives them without special tokens added.

    ``vocabulary``: path of a byte-level BPE file, readable on every executor.
    Returns one row per input row: ``id_col``, ``ids array<int>`` and, with
    ``decode``, ``decoded string`` made from the ids alone.  A null or empty text
    has no ids; null and repeated identifiers pass through; other columns are
    not read.  The work is narrow: no shuffle, and a batch of about 4 MB of text
    at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for whole in batches:
            for b in pieces(whole, "text"):
                ids, n = coder.encode_batch(as_list(b.column("text")))
                offsets = np.append(0, np.cumsum(n))
                out = [b.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    out.append(pa.array(coder.decode_batch(ids, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    given = only(docs, id=id_col, text=text_col)
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(ending(run), f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each list of ids, special tokens included; a null list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for b in batches:
            texts = [coder.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    given = only(tokens, id=id_col, ids=ids_col)
    return given.mapInArrow(ending(run), f"id {given.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(tokens: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of the result of :func:`encode` with ``decode``."""
    return tokens.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
