"""Packing of token pieces into fixed-length sequences by minimum bin slack.

What a bin may hold depends on lengths alone, so the plan is made from the
histogram of lengths, which has as many entries as a sequence has tokens, however
large the corpus.  A bin is seeded with the longest length left; a subset-sum
dynamic program over the available lengths, held as the bits of one integer,
finds the fullest combination for the rest.  The combination is taken as often as
the counts allow and removed.  Pieces then find their place by their rank among
those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import bpe
from folioforge.llm.batches import as_list, ending, only, pieces
from folioforge.llm.storage import staged


def fullest(counts: np.ndarray, room: int) -> Counter:
    """The multiset of available lengths with the largest sum up to ``room``; long lengths are preferred."""
    reach, layers, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def plan_bins(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Combinations of lengths, and how many bins take each.  ``counts[n]``: pieces of length n, up to the capacity."""
    left, capacity, plan = counts.copy(), len(counts) - 1, []
    left[0] = 0
    while (some := np.flatnonzero(left)).size:
        seed = int(some[-1])
        left[seed] -= 1
        used = fullest(left, capacity - seed)
        left[seed] += 1
        used[seed] += 1
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        plan.append((used, times))
    return plan


def cut(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, end it with ``end_id`` and cut what is longer than ``capacity``; the first piece takes the remainder.

    A null text is empty and so is one piece of length 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for whole in batches:
            for b in pieces(whole, "text"):
                ids, n = coder.encode_batch(as_list(b.column("text")))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = (n - (parts - 1) * capacity)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                begin = (np.cumsum(n) - n)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    given = only(docs, id=id_col, text=text_col)
    return given.mapInArrow(ending(run), f"id {given.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, *, rank_buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``.  Full pieces are sequences by themselves.  Others are
    ranked within (length, hash bucket), so that a common length is spread over
    ``rank_buckets`` tasks; the driver holds capacity * rank_buckets counts.
    Repeated rows are packed once each; no rows give no sequences; null
    identifiers pass through.
    """
    cuts = staged(cut(docs, vocabulary, capacity, end_id, id_col=id_col, text_col=text_col), "pieces")
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(rank_buckets)).cast("int")
    short = cuts.filter(F.col("length") < capacity).withColumn("bucket", bucket)
    cells = np.zeros((capacity, rank_buckets), np.int64)
    for r in short.groupBy("length", "bucket").count().toLocalIterator():
        cells[r["length"], r["bucket"]] = r["count"]
    counts = np.append(cells.sum(axis=1), 0)
    plan = plan_bins(counts)
    before = np.cumsum(cells, axis=1) - cells
    # for each length the runs of ranks that a combination takes: rank at which it begins, first bin, uses in a bin, offset in the bin
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, bins = Counter(), 0
    for used, times in plan:
        offset = 0
        for n in sorted(used, reverse=True):
            runs.setdefault(n, []).append((taken[n], bins, used[n], offset))
            taken[n] += used[n] * times
            offset += used[n] * n
        bins += times
    table = np.array([(n, *run) for n in sorted(runs) for run in runs[n]], np.int64).reshape(-1, 5)
    stride = np.int64(1) << 44
    keys = table[:, 0] * stride + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "bucket", "rank"))
            rank = before[n, k] + rank - 1
            run = table[np.searchsorted(keys, n * stride + rank, side="right") - 1]
            nth = rank - run[:, 1]
            columns = [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 2] + nth // np.maximum(run[:, 3], 1), pa.int64()), pa.array(run[:, 4] + nth % np.maximum(run[:, 3], 1) * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    kind = cuts.schema["id"].dataType.simpleString()
    packed = short.withColumn("rank", F.row_number().over(order)).mapInArrow(ending(place), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = cuts.filter(F.col("length") == capacity).select("*", (F.lit(bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("id", id_col)
