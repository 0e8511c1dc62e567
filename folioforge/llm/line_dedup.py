"""Removal of lines that a later document shares with an earlier one, by pairwise alignment.

Lines are hashed.  A document's partners are the earliest documents that hold its
lines, or its windows of consecutive lines that just reach the words of a block.
Each pair is aligned with patience diff: lines that occur once on
either side and in the same order are anchors, and equal lines around and between
them complete the blocks.  Aligned blocks of enough words go from the later
document.  The earliest copy of a line is never removed, so no line is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.batches import ending, only
from folioforge.llm.shingles import mix
from folioforge.llm.storage import staged

#: Words of a line from which it can lead to a partner, and of an aligned block from which it goes.
LINE_WORDS, BLOCK_WORDS = 3, 10
#: Lines that are hashed as windows at once; a document with more is worked on by itself.
CHUNK_LINES = 1 << 19
#: Base of the polynomial hash of windows and its inverse, modulo 2**64.
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Pairs of indices of aligned equal lines, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and x[i2 - 1] == y[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        nx, ny = Counter(x[i:i2]), Counter(y[j:j2])
        at = {v: k for k, v in enumerate(y[j:j2], j) if ny[v] == 1}
        pairs = [(k, at[x[k]]) for k in range(i, i2) if nx[x[k]] == 1 and x[k] in at]
        if not pairs:
            continue
        # longest run of anchors in the same order
        ends: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, b) in enumerate(pairs):
            p = bisect_left(ends, b)
            if p == len(ends):
                ends.append(b)
                piles.append(n)
            else:
                ends[p], piles[p] = b, n
            back.append(piles[p - 1] if p else -1)
        n, chain = piles[-1], []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        out += chain
        a, b = i, j
        for c, d in [*chain, (i2, j2)]:
            todo.append((a, c, b, d))
            a, b = c + 1, d + 1
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Lines of the first side in runs of consecutive aligned lines with ``least`` words or more."""
    out: list[int] = []
    run: list[int] = []
    for n, (i, j) in enumerate(pairs):
        if n and pairs[n - 1] == (i - 1, j - 1):
            run.append(i)
        else:
            run = [i]
        if n + 1 == len(pairs) or pairs[n + 1] != (i + 1, j + 1):
            if sum(words[k] for k in run) >= least:
                out += run
            run = []
    return out


def keys_of(hashes: np.ndarray, words: np.ndarray, size: np.ndarray, line_words: int, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all that can lead to a partner, once for each row; ``size``: lines of each row.

    These are lines of ``line_words`` words or more, and of the windows of lines
    with ``block_words`` words or more the shortest from each line and the shortest
    up to each line.  Every line of a block that a row shares with another is in
    one of these windows that lies in the block.
    """
    n, h = len(hashes), hashes.astype(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    stop = np.cumsum(size)
    begin = stop - size
    upto = np.append(0, np.cumsum(words.astype(np.int64)))
    at = np.arange(n)
    there = np.searchsorted(upto, upto[:-1] + block_words, side="left")
    ahead = there <= stop[row]
    back = np.searchsorted(upto, upto[1:] - block_words, side="right") - 1
    behind = back >= begin[row]
    i, j = np.concatenate([at[ahead], back[behind]]), np.concatenate([there[ahead], at[behind] + 1])
    with np.errstate(over="ignore"):
        power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), b, np.uint64)))[:n] for b in (_BASE, _INVERSE))
        total = np.append(np.uint64(0), np.cumsum(mix(h) * power))
        window = mix((total[j] - total[i]) * inverse[i] + (j - i).astype(np.uint64))
    window = np.where(j - i == 1, h[i], window)  # a line alone is that line
    long = words >= line_words
    rows, keys = np.concatenate([row[long], row[i]]), np.concatenate([h[long], window])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))[: len(rows)]
    return rows[new], keys[new]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, n_lines, removed array<int>, text`` for each row: the lines that go, counted from 0, and what stays.

    Lines end with a line feed and are equal without blanks at their ends.
    Documents are ordered by identifier, nulls first, and rows that repeat one in
    any fixed order; so of equal rows the first stays.  A null text is empty and
    has no lines.  Partners of a document: for each line of ``line_words`` words or
    more, and for each window of :func:`keys_of`, however common, the earliest
    document that has it.  A block whose windows have earlier holders apart from
    each other is compared with those, and not with a later document that holds it
    together; the windows themselves go all the same.
    """
    given = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.when(F.length("text") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    given = given.withColumn("row", F.monotonically_increasing_id()).withColumn("lines", lines)
    stripped = F.transform("lines", lambda s: F.btrim(s, F.lit(" \t\r\x0b\x0c")))
    given = given.withColumn("hashes", F.transform(stripped, lambda s: F.xxhash64(s))).withColumn("words", F.transform(stripped, lambda s: F.when(s == "", 0).otherwise(F.regexp_count(s, F.lit(r"[ \t\x0b\x0c]+")) + 1)))
    given = staged(given.select("id", "row", "text", "hashes", "words"), "lines")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lines = np.cumsum(whole.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            cut = np.flatnonzero(np.diff(lines // CHUNK_LINES)) + 1
            for at, stop in zip([0, *cut.tolist()], [*cut.tolist(), whole.num_rows], strict=True):
                b = whole.slice(at, stop - at)
                h, w = b.column("hashes"), b.column("words")
                rows, keys = keys_of(h.flatten().to_numpy(), w.flatten().to_numpy(), np.diff(lines[at:stop], prepend=lines[at - 1] if at else 0), line_words, block_words)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("row").take(rows), pa.array(keys.astype(np.int64))], ["id", "row", "h"])

    seen = given.select("id", "row", "hashes", "words").mapInArrow(ending(keyed), f"id {given.schema['id'].dataType.simpleString()}, row long, h long")
    seen = seen.select(F.struct("id", "row").alias("doc"), "h")
    shared = staged(seen.groupBy("h").agg(F.count("*").alias("df"), F.min("doc").alias("first")).filter("df > 1").select("h", "first"), "shared-keys")
    # one partner for each key, so common ones add no more pairs than others; the many that have one partner are dealt out by Spark's skew join
    pairs = seen.join(shared, "h").filter("doc.row != first.row").select(F.col("doc.row").alias("row"), F.col("first.row").alias("other")).distinct()
    one = given.select("row", F.col("hashes").alias("x"), "words")
    two = given.select(F.col("row").alias("other"), F.col("hashes").alias("y"))
    both = pairs.join(one, "row").join(two, "other").select("row", "x", "words", "y")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for x, words, y in zip(b.column("x"), b.column("words"), b.column("y"), strict=True):  # one row at a time as objects: many can have a long partner
                gone.append(blocks(patience(x.as_py(), y.as_py()), words.as_py(), block_words))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    gone = both.mapInArrow(ending(align), "row long, gone array<int>").filter(F.size("gone") > 0)
    gone = gone.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A byte for each line up to the last that goes, 1 if it goes: a line is looked up at its place, however many go."""
        for b in batches:
            marks = []
            for r in b.column("removed"):
                at = r.values.to_numpy()
                mark = np.zeros(int(at[-1]) + 1, np.uint8)
                mark[at] = 1
                marks.append(mark.tobytes())
            yield b.append_column("mark", pa.array(marks, pa.binary()))

    gone = gone.mapInArrow(ending(marked), "row long, removed array<int>, mark binary")
    out = given.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda s, i: F.substring("mark", i + 1, F.lit(1)) != F.lit(b"\x01"))
    text = F.when(F.col("mark").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(F.col("id").alias(id_col), F.size("hashes").cast("long").alias("n_lines"), "removed", text.alias("text"))
