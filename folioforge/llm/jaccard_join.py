"""Exact Jaccard join of word-shingle sets by a grouped prefix join.

Two sets of Jaccard similarity t or more share a token among the first
``n - ceil(t * n) + 1`` of each in any global order.  The order used here puts
tokens that a summary of the corpus finds common last and others by their hash.
Documents with equal sets are one class, classes with equal prefix and size one
group; postings are written for groups.  Group pairs that meet in a posting list
are filtered by size and by the overlap that their prefixes leave possible, then
expanded to classes, whose whole sets are compared.

Posting lists are never turned into all their pairs at once.  Star rounds compare
each member with one pivot; what links is one component, and only pairs between
different components are left for the last round.  So a family of k near copies
costs k comparisons, and components are still exact, since every pair that a
prefix admits is compared or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.batches import ending, only
from folioforge.llm.components import components
from folioforge.llm.digest_index import join_by_digest
from folioforge.llm.shingles import digest, sets_of
from folioforge.llm.storage import discard, release, staged

#: A similarity of NUM / DEN or more links.
NUM, DEN = 75, 100
COMMON = 1 << 62
#: Columns that name a group.
GROUP = ["g", "g2"]
#: Size of the summary of common tokens that is sent to every task, and the count from which a token is common.
SUMMARY, COMMON_FROM = 1 << 16, 24
#: Star rounds look only at pairs that share this part of a prefix: those are likely links.  The last round looks at all.
LIKELY = 0.25
#: Members of a posting list that one task of the last round holds; a longer list is cut into blocks that meet two by two.
BLOCK = 2048
#: Documents of a common token from which its posting list is dealt out over tasks, and not sorted in one.
LONG_LIST = 1 << 17
#: Pairs that are made at once.
PAIRS = 1 << 18


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """How many first tokens of a set of ``n`` suffice to meet every set that links with it."""
    return n - -(-n * NUM // DEN) + 1


def common_tokens(docs: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Tokens that occur in many documents, by a summary that every document enters, and those of them with long lists.

    A task counts its tokens in blocks and passes on those that it met twice or
    more in a block, the most frequent ``SUMMARY`` of them; counts are added and
    the ``SUMMARY`` largest kept.  They decide the order of tokens, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            if len(n) > SUMMARY:
                top = np.argpartition(n, -SUMMARY)[-SUMMARY:]
                token, n = token[top], n[top]
            return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

        for _, sets in sets_of(batches):
            held += sets
            size += sum(map(len, sets))
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(ending(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "token").limit(SUMMARY).collect()
    return np.sort(np.array([r["token"] for r in top], np.int64)), [r["token"] + COMMON for r in top if r["n"] > LONG_LIST]


def members_of(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Class, group and prefix of each document: ``id, mark, n, digest, g, g2, last, light, prefix``; a task gives a group's prefix once.

    ``g, g2``: the 128 bits that name a group; ``last``: last token of the prefix;
    ``light``: how many of its tokens are not common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b, sets in sets_of(batches):
            n, marks, groups, lasts, lights, prefixes = [], [], [], [], [], []
            for s in sets:
                n.append(len(s))
                if not len(s):
                    marks.append(None)
                    groups.append(None)
                    lasts.append(None)
                    lights.append(None)
                    prefixes.append(None)
                    continue
                key = s.astype(np.int64)
                if len(common):
                    spot = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    late = common[spot] == key
                    if late.any():
                        key = np.concatenate([key[~late], key[late] + COMMON])
                head = key[: prefix_length(len(s))]
                name = hashlib.blake2b(head.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest()
                marks.append(digest(s))
                groups.append(name)
                lasts.append(int(head[-1]))
                lights.append(int(np.searchsorted(head, COMMON)))
                prefixes.append(None if name in seen else head)
                seen.add(name)
            void = pa.array([x is None for x in groups], pa.bool_())
            halves = np.frombuffer(b"".join(x or bytes(16) for x in groups), "<i8").reshape(-1, 2)
            g, g2 = (pc.if_else(void, pa.scalar(None, pa.int64()), pa.array(halves[:, k])) for k in range(2))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("mark"), pa.array(n, pa.int32()), pa.array(marks, pa.binary()), g, g2, pa.array(lasts, pa.int64()), pa.array(lights, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["id", "mark", "n", "digest", "g", "g2", "last", "light", "prefix"],
            )

    return docs.mapInArrow(ending(run), f"id {docs.schema['id'].dataType.simpleString()}, mark string, n int, digest binary, g long, g2 long, last long, light int, prefix array<long>")


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def long_runs(banded: DataFrame) -> DataFrame:
    """What :func:`shared_runs` makes, by aggregates: no task has a whole list, but for one row of each of its bands."""
    rows = banded.dropDuplicates(["token", *GROUP])
    bands = rows.groupBy("token", "band").agg(F.min(F.struct("info", *GROUP)).alias("lead"), F.count("*").alias("k"))
    many = bands.groupBy("token").agg(F.sum("k").alias("k")).filter("k > 1").select("token")
    leads = bands.join(many, "token", "left_semi").select("token", "band", F.col("lead.g").alias("pivot"), F.col("lead.g2").alias("pivot2"))
    return rows.join(leads, ["token", "band"]).select("token", F.col("n").cast("long").alias("n"), *GROUP, "info", "pivot", "pivot2")


def shared_runs(postings: DataFrame, long_lists: Sequence[int] = ()) -> DataFrame:
    """Posting lists of two groups or more, repeats of a group dropped: ``token, n, g, g2, info, pivot, pivot2``.

    A member's pivot is, of the members of its list in its band of sizes, the one
    with the fewest tokens that are not common: in a family of near copies that is
    the one the others were made from, or near to it.  A list is sorted in one task,
    but for those of the tokens ``long_lists``, ``SUMMARY`` of them at most.
    """
    names = ["token", "n", "g", "g2", "info", "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the last row, whose list may go on
        joined = False  # its list has an earlier row
        pivot = (-1, -1, 0, 0)  # of the last row before it: token, band and group that leads the band
        for b in _then_end(batches):
            t, n, g, g2, info, band = (np.empty(0, np.int64),) * 6 if b is None else _columns(b, *names)
            if held is not None:
                t, n, g, g2, info, band = (np.concatenate([[h], x]) for h, x in zip(held, (t, n, g, g2, info, band), strict=True))
            if not len(t):
                continue
            keep = np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (g2[1:] != g2[:-1]))
            t, n, g, g2, info, band = t[keep], n[keep], g[keep], g2[keep], info[keep], band[keep]
            same = t[1:] == t[:-1]
            after, before = np.append(same, False), np.append(joined, same)
            begins = np.append(True, ~same | (band[1:] != band[:-1]))
            if joined and pivot[:2] == (t[0], band[0]):
                begins[0] = False
            first = np.maximum.accumulate(np.where(begins, np.arange(len(t)), -1))
            lead, lead2 = (np.where(first < 0, old, x[np.maximum(first, 0)]) for old, x in ((pivot[2], g), (pivot[3], g2)))
            done = len(t) if b is None else len(t) - 1
            out = np.flatnonzero((after | before)[:done])
            if done:
                pivot = (t[done - 1], band[done - 1], lead[done - 1], lead2[done - 1])
            held, joined = (t[-1], n[-1], g[-1], g2[-1], info[-1], band[-1]), bool(before[-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out].astype(np.int64)) for x in (t, n, g, g2, info, lead, lead2)], ["token", "n", "g", "g2", "info", "pivot", "pivot2"])

    banded = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int"))
    dealt = None
    if long_lists:
        listed = F.broadcast(postings.sparkSession.createDataFrame([(t,) for t in long_lists], "token long"))
        dealt, banded = long_runs(banded.join(listed, "token", "left_semi")), banded.join(listed, "token", "left_anti")
    sorted_ = banded.repartition("token").sortWithinPartitions("token", "band", "info", "g", "g2").select(*names)
    out = sorted_.mapInArrow(ending(run), "token long, n long, g long, g2 long, info long, pivot long, pivot2 long")
    return out if dealt is None else out.unionByName(dealt)


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def in_cells(runs: DataFrame, block: int | None = None) -> DataFrame:
    """Members of posting lists with more than one label, each with the cells in which it meets others: ``cell, own`` are added.

    A list is cut into blocks of about ``block`` members, and two blocks meet in a
    cell; ``own``: the cell of a block with itself.  A label with more members than
    a block has blocks of its own, which do not meet one another, so a large
    component costs nothing but its meetings with the others.
    """
    block = block or BLOCK
    kinds = runs.groupBy("token", "label").agg(F.count("*").alias("k"))
    parts = F.ceil(F.col("k") / block).cast("int")
    large = F.col("k") > block
    lists = kinds.groupBy("token").agg(F.count("*").alias("labels"), F.sum(F.when(large, 0).otherwise(F.col("k"))).alias("few"), F.sum(F.when(large, parts).otherwise(0)).alias("more")).filter("labels > 1")
    lists = lists.select("token", F.ceil(F.col("few") / block).cast("int").alias("blocks"), F.col("more").cast("int").alias("more"))
    before = Window.partitionBy("token").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # one row for each ``block`` members at most
    own = kinds.filter(large).select("token", "label", parts.alias("parts"), F.coalesce(F.sum(parts).over(before), F.lit(0)).cast("int").alias("at"))
    rows = runs.join(lists, "token").join(own, ["token", "label"], "left").withColumn("total", F.col("blocks") + F.col("more"))
    rows = rows.withColumns({"low": F.coalesce(F.col("blocks") + F.col("at"), F.lit(0)), "width": F.coalesce("parts", F.lit(0))})
    place = F.pmod(F.xxhash64("g", "g2"), F.coalesce("parts", "blocks")).cast("int")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    others = F.concat(span(F.lit(0), F.col("low")), span(F.col("low") + F.col("width"), F.col("total")))
    rows = rows.withColumns({"block": F.col("low") + place, "other": F.explode(others)})
    cell = F.least("block", "other").cast("long") * F.col("total") + F.greatest("block", "other")
    return rows.select("token", cell.alias("cell"), "label", "n", "g", "g2", "last", "info", "block", (F.col("block") == F.col("other")).alias("own"))


def open_pairs(runs: DataFrame) -> DataFrame:
    """Pairs of groups in a posting list whose labels differ: ``a, a2, b, b2, na, nb, rest, light``, once for each list.

    ``light``: 1 in the list of a token that is not common; all these meet, so
    their number is what the prefixes share of such tokens.  ``rest``: what the
    sets can share besides.  In the list of a common token, which comes last in
    the order, a pair is made only if that token can be the first that the two
    share: what is left of both sets from there must suffice.
    """
    names = ["token", "cell", "label", "n", "g", "g2", "last", "info", "block", "own"]

    def made(t: np.ndarray, n: np.ndarray, g: np.ndarray, g2: np.ndarray, last: np.ndarray, info: np.ndarray, block: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        late, left = t >= COMMON, n - (info & 0xFFFFFFFF)
        past = n - (info >> 32)  # tokens that are not among the prefix's light ones
        ok = (own[i] | (block[i] != block[j])) & (n[j] * DEN >= n[i] * NUM) & (n[i] * DEN >= n[j] * NUM)
        ok &= ~late[i] | ((NUM + DEN) * np.minimum(left[j], left[i]) >= NUM * (n[j] + n[i]))
        i, j = i[ok], j[ok]
        both = (last[j] >= COMMON) & (last[i] >= COMMON)
        rest = np.where(both, np.minimum(past[j], past[i]), np.where(last[j] < last[i], past[j], past[i]))
        swap = (g[j] < g[i]) | ((g[j] == g[i]) & (g2[j] < g2[i]))
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (g[a], g2[a], g[b], g2[b], n[a], n[b], rest, ~late[i])], ["a", "a2", "b", "b2", "na", "nb", "rest", "light"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # rows of a cell that has not ended
        for b in _then_end(batches):
            if b is not None and b.num_rows:
                now = _columns(b, *names)
                t, c = now[:2]
                turn = np.flatnonzero((t[1:] != t[:-1]) | (c[1:] != c[:-1])) + 1
                if not len(turn) and parts and (parts[-1][0][-1], parts[-1][1][-1]) == (t[0], c[0]):
                    parts.append(now)
                    continue
                stop = int(turn[-1]) if len(turn) else 0
                whole = [*parts, [x[:stop] for x in now]]
                parts = [[x[stop:] for x in now]]
            elif b is None:
                whole, parts = parts, []
            else:
                continue
            if not whole:
                continue
            t, c, label, *rest = (np.concatenate(x) for x in zip(*whole, strict=True))
            size = len(t)
            if size < 2:
                continue
            other = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            ends = np.append(np.flatnonzero(other) + 1, size)
            own_ends = np.append(np.flatnonzero(other | (label[1:] != label[:-1])) + 1, size)
            at = np.arange(size)
            stop, begin = ends[np.searchsorted(ends, at, side="right")], own_ends[np.searchsorted(own_ends, at, side="right")]
            many = stop - begin  # those behind a member in its cell that have another label
            upto = np.cumsum(many)
            first = 0
            while first < size:
                past = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
                m = many[first:past]
                if m.any():
                    i = np.repeat(at[first:past], m)
                    j = np.repeat(begin[first:past] - (np.cumsum(m) - m), m) + np.arange(len(i))
                    pairs = made(t, *rest, i, j)
                    if pairs.num_rows:
                        yield pairs
                first = past

    sorted_ = in_cells(runs).repartition("token", "cell").sortWithinPartitions("token", "cell", "label").select(*names)
    return sorted_.mapInArrow(ending(run), "a long, a2 long, b long, b2 long, na long, nb long, rest long, light long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the class pairs (u, v) those whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("su"), b.column("sv"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(mask), b.column("v").filter(mask)], ["u", "v"])

    left, right = (sets.select(F.col("cid").alias(x), F.col("tokens").alias(f"s{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(ending(run), "u long, v long")


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cid, tokens`` of the rows whose text has the set that ``digest`` names; other texts of an identifier are left out."""
    done: set[int] = set()  # rows of an identifier are in one task: of those that repeat a text the first serves
    for b, sets in sets_of(batches):
        keep = []
        for cid, k, s in zip(b.column("cid").to_pylist(), b.column("digest").to_pylist(), sets, strict=True):
            if cid not in done and digest(s) == k:
                done.add(cid)
                keep.append((cid, s.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int64()), pa.array([s for _, s in keep], pa.binary())], ["cid", "tokens"])


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2) -> DataFrame:
    """Components of documents linked by a similarity of 0.75 or more of their distinct five-word shingles.

    Returns one row per document: ``id_col, n_shingles, component_id`` (smallest
    identifier reachable).  Identifiers are integers.  A null text or one without
    words has an empty set and is linked with nothing; a text of fewer than five
    words is one shingle.  Copies are one class, however many; repeated rows are
    copies.  A null identifier is never a component's, but its text links others;
    if a component has no other identifier, its ``component_id`` is null.  No
    documents give no rows.  ``star_rounds``, one at least, decides cost and never
    the result.
    """
    if star_rounds < 1:
        raise ValueError("one star round at least")
    spark = docs.sparkSession
    given = only(docs, id=id_col, text=text_col)
    given = given.withColumn("mark", F.when(F.col("id").isNull(), F.md5("text")))
    common, long_lists = common_tokens(given)
    members = staged(members_of(given, common), "members")
    # a class is numbered where it is written: numbers are exact names, and short
    classes = members.filter("n > 0").groupBy("digest", *GROUP, "n", "last").agg(F.min("id").alias("rep"), F.count("*").alias("group_size"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    postings = members.filter("prefix IS NOT NULL").select(F.posexplode("prefix").alias("at", "token"), "n", *GROUP, "light")
    postings = postings.select("token", "n", *GROUP, F.shiftleft(F.col("light").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("info"))
    runs = staged(shared_runs(postings, long_lists), "runs")
    with_prefix, members = members, staged(members.select("id", "mark", "n", "digest"), "members")
    discard(with_prefix)
    release(spark)
    met = runs.select(*GROUP).union(classes.groupBy(*GROUP).count().filter("count > 1").select(*GROUP)).distinct()
    crowd = staged(classes.join(met, GROUP, "left_semi"), "crowd")
    leads = staged(crowd.groupBy(*GROUP).agg(F.min("cid").alias("lead"), F.count("*").alias("k")), "leads")
    # classes that only rows without an identifier hold are found by the digest of their text
    unnamed = staged(crowd.filter("rep IS NULL").select("digest", "cid").join(members.filter("id IS NULL AND n > 0").select("digest", "mark"), "digest").groupBy("cid", "digest").agg(F.min("mark").alias("mark")), "unnamed")
    anonymous = not unnamed.isEmpty()
    release(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        """Fetch the sets of the classes in ``pairs`` and compare them whole."""
        pairs = staged(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        asked = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
        who = crowd.filter("rep IS NOT NULL").join(asked, "cid", "left_semi").select(F.col("rep").alias("id"), "cid", "digest")
        texts = given.join(who, "id").select("cid", "digest", "text")
        if anonymous:
            one_each = given.filter("id IS NULL").select("mark", "text").dropDuplicates(["mark"])
            texts = texts.union(one_each.join(unnamed.join(asked, "cid", "left_semi"), "mark").select("cid", "digest", "text"))
        sets = staged(texts.mapInArrow(ending(tokens_of), "cid long, tokens binary"), "sets")
        release(spark)
        out = staged(_linked(pairs, sets), "links")
        discard(pairs, sets)
        release(spark)
        return out

    def by_lead(pairs: DataFrame, one: list[str], two: list[str]) -> DataFrame:
        for at, x in ((one, "u"), (two, "v")):
            pairs = pairs.join(leads.select(*(F.col(g).alias(c) for g, c in zip(GROUP, at, strict=True)), F.col("lead").alias(x)), at)
        return pairs.select("u", "v")

    inside = crowd.join(leads.filter("k > 1"), GROUP).filter(F.col("cid") != F.col("lead")).select(F.col("lead").alias("u"), F.col("cid").alias("v"))
    pivots, seconds = ["pivot", "pivot2"], ["second", "second2"]
    labels = None  # node, label of all classes linked so far
    for turn in range(star_rounds + 1):
        if labels is not None:
            named = crowd.select(*GROUP, "cid", "n", "last").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
            named = staged(named.withColumn("label", F.coalesce("label", "cid")), "named")
            kinds = named.groupBy(*GROUP).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("cid").alias("lead"), F.min("last").alias("last"))
            # a group of several components has a label of its own
            mixed = F.col("low") != F.col("high")
            kinds = staged(kinds.select(*GROUP, F.when(mixed, -1 - F.col("lead")).otherwise(F.col("low")).alias("label"), mixed.alias("mixed"), "last"), "kinds")
        likely = F.col("count") >= LIKELY * (F.col("n") - F.ceil(F.col("n") * (NUM / DEN)) + 1)
        if turn == 0:
            pairs = runs.filter("pivot != g OR pivot2 != g2").groupBy(*pivots, *GROUP, "n").count().filter(likely)
            pairs = inside.union(by_lead(pairs, pivots, GROUP))
        elif turn < star_rounds:
            # another pivot: of the members outside the first one's component again that with the fewest tokens that are not common
            mine = kinds.select(*GROUP, F.col("label").alias("own_label"))
            first = kinds.select(*(F.col(g).alias(p) for g, p in zip(GROUP, pivots, strict=True)), F.col("label").alias("pivot_label"))
            # kept apart from the aggregate, which would hold a pivot's rows in one task
            apart = staged(runs.join(mine, GROUP).join(first, pivots).filter("own_label != pivot_label").drop("pivot_label"), "apart")
            release(spark)
            second = apart.groupBy("token", *pivots).agg(F.min(F.struct("info", "own_label", *GROUP)).alias("s"))
            second = second.select("token", *pivots, F.col("s.own_label").alias("second_label"), *(F.col(f"s.{g}").alias(x) for g, x in zip(GROUP, seconds, strict=True)))
            pairs = apart.join(second, ["token", *pivots]).filter("own_label != second_label")
            pairs = by_lead(pairs.groupBy(*seconds, *GROUP, "n").count().filter(likely), seconds, GROUP)
        else:
            pairs = open_pairs(runs.join(kinds, GROUP)).groupBy("a", "a2", "b", "b2", "na", "nb", "rest").agg(F.sum("light").alias("light"))
            pairs = pairs.filter((NUM + DEN) * (F.col("light") + F.col("rest")) >= NUM * (F.col("na") + F.col("nb"))).select("a", "a2", "b", "b2")
            same = kinds.filter("mixed")
            pairs = pairs.union(same.select(*GROUP, *GROUP))
            for at, x in ((["a", "a2"], "u"), (["b", "b2"], "v")):
                pairs = pairs.join(named.select(*(F.col(g).alias(c) for g, c in zip(GROUP, at, strict=True)), F.col("cid").alias(x), F.col("label").alias(f"{x}_label")), at)
            pairs = pairs.filter("u_label != v_label").select("u", "v")
        new = linked(pairs)
        before, labels = labels, staged(components(new if labels is None else new.union(labels.select("node", "label"))), "labels")
        discard(new, *(() if before is None else (before, named, kinds)), *((apart,) if 0 < turn < star_rounds else ()))
        release(spark)
    discard(runs, crowd, leads, unnamed)
    known = labels.select(F.col("node").alias("cid"), "label").join(classes.select("cid", "rep"), "cid")
    heads = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = known.join(heads, "label").select("cid", "component_id")
    whole = staged(classes.join(placed, "cid", "left").select("digest", "group_size", F.coalesce("component_id", "rep").alias("component_id")), "placed")
    rows = members.select("id", F.col("n").cast("long").alias("n_shingles"), "digest")
    some = join_by_digest(rows.filter("n_shingles > 0"), whole, rows.count()).select("id", "n_shingles", "component_id")
    none = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return some.union(none).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the document of the smallest identifier of each component, all columns kept.

    Rows that share an identifier go or stay together; a row without one can't
    be named and stays.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone.hint("shuffle_hash"), id_col, "left_anti").select(*docs.columns)
