"""WARC archives through a chunked record table.

A payload travels as rows of record identifier and chunk number, which the writer
streams into a record and the reader makes again from an archive; no Python worker
holds it whole.  A record's header states the payload's SHA-256 before the payload,
so that one is taken from the input row.  Writer and reader both keep up a digest of
their own chunk by chunk, and a payload that does not match its header raises.
The reader's chunk rows carry the running CRC-32 and length, the last the SHA-256.
"""

from __future__ import annotations

import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.batches import ending, only
from folioforge.llm.digest_index import HOT_SHARE
from folioforge.llm.shards import ShardWriter, normal, open_fs
from folioforge.llm.storage import fresh_path, staged

CHUNK = 64 << 10
ARCHIVE_BYTES = 128 << 20
#: Payloads below this are always stored.
LEAST_REVISIT = 100
#: Fixed value: profile of a revisit whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``id, payload, n_bytes, digest, refers_to``: which records are stored and which revisit another.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the smallest
    identifier is stored; ``refers_to`` is null for it.  A null payload is empty.
    Rows that repeat an identifier and a payload are stored each.  Null
    identifiers come last.
    """
    rows = only(pages, id=id_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"").cast("binary")))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = staged(groups, "payload-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col("group_size") > limit).select(F.col("digest").alias("hot_digest"), F.col("first_id").alias("hot_id")))
    cold = groups.filter(F.col("group_size") <= limit).select(F.col("digest").alias("cold_digest"), F.col("first_id").alias("cold_id"))
    rows = rows.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    # rows of a hot group look for nothing, each in a place of its own
    rows = rows.withColumn("look", F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string"))))
    rows = rows.join(cold, F.col("look") == F.col("cold_digest"), "left").withColumn("first_id", F.coalesce("hot_id", "cold_id"))
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("id")), F.col("first_id"))
    return rows.select("id", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as chunk rows, in order: ``id, n_bytes, digest, refers_to, chunk_no, last, data``.  A revisit has one empty chunk."""
    stored = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil(stored / chunk) - 1).cast("int")
    rows = records.withColumn("last_no", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_no"))))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"").cast("binary"))
    return rows.select("id", "n_bytes", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"), data.alias("data"))


def head(record: str, n_bytes: int, stored: int, digest: str, refers_to: str | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{record}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {stored}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode()


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records as gzip members of WARC files in ``folder``: ``archive, n_records, n_bytes`` for each file.

    The list is kept in the shared folder, so that reading it does not write again.
    Chunks that do not add up to what their row states raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, count, z = ShardWriter(folder, ".warc.gz", archive_bytes), [], 0, None
        sha, size = hashlib.sha256(), 0
        for b in batches:
            for r in b.to_pylist():
                if z is None:
                    if out.stream is not None and out.at >= out.limit:
                        done.append((out.name, count, out.at))
                        count = 0
                    out.room()
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    sha, size = hashlib.sha256(), 0
                    stored = r["n_bytes"] if r["refers_to"] is None else 0
                    out.write(z.compress(head(str(r["id"]), r["n_bytes"], stored, r["digest"], None if r["refers_to"] is None else str(r["refers_to"]))))
                out.write(z.compress(r["data"]))
                sha.update(r["data"])
                size += len(r["data"])
                if r["last"]:
                    if r["refers_to"] is None and (size, sha.hexdigest()) != (r["n_bytes"], r["digest"]):
                        raise ValueError(f"the chunks of record {r['id']} are not its payload")
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    z, count = None, count + 1
        if out.stream is not None:
            done.append((out.name, count, out.at))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    return staged(chunked(records).mapInArrow(ending(run), "archive string, n_records long, n_bytes long"), "archives")


class Stream:
    """Decompressed bytes of an archive, a bounded piece at a time."""

    def __init__(self, raw, step: int = CHUNK):
        self.raw, self.step, self.z, self.left, self.data = raw, step, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
            source = self.left or self.raw.read(self.step)
            if not source:
                return False
            self.data += self.z.decompress(source, self.step)
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left = b""
            if self.data:
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.data:
            if not self.more():
                return None
        got, _, self.data = self.data.partition(mark)
        return got

    def take(self, n: int) -> bytes:
        """At least one and at most n bytes."""
        if not self.data and not self.more():
            raise EOFError("the archive ends within a record")
        got, self.data = self.data[:n], self.data[n:]
        return got


def records_in(raw, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and payload chunks of each record, all but the last of ``chunk`` bytes."""
    s = Stream(raw)
    while (block := s.until(b"\r\n\r\n")) is not None:
        version, *lines = block.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        left = [int(fields["Content-Length"])]

        def body(left: list[int] = left) -> Iterator[bytes]:
            while left[0]:
                want, got = min(left[0], chunk), b""
                while len(got) < want:
                    got += s.take(want - len(got))
                left[0] -= want
                yield got

        yield fields, body()
        for _ in body():
            pass
        if s.until(b"\r\n\r\n") != b"":
            raise ValueError("a record is not followed by two line ends")
    if s.data:
        raise ValueError("the archive ends within a header")


CHUNK_ROWS = "record_id string, chunk_no int, last boolean, bytes_so_far long, crc32_so_far long, payload_digest string, record_type string, refers_to string, payload_bytes long"


def read(archives: DataFrame, folder: str, *, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records of the listed archives, with ``data binary`` if ``payload``.

    The last row of a record has the SHA-256 of its payload, computed over the
    chunks; for a revisit, which stores none, digest and length come from its
    headers.  A stored payload that does not match its header raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([*kinds, *[pa.binary()] * payload])]
            return pa.RecordBatch.from_arrays(columns, [*names, *["data"] * payload])

        fs, base = open_fs(normal(folder))
        for b in batches:
            for name in b.column("archive").to_pylist():
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as raw:
                    for fields, body in records_in(raw, chunk):
                        sha, crc, size, no = hashlib.sha256(), 0, 0, 0
                        record = fields["WARC-Record-ID"][len("<urn:record:") : -1]
                        refers = fields.get("WARC-Refers-To")
                        refers = refers and refers[len("<urn:record:") : -1]
                        length, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        part, total = b"", int(fields["Content-Length"])
                        for part in body:
                            sha.update(part)
                            crc, size = zlib.crc32(part, crc), size + len(part)
                            if size < total:
                                rows.append((record, no, False, size, crc, None, fields["WARC-Type"], refers, length, *[part] * payload))
                                no, held = no + 1, held + len(part)
                                if held > 8 << 20 or len(rows) >= 4096:
                                    yield flush()
                                    rows.clear()
                                    held = 0
                        if refers is None and (size, sha.hexdigest()) != (length, digest):
                            raise ValueError(f"record {record} is damaged")
                        rows.append((record, no, True, size, crc, digest if refers is not None else sha.hexdigest(), fields["WARC-Type"], refers, length, *[part] * payload))
                        held += len(part)
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield flush()
                            rows.clear()
                            held = 0
        yield flush()

    # one task for each archive; a number that is given is not coalesced, small as the list is
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(ending(run), CHUNK_ROWS + ", data binary" * payload)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Write every page; the list of archives and their folder."""
    folder = fresh_path(pages.sparkSession, "warc")
    return write(plan_records(pages, id_col=id_col, payload_col=payload_col), folder), folder
