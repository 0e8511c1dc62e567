"""Media columns: payloads by content address in tar shards.

A task writes its payloads as grey PNG images into tar shards in the shared
folder, and returns rows of digest, shard, offset and length.  Of the copies that
several tasks have written one place is chosen for each digest, so that equal
payloads have one address.  Metadata columns are filled by range reads of the
headers of the images alone; samples are read only where features are asked for,
once for each image.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from folioforge.llm.batches import as_list, ending, only, pieces
from folioforge.llm.digest_index import join_by_digest
from folioforge.llm.shards import ShardWriter, normal, open_fs
from folioforge.llm.storage import fresh_path, staged

#: Samples of an image row, which the padded payload is a multiple of.
WIDTH = 576
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of signature and IHDR.
HEAD = 33
#: Bytes of the tail that has a checksum of its own.
TAIL = 32
#: Digests that a writing task remembers.
REMEMBERED = 200_000


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % WIDTH if data else WIDTH)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of rows of ``WIDTH`` samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _part(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first ``HEAD`` bytes."""
    if len(head) < HEAD or head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> np.ndarray:
    """Samples of an unfiltered grey image as rows."""
    width, height, _ = png_size(data)
    at, z = 8, zlib.decompressobj()
    out = []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            out.append(z.decompress(data[at + 8 : at + 8 + n]))
        at += 12 + n
    lines = np.frombuffer(b"".join(out), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:]


def tar_entry(name: str, data: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store each text's payload and return ``id, n_bytes, media_sha256, shard, offset, media_bytes``.

    A null text is empty; the payload of an empty text is one row of padding.
    Equal payloads that a task meets are stored once, as far as it remembers:
    ``REMEMBERED`` of them.  Another task may store them again in its own shard,
    under the same name; see :func:`places`.  The rows are kept in the shared
    folder, so that reading them does not write again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = ShardWriter(folder, ".tar", shard_bytes), {}
        for whole in batches:
            for b in pieces(whole, "text"):
                rows = []
                for data in as_list(b.column("text")):
                    key = hashlib.sha256(data).digest()
                    if key not in place:
                        media = to_png(padded(data))
                        digest = hashlib.sha256(media).hexdigest()
                        if out.stream is not None and out.at >= out.limit:
                            out.close(b"\0" * 1024)
                        out.room()
                        if len(place) >= REMEMBERED:
                            place.clear()
                        place[key] = (digest, out.name, out.at + tarfile.BLOCKSIZE, len(media))
                        out.write(tar_entry(f"{digest[:2]}/{digest}.png", media))
                    rows.append((len(data), *place[key]))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["id", "n_bytes", "media_sha256", "shard", "offset", "media_bytes"])
        out.close(b"\0" * 1024)

    given = only(docs, id=id_col, text=text_col)
    kind = given.schema["id"].dataType.simpleString()
    return staged(given.mapInArrow(ending(run), f"id {kind}, n_bytes long, media_sha256 string, shard string, offset long, media_bytes long"), "media")


def places(media: DataFrame) -> DataFrame:
    """One place of each image of :func:`store`, the first by shard and offset: ``media_sha256, shard, offset, media_bytes, copies``.

    Rows are dealt out in the order of the shards, so that a task reads few of them from front to back.
    """
    first = F.min(F.struct("shard", "offset", "media_bytes")).alias("at")
    chosen = media.groupBy("media_sha256").agg(first, F.count("*").alias("copies")).select("media_sha256", "at.*", "copies")
    parts = max(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), media.select("shard").distinct().count())
    return chosen.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


class _Ranges:
    """Range reads of shards, one open at a time."""

    def __init__(self, folder: str):
        self.fs, self.base = open_fs(normal(folder))
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(posixpath.join(self.base, shard))
        return self.file.read_at(length, offset)


def metadata(images: DataFrame, folder: str) -> DataFrame:
    """``images``, rows with ``shard`` and ``offset``, with ``width, height, bits`` from range reads of the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for b in batches:
            sizes = [png_size(ranges.read(s, o, HEAD)) for s, o in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in sizes], pa.int32()) for k in range(3))], [*b.schema.names, "width", "height", "bits"])

    spec = StructType([*images.schema.fields, *(StructField(c, IntegerType()) for c in ("width", "height", "bits"))])
    return images.mapInArrow(ending(run), spec)


def features(images: DataFrame, folder: str) -> DataFrame:
    """``images``, rows with ``media_sha256, shard, offset, media_bytes``, read back whole: ``payload_bytes, payload_sha256, tail_crc32, feature`` are added.

    Bytes that do not have their digest raise.
    """

    def one(data: bytes, digest: str) -> tuple:
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"media {digest} is damaged")
        width, height, bits = png_size(data[:HEAD])
        rows = from_png(data)
        raw = rows.tobytes()
        n = np.bincount(rows.ravel(), minlength=256)
        p = n[n > 0] / len(raw)
        mean = float(n @ np.arange(256)) / len(raw)
        feature = f"gray{bits} {width}x{height} mean={mean:.4f} entropy={float(-(p * np.log2(p)).sum()):.4f} levels={int((n > 0).sum())}"
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-TAIL:]), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, kinds = _Ranges(folder), (pa.int64(), pa.string(), pa.int64(), pa.string())
        for b in batches:
            rows = [one(ranges.read(s, o, n), d) for d, s, o, n in zip(*(b.column(c).to_pylist() for c in ("media_sha256", "shard", "offset", "media_bytes")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*b.schema.names, *(f.name for f in added)])

    added = [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("feature", StringType())]
    return images.mapInArrow(ending(run), StructType([*images.schema.fields, *added]))


def store_and_read(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's payload and fill its media columns from what was stored; one row per input row.

    ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, shard, offset, width, height, bits``.  Equal texts have
    equal values, place included.  Null texts are empty; null and repeated
    identifiers pass through; no rows give none.
    """
    folder = fresh_path(docs.sparkSession, "media-shards")
    media = store(docs, folder, id_col=id_col, text_col=text_col)
    images = staged(features(metadata(places(media), folder), folder), "images")
    rows = media.select("id", "n_bytes", "media_sha256")
    out = join_by_digest(rows, images, rows.count(), key="media_sha256", size="copies")
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "bits"]
    return out.select(F.col("id").alias(id_col), *columns)
