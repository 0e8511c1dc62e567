"""Files that tasks write and read in the shared folder, through the file system its URI names."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI: local, hdfs, s3, gs and whatever else pyarrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def normal(uri: str) -> str:
    """``file:/a`` as ``file:///a``."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class ShardWriter:
    """Writes a task's output to files of about ``limit`` bytes with names that no other attempt uses.

    What a failed attempt leaves is never referred to: readers take names from
    the rows that the successful attempt returned.
    """

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.base = open_fs(normal(folder))
        self.fs.create_dir(self.base, recursive=True)
        self.suffix, self.limit = suffix, limit
        self.stream, self.name, self.at = None, "", 0

    def room(self) -> None:
        """Called between records: opens a file if there is none or the last is full."""
        if self.stream is not None and self.at >= self.limit:
            self.close()
        if self.stream is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.stream, self.at = self.fs.open_output_stream(posixpath.join(self.base, self.name), compression=None), 0

    def write(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.at += len(data)

    def close(self, last: bytes = b"") -> None:
        if self.stream is not None:
            self.write(last)
            self.stream.close()
            self.stream = None
