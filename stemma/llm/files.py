"""Plain files in the shared folder, read and written by executors through Arrow's file systems."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs


def system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a URI (file, hdfs, s3, gs) or of a plain local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete, so that a retried task can write it again."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = system(uri)
        self.tmp = f"{self.path}.{attempt}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.tmp, compression=None)

    def write(self, data) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped on a mounted file system, read through otherwise."""
    where, path = system(uri)
    if isinstance(where, fs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype) if f.size() else np.empty(0, dtype)


def table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A record batch from named arrays."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: Rows of a few numbers in one batch that goes back to the JVM, which holds a batch as a whole, outside its heap.
MOST_ROWS = 1 << 16


def tables(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """As table, in batches of at most MOST_ROWS rows; none where there are no rows."""
    whole = table(columns)
    for lo in range(0, whole.num_rows, MOST_ROWS):
        yield whole.slice(lo, MOST_ROWS)
