"""Arrays in files of the shared folder, which workers map into memory."""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import give_back
from tessera.sources.shared import cut, release


def least(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def write_level(folder: str, arrays: dict[str, np.ndarray], name: str = "") -> str:
    """Arrays in one file of the shared folder, which appears whole or not at all; its URI."""
    head, blobs, at = {}, [], 0
    for array, x in arrays.items():
        blob = np.ascontiguousarray(x).tobytes()
        head[array] = [at, x.dtype.str, len(x)]
        blobs += [blob, bytes(-len(blob) % 8)]
        at += len(blob) + (-len(blob) % 8)
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text + bytes(-len(text) % 8)
    uri = f"{folder}/{name or uuid.uuid4().hex}"
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        with open(where.path + ".part", "wb") as f:
            f.writelines([text, *blobs])
        os.replace(where.path + ".part", where.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as f:
            f.write(b"".join([text, *blobs]))
    return uri


def map_level(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is copied to an unnamed local one first."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        with open(where.path, "rb") as f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        import shutil
        import tempfile

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
            shutil.copyfileobj(source, f)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(m[:8], "little")
    base = 8 + n + (-n % 8)
    return {k: np.frombuffer(m, np.dtype(t), size, base + at) for k, (at, t, size) in json.loads(m[8 : 8 + n]).items()}


class SortedSets:
    """Sets of 64-bit numbers in sorted files, one for each of ``n`` ranges of the upper 32 bits.

    A file may hold only the lower 32 bits of its numbers.
    """

    def __init__(self, paths: dict[int, str], n: int):
        self.paths, self.n, self.opened = paths, n, {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    @staticmethod
    def write(numbers: DataFrame, folder: str, room: int = 2_000_000) -> SortedSets:
        """Files of the distinct numbers (key: long) of a table, about ``room`` in each."""
        numbers = cut(numbers, "sorted-sets")
        n = 1 + numbers.count() // room

        def build(key: tuple, group: pa.Table) -> pa.Table:
            path = write_level(folder, {"key": np.unique(group.column("key").to_numpy().view(np.uint64))})
            return pa.Table.from_pydict({"s": [key[0].as_py()], "path": [path]})

        deal = F.shiftright(F.shiftrightunsigned("key", 32) * n, 32).alias("s")
        built = numbers.select("key", deal).groupBy("s").applyInArrow(build, "s long, path string")
        out = SortedSets({r.s: r.path for r in built.collect()}, n)
        release(numbers.sparkSession, numbers)
        return out

    def contains(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for s, own in by_range(x, self.n) if self.paths else ():
            if s not in self.paths:
                continue
            if s not in self.opened:
                self.opened[s] = map_level(self.paths[s])["key"]
            known = self.opened[s]
            if len(known):
                asked = x[own].astype(known.dtype)
                out[own] = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        return out


def split_ranges(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` ranges of the upper 32 bits begins in sorted numbers, and the end."""
    return np.searchsorted((numbers >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def by_range(numbers: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of ``n`` ranges of the upper 32 bits that has some of the numbers, and their places: one sort, however many ranges."""
    order = np.argsort(numbers)
    cuts = split_ranges(numbers[order], n)
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def binary_rows(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of an array, one row from each cut to the next."""
    offsets = (cuts * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def repeated_numbers(rows: DataFrame, numbers: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], n: int, folder: str, room: int = 1_500_000) -> SortedSets:
    """The numbers that occur twice or more among the arrays that ``numbers`` makes of a task's batches.

    They are told apart by range (of ``n``) and lower 32 bits, so that a few others
    slip in. A task sends each number twice at most, four bytes each time.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            k = np.sort(np.concatenate(held))
            k = k[np.concatenate([[True, True], k[2:] != k[:-2]])[: len(k)]]
            cuts = split_ranges(k, n)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(some), binary_rows(k.astype(np.uint32), np.append(cuts[some], len(k)))], ["s", "keys"])

        for x in numbers(batches):
            held.append(x)
            size += len(x)
            if size > room:
                yield from sent()
                held, size = [], 0
                give_back()
        if size:
            yield from sent()

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        k = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]))
        path = write_level(folder, {"key": np.unique(k[1:][k[1:] == k[:-1]])})
        give_back()
        return pa.Table.from_pydict({"s": [key[0].as_py()], "path": [path]})

    built = rows.mapInArrow(collect, "s long, keys binary").groupBy("s").applyInArrow(merge, "s long, path string")
    return SortedSets({r.s: r.path for r in built.collect()}, n)
