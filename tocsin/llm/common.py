"""Shared pieces of the corpus operators: lineage cuts and vectorised word hashing.

Texts reach Python as Arrow string columns. Words are found and hashed in numpy straight from the column's
UTF-8 buffer, a few megabytes at a time, so no Python string is made for a word and memory doesn't grow with
the size of an Arrow batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of bytes outside this set.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are handled at once, and hashed at once.
CHUNK_BYTES, SEGMENT_BYTES = 1 << 20, 1 << 18

#: Bytes of an Arrow batch between an executor and its Python worker.
BATCH_BYTES = 8 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_solid = np.ones(256, bool)
_solid[list(WHITE_SPACE)] = False
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
#: What is left of an 8-byte block of which only the first n bytes belong to a range.
_first_bytes = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"


class Scratch:
    """Tables that an operator writes to the shared folder to cut lineage and to read more than once.

    drop() deletes a table that no later plan reads. What the operator's result still reads stays until the folder is
    cleared, as checkpoints do.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n, self.paths = spark, shared_folder(spark), 0, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands whole texts to Python workers in Arrow batches of about BATCH_BYTES.

    Spark's own 64 MB take several times that of an executor's memory outside its heap, in each task at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def refuse(carry: tuple[str, ...], *names: str) -> None:
    """Raise if a column to hand through has a name of the result, or is named twice."""
    clash = {c for c in carry if c.lower() in names or [x.lower() for x in carry].count(c.lower()) > 1}
    if clash:
        raise ValueError(f"carry holds names of the result or a name twice: {sorted(clash)}")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of consecutive documents: hash, byte range in the buffer, and document i's words at ptr[i]:ptr[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its values; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` bytes each; a longer document is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True) -> Words:
    """Words of the documents data[offsets[i]:offsets[i + 1]] with 64-bit hashes; fold: A-Z count as a-z; hashes False leaves them out."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    buffer = data[lo:hi]
    if not len(buffer):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    solid = _solid[buffer]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    begins, ends = (offsets[:-1] - lo)[full], (offsets[1:] - lo - 1)[full]
    first[begins] = solid[begins]
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(hash_ranges(buffer, start, end, fold) if hashes else np.zeros(0, np.uint64), start + lo, end + lo, np.searchsorted(start, offsets - lo))


def folded(buffer: np.ndarray) -> np.ndarray:
    """The bytes with a-z in place of A-Z."""
    return _fold[buffer]


def _blocks(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-byte blocks of the byte ranges, zeros behind a range's end; where each range's blocks begin (one at least), and their places in it."""
    length = end - start
    n = np.maximum((length + 7) >> 3, 1)
    ptr = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(ptr[-1]) - np.repeat(ptr[:-1], n)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    blocks = at_byte[np.repeat(start, n) + 8 * place]
    blocks[ptr[1:] - 1] &= _first_bytes[length - 8 * (n - 1)]
    return blocks, ptr, place


def _hashed(blocks: np.ndarray, ptr: np.ndarray, place: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    keys = mix(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * _GOLDEN + np.uint64(seed))
    return mix(np.add.reduceat(mix(blocks ^ keys[place]), ptr[:-1]) + length.astype(np.uint64) * _GOLDEN + np.uint64(seed))


def hash_ranges(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which ascend and may overlap; another seed gives an independent hash.

    A range's 8-byte blocks are mixed with a key of their place, so that neither order nor pattern of blocks cancels
    out, then summed and mixed with the range's length.
    """
    if fold:
        buffer = folded(buffer)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, int(start[at]) + SEGMENT_BYTES)))
        s, e = start[at:to], end[at:to]
        base, top = int(s[0]), int(e.max())
        out[at:to] = _hashed(*_blocks(buffer[base:top], s - base, e - base), e - s, seed)
        at = to
    return out


def distinct_ranges(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one range of each distinct content, and the number of each range's content among these.

    Ranges of equal hash are compared by their bytes; should two differ, all are told apart by their bytes alone.
    """
    _, first, at = np.unique(hash_ranges(buffer, start, end), return_index=True, return_inverse=True)
    blocks, ptr, place = _blocks(buffer, start, end)
    model = first[at]
    if ((end - start) == (end - start)[model]).all() and (blocks == blocks[np.repeat(ptr[:-1][model], np.diff(ptr)) + place]).all():
        return first, at
    raw, number, firsts = buffer.tobytes(), {}, []
    numbers = np.empty(len(start), np.int64)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        numbers[i] = number.setdefault(raw[a:b], len(firsts))
        if numbers[i] == len(firsts):
            firsts.append(i)
    return np.array(firsts, np.int64), numbers


def windows(words: Words, size: int, multiplier: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each word on, and whether they lie in one document. Other multipliers give other hashes."""
    n = len(words.hash)
    if n < size:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total = total * np.uint64(multiplier) + words.hash[j : n - size + 1 + j]
    hashes = np.zeros(n, np.uint64)
    hashes[: n - size + 1] = mix(total + np.uint64(size))
    fits = np.arange(n) + size <= np.repeat(words.ptr[1:], np.diff(words.ptr))
    return hashes, fits


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def lists(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """A list column: list i holds values[ptr[i]:ptr[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(ptr, np.int32)), as_long(values))
