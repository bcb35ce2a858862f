"""Token ids in files, coded by a static range asymmetric numeral system.

A file row is a segment: whole documents in ascending id, about a million ids. Its header has the documents and one
table of symbol frequencies, which all its blocks share. A block codes BLOCK ids with LANES interleaved states: id i
belongs to lane i % LANES, and all lanes write to one stream of 32-bit words in the order in which a decoder asks for
them. Every CHECKPOINT steps a block also stores its states and its place in the stream, so decoding can begin there;
each block has a checksum. Segments are Parquet rows, so Spark writes and reads them wherever the cluster keeps files,
and any executor decodes any segment, block or part of a block without the others. All blocks of a segment are coded
and decoded at once in numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.llm.common import chunks, small_batches, text_buffer
from tocsin.llm.word_tokens import encoder, with_end

SEGMENT_IDS, LANES, STEPS, CHECKPOINT = 1 << 20, 64, 1024, 512
BLOCK = LANES * STEPS
SCALE = 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MAGIC = b"RANS1\0\0\0"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled so that they sum to 1 << SCALE and no symbol that occurs has 0."""
    total, target = int(counts.sum()), 1 << SCALE
    scaled = np.maximum(counts > 0, counts.astype(np.int64) * target // max(1, total))
    spare = target - int(scaled.sum())
    if spare < 0:  # what rare symbols got beyond their share comes from all others in proportion
        room = scaled - 1
        scaled -= np.where(room > 0, room * -spare // max(1, int(room.sum())), 0)
        spare = target - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    one = np.resize(order[scaled[order] > 1] if spare < 0 else order, abs(spare))  # at most one each is left
    np.add.at(scaled, one, 1 if spare > 0 else -1)
    return scaled.astype(np.uint64)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: lengths[i] ids of document doc_ids[i], in a row."""
    symbols, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    frequency = frequencies(counts)
    start = np.cumsum(frequency) - frequency
    n_blocks = max(1, -(-len(ids) // BLOCK))
    padded = np.full(n_blocks * BLOCK, int(np.argmax(frequency)), np.int64)
    padded[: len(ids)] = at
    grid = np.ascontiguousarray(padded.reshape(n_blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, -1))
    state = np.full(n_blocks * LANES, _LOW, np.uint64)
    words = np.zeros(grid.shape, np.uint32)
    wrote = np.zeros(grid.shape, bool)
    saved = []
    shift = np.uint64(31 - SCALE + 32)
    for step in range(STEPS - 1, -1, -1):
        f, c = frequency[grid[step]], start[grid[step]]
        full = state >= f << shift
        wrote[step] = full
        words[step] = state & np.uint64(0xFFFFFFFF)
        state = np.where(full, state >> _WORD, state)
        whole = state // f
        state = (whole << np.uint64(SCALE)) + (state - whole * f) + c
        if step % CHECKPOINT == 0:
            saved.append(state.reshape(n_blocks, LANES))
    saved = saved[::-1]
    wrote, words = (x.reshape(STEPS, n_blocks, LANES) for x in (wrote, words))
    blocks = []
    for b in range(n_blocks):
        own = wrote[:, b]
        places = np.concatenate([[0], np.cumsum(own.sum(axis=1))])[: STEPS : CHECKPOINT].astype("<u4")
        body = b"".join(s[b].astype("<u8").tobytes() for s in saved) + places.tobytes() + words[:, b][own].astype("<u4").tobytes()
        blocks.append(body)
    header = zlib.compress(
        doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + symbols.astype("<u4").tobytes() + frequency.astype("<u4").tobytes()
        + np.array([len(b) for b in blocks], "<u4").tobytes() + np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes(), 1
    )
    return _MAGIC + struct.pack("<QIIII", len(ids), len(doc_ids), len(symbols), n_blocks, len(header)) + struct.pack("<I", zlib.crc32(header)) + header + b"".join(blocks)


class Segment:
    """A segment that is read back."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != _MAGIC:
            raise ValueError("not a segment of token ids")
        self.n, docs, n_symbols, self.n_blocks, size = struct.unpack_from("<QIIII", raw, 8)
        (check,) = struct.unpack_from("<I", raw, 32)
        header = raw[36 : 36 + size]
        if zlib.crc32(header) != check:
            raise ValueError("a segment's header is damaged")
        header, at = zlib.decompress(header), 0
        parts = []
        for kind, count in (("<i8", docs), ("<u4", docs), ("<u4", n_symbols), ("<u4", n_symbols), ("<u4", self.n_blocks), ("<u4", self.n_blocks)):
            parts.append(np.frombuffer(header, kind, count, at))
            at += parts[-1].nbytes
        self.doc_ids, self.lengths, self.symbols, frequency, sizes, self.checks = parts
        self.frequency = frequency.astype(np.uint64)
        self.start = np.cumsum(self.frequency) - self.frequency
        self.slots = np.repeat(np.arange(n_symbols), frequency)
        edges = 36 + size + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.blocks = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def decode(self, first: int = 0, last: int | None = None, checkpoint: int = 0) -> np.ndarray:
        """Ids of the blocks first to last - 1, each from one of its checkpoints on."""
        own = range(first, self.n_blocks if last is None else last)
        n_saved = STEPS // CHECKPOINT
        state, streams, place = [], [], []
        for b in own:
            raw = self.blocks[b]
            if zlib.crc32(raw) != self.checks[b]:
                raise ValueError(f"block {b} of a segment is damaged")
            states = np.frombuffer(raw, "<u8", n_saved * LANES).reshape(n_saved, LANES)
            places = np.frombuffer(raw, "<u4", n_saved, n_saved * LANES * 8)
            state.append(states[checkpoint])
            streams.append(np.frombuffer(raw, "<u4", offset=n_saved * (LANES * 8 + 4)))
            place.append(places[checkpoint])
        base = np.cumsum([0, *map(len, streams)])[:-1] + np.array(place, np.int64)
        stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        x = np.concatenate(state).astype(np.uint64).reshape(len(own), LANES)
        steps = STEPS - checkpoint * CHECKPOINT
        out = np.empty((steps, len(own), LANES), np.int64)
        for step in range(steps):
            slot = x & np.uint64((1 << SCALE) - 1)
            s = self.slots[slot]
            out[step] = s
            x = self.frequency[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            low = x < _LOW
            if low.any():
                order = base[:, None] + np.cumsum(low, axis=1) - 1
                x = np.where(low, (x << _WORD) | stream[np.where(low, order, -1)], x)
                base = base + low.sum(axis=1)
        ids = self.symbols[out.transpose(1, 0, 2).reshape(len(own), -1)] if len(self.symbols) else out.reshape(len(own), -1)[:, :0]
        if checkpoint == 0:
            return ids.ravel()[: max(0, self.n - own.start * BLOCK)]
        return ids.ravel()


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    docs, lengths, held, size, order = [], [], [], 0, 0
    part = TaskContext.get().partitionId()

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held)
        raw = encode_segment(np.concatenate(docs), np.concatenate(lengths), ids)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([order], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], ["part", "number", "n_ids", "segment"])

    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets, 1 << 20):
            ids, ptr = with_end(*encoder(path).encode(data, offsets[a : b + 1]), end_id)
            docs.append(batch.column(0).slice(a, b - a).fill_null(np.iinfo(np.int64).min).to_numpy())
            lengths.append(np.diff(ptr))
            held.append(ids)
            size += len(ids)
            if size >= SEGMENT_IDS:
                yield row()
                docs, lengths, held, size, order = [], [], [], 0, order + 1
    if held:
        yield row()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every whole text, end_id after each, and write segments to `folder` in ascending id.

    A null text is empty and gives the end id alone. Null ids come first; rows that repeat an id, or have none, follow
    the order of their texts' hashes and then of the texts, and fall in several ranges where they are many. partitions
    is the number of ranges, the session's shuffle partitions if None. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id"), F.col("_turn")]
    dealt = text.withColumn("_turn", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys, "text").select("doc_id", "text")
    ordered.mapInArrow(partial(_segments, path=tokenizer, end_id=end_id), "part long, number long, n_ids long, segment binary").write.option("compression", "none").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            segment = Segment(raw.as_py())
            ids = segment.decode().astype("<u4").tobytes()
            ends = np.cumsum(segment.lengths.astype(np.int64))
            starts = ends - segment.lengths
            n, missing = len(ends), segment.doc_ids == np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(segment.doc_ids.astype(np.int64), mask=missing), pa.array(starts), pa.array(ends - starts),
                 pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                ["part", "number", "doc_id", "before", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document that write_tokens wrote to `folder`.

    start counts the ids of all documents before it; ids are little-endian uint32, or with digest ids_crc32 has their
    checksum instead. Without any segment the table is empty.
    """
    files = spark.read.schema("part long, number long, n_ids long, segment binary").parquet(folder)
    sizes = files.select("part", "number", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    starts = sizes.select("part", "number", inside.alias("before_segment")).join(parts, "part").select("part", "number", (F.col("before_part") + F.col("before_segment")).alias("base"))
    found = files.select("part", "number", "segment").mapInArrow(_documents, "part long, number long, doc_id long, before long, n_tokens long, ids binary")
    ids = F.crc32("ids").alias("ids_crc32") if digest else F.col("ids")
    found = found.select("part", "number", "doc_id", "before", "n_tokens", ids)
    return found.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), *found.columns[4:])
