"""Best-fit packing of token pieces into fixed-size sequences by the sum-of-squares rule.

Pieces are dealt to groups by a hash of their key and their place in a written table, so rows that are alike are spread
too; each group packs on its own, nothing meets in one task, and a group of GROUP_PIECES pieces leaves only its last few
sequences partly empty. Inside a group pieces come by falling length, then by key and place, so a task that runs again
places them alike.
A piece goes where the sum over residual gaps of (number of open sequences with that gap) squared becomes smallest
(Csirik et al., "On the sum-of-squares algorithm for bin packing", 2006); a new sequence opens when no open one fits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, chunks, refuse, small_batches, text_buffer
from tocsin.llm.word_tokens import encoder, with_end

GROUP_PIECES = 1 << 16


def _cut_pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets):
            ids, ptr = with_end(*encoder(path).encode(data, offsets[a : b + 1]), end_id)
            counts = -(-np.diff(ptr) // size)
            doc = np.repeat(np.arange(b - a), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            length = np.minimum(size, np.diff(ptr)[doc] - piece * size)
            begin = ptr[doc] + piece * size
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length),
                 pa.array([raw[4 * s : 4 * (s + n)] for s, n in zip(begin.tolist(), length.tolist())], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )
    encoder(path).forget()  # an idle worker holds no words


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most `size` ids: (doc_id, piece, start, length, ids), ids as little-endian uint32.

    A document is its ids and then end_id; a null text is empty, so it gives one piece with the end id alone. Only
    documents longer than a sequence are cut. Rows that repeat an id, or have none, are encoded like any other.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(partial(_cut_pieces, path=tokenizer, end_id=end_id, size=size), "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are placed by falling length, equal ones in their order.

    Of gaps that are equally good the smallest is taken, of sequences with that gap the one that got it last.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; none is open at a gap of 0
    open_: dict[int, list[int]] = defaultdict(list)
    gaps = np.zeros(0, np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if n < size:
            fit = gaps[np.searchsorted(gaps, n) :]
            gap = -1
            if len(fit):
                left = fit - n
                change = 2 * (count[left] - count[fit] + 1)
                change[left == 0] -= 1  # a full sequence counts no more
                gap = int(fit[np.argmin(change)])
            if gap < 0:
                gap, at, made = size, made, made + 1
            else:
                at = open_[gap].pop()
                count[gap] -= 1
                if not count[gap]:
                    gaps = np.delete(gaps, np.searchsorted(gaps, gap))
            rest = gap - n
            if rest:
                open_[rest].append(at)
                count[rest] += 1
                if count[rest] == 1:
                    gaps = np.insert(gaps, np.searchsorted(gaps, rest), rest)
            sequence[i], offset[i] = at, size - gap
        else:
            sequence[i], made = made, made + 1
    return sequence, offset


def pack(pieces: DataFrame, size: int, key: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: no sequence holds more than `size`, and offsets leave no gap from 0 on.

    A null or negative length counts as 0; a length over `size` is refused, as is a column that has the name of a
    result. pieces are written to the shared folder once, as their number decides how many groups there are. Null and
    repeated keys are packed like any other.
    """
    refuse(tuple(pieces.columns), "sequence_id", "offset", "_group", "_at")
    rows = Scratch(pieces.sparkSession).write(pieces)
    groups = max(1, -(-rows.count() // group_pieces))
    order = [(length_col, "descending"), *((k, "ascending") for k in key), ("_at", "ascending")]

    def place(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=order))
        n = np.maximum(0, table.column(length_col).combine_chunks().cast(pa.int64()).fill_null(0).to_numpy())
        if len(n) and n.max() > size:
            raise ValueError("a piece is longer than a sequence")
        sequence, offset = sum_of_squares(n, size)
        out = table.drop_columns(["_group", "_at"])
        return out.append_column("sequence_id", pa.array(sequence * groups + group)).append_column("offset", pa.array(offset))

    at = F.monotonically_increasing_id()  # of a written table, so the same in every run of a task
    dealt = rows.withColumn("_at", at).withColumn("_group", F.pmod(F.xxhash64(*key, "_at"), F.lit(groups)))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.groupBy("_group").applyInArrow(place, f"{types}, sequence_id long, offset long")
