"""Exact substring deduplication: seed and extend.

Every window of `length` words has a seed, the smallest hash of its runs of SEED_WORDS words (winnowing), so equal
windows have equal seeds. Documents are joined on seeds first; only around a seed that two documents share are
matches extended to the left and right, window by window, to the first document that holds the same words. Windows
that follow one another make maximal repeats, whose words go.

Windows are equal when two independent 64-bit hashes are, each made of its own hash of the words, so false matches stay
out of reach at any size.

Texts are dealt once into chunks of a few megabytes by a hash of id and text, so neither copies nor rows without an id
meet in one, and chunks to partitions whose number grows with the text. A chunk sends each seed or window only
once, however many of its documents hold it, as packed arrays for ranges of hash values, and gets one bit for each
back; so a passage that a third of all documents share costs one entry for each chunk. No chunk, range or answer
grows with a group of copies, and no pair of documents is ever listed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Words, hash_ranges, refuse, split_words, text_buffer, windows

SEED_WORDS = 6
CHUNK_BYTES = 2 << 20
#: A range of hash values gets the seeds or windows of about so much text.
RANGE_BYTES = 64 << 20
#: A partition gets about so much text.
PARTITION_BYTES = 96 << 20
_SECOND = 0xA24BAED4963EE407
_LAST = np.iinfo(np.int64).max


class _Chunk(NamedTuple):
    data: np.ndarray
    texts: list[bytes]
    words: Words
    ids: np.ndarray
    seed: np.ndarray
    at: np.ndarray
    order: np.ndarray


def _runs_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    size, least = 1, x
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _read(table: pa.Table, length: int) -> _Chunk:
    """A chunk's documents by ascending id, and the seed of each window that lies in one document."""
    column = table.column("text").combine_chunks()
    ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    column = column.take(pa.array(order))
    data, offsets = text_buffer(column if isinstance(column, pa.Array) else column.combine_chunks())
    words = split_words(data, offsets)
    texts = [bytes(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    width = length - min(SEED_WORDS, length) + 1
    grams, _ = windows(words, min(SEED_WORDS, length))
    _, fits = windows(words, length)
    seed = _runs_min(grams, width) if len(grams) >= width else grams[:0]
    at = np.flatnonzero(fits[: len(seed)])
    return _Chunk(data, texts, words, ids[order], seed[at], at, order)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, and where each distinct one begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in keys:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(new)


def _dealt(chunk: int, values: np.ndarray, seconds: np.ndarray, firsts: np.ndarray, ranges: int) -> pa.Table:
    """One row for each range of hash values that the ascending values fall in."""
    of = ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = [*begins[1:].tolist(), len(of)]
    cuts = list(zip(begins.tolist(), ends))
    return pa.table({
        "range": pa.array(of[begins], pa.int64()), "chunk": pa.array(np.full(len(begins), chunk), pa.int64()),
        "entries": pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary()), "seconds": pa.array([seconds[a:b].tobytes() for a, b in cuts], pa.binary()),
        "firsts": pa.array([firsts[a:b].tobytes() for a, b in cuts], pa.binary()),
    })


def _seeds(table: pa.Table, length: int, ranges: int) -> pa.Table:
    chunk = _read(table, length)
    return _dealt(table.column("chunk")[0].as_py(), np.unique(chunk.seed), np.zeros(0, np.uint64), np.zeros(0, np.int64), ranges)


def _answers(table: pa.Table, step: int) -> pa.Table:
    """A bit for each entry: another chunk has it too (step 1), or a document before this chunk's first has it (step 2)."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("entries").to_pylist()]
    values = np.concatenate(parts)
    order, begins = _groups(values) if step == 1 else _groups(values, np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("seconds").to_pylist()]))
    if step == 1:
        found = np.diff([*begins.tolist(), len(values)]) > 1
        bits = np.repeat(found, np.diff([*begins.tolist(), len(values)]))
    else:
        firsts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("firsts").to_pylist()])[order]
        bits = np.repeat(np.minimum.reduceat(firsts, begins), np.diff([*begins.tolist(), len(values)])) < firsts
    back = np.empty(len(values), bool)
    back[order] = bits
    cuts = np.cumsum([0, *map(len, parts)]).tolist()
    masks = [np.packbits(back[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"chunk": table.column("chunk"), "step": pa.array([step] * len(parts), pa.int32()), "range": table.column("range"), "n": pa.array([len(p) for p in parts], pa.int64()), "mask": pa.array(masks, pa.binary())})


def _bits(answers: pa.Table, step: int) -> np.ndarray:
    """A chunk's answers of one step, in the order of its entries."""
    rows = sorted((r for r in answers.to_pylist() if r["step"] == step), key=lambda r: r["range"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["n"]).astype(bool) for r in rows)])


def _shared_windows(chunk: _Chunk, answers: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose seed two documents share: positions, order by hash, where distinct ones begin, and both hashes of these."""
    order, begins = _groups(chunk.seed)
    ends = np.array([*begins[1:].tolist(), len(order)], np.int64)
    doc = chunk.words.doc()[chunk.at]
    here = doc[order[begins]] != doc[order[ends - 1]] if len(begins) else np.zeros(0, bool)
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(here | _bits(answers, 1), ends - begins)
    at = chunk.at[shared]
    again = chunk.words._replace(hash=hash_ranges(chunk.data, chunk.words.start, chunk.words.end, seed=_SECOND))
    one, two = windows(chunk.words, length)[0][at], windows(again, length, _SECOND)[0][at]
    order, begins = _groups(one, two)
    return at, order, begins, one[order[begins]], two[order[begins]]


def _extend(table: pa.Table, answers: pa.Table, length: int, ranges: int) -> pa.Table:
    chunk = _read(table, length)
    at, order, begins, one, two = _shared_windows(chunk, answers, length)
    firsts = chunk.ids[chunk.words.doc()[at[order[begins]]]]  # documents ascend, and the order is stable
    return _dealt(table.column("chunk")[0].as_py(), one, two, firsts, ranges)


def _remove(table: pa.Table, answers: pa.Table, length: int, as_is: bool) -> pa.Table:
    chunk = _read(table, length)
    at, order, begins, _, _ = _shared_windows(chunk, answers, length)
    n, ids = len(chunk.words.hash), chunk.ids[chunk.words.doc()[at]]
    each = np.diff([*begins.tolist(), len(order)])
    gone = np.empty(len(order), bool)
    gone[order] = np.repeat(_bits(answers, 2), each) | (ids[order] > np.repeat(ids[order[begins]], each))
    edges = np.zeros(n + 1, np.int64)
    edges[at[gone]] += 1
    edges[at[gone] + length] -= 1
    covered = np.cumsum(edges)[:n] > 0
    texts, removed, spans, ptr = [], [], [], chunk.words.ptr.tolist()
    for text, a, b in zip(chunk.texts, ptr[:-1], ptr[1:]):
        own = covered[a:b]
        removed.append(int(own.sum()))
        if removed[-1]:
            text = b" ".join(compress(text.split(), (~own).tolist()))
        elif not as_is:
            text = b" ".join(text.split())
        texts.append(text)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist() if removed[-1] else []
        spans.append([{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2])])
    out = table.take(pa.array(chunk.order)).drop_columns(["text", "chunk"])
    for name, values in (
        ("kept_text", pa.array(texts, pa.binary()).cast(pa.string())),
        ("n_words", pa.array(np.diff(chunk.words.ptr), pa.int64())),
        ("n_removed", pa.array(removed, pa.int64())),
        ("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))),
    ):
        out = out.append_column(name, values)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, carry: tuple[str, ...] = (), as_is: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove words that repeat an earlier document: (doc_id, *carry, kept_text, n_words, n_removed, spans).

    A word goes when one of its document's windows of `length` words that cover it also starts in a document with a
    smaller id; windows are judged on the input. kept_text has the words that stay, joined by one space (as_is: a text
    that loses nothing keeps its white space, null becomes empty); spans has the maximal runs of removed words
    [start, end). A null text has no words. A null id counts as greater than all others; rows with equal or null ids
    aren't earlier than each other. Texts with fewer words than a window lose none. carry names columns to hand
    through; a name that the result uses is refused, other columns are ignored.
    """
    refuse(carry, "doc_id", "text", "chunk", "kept_text", "n_words", "n_removed", "spans")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions, n_chunks, ranges = max(-(-total // PARTITION_BYTES), least), max(-(-total // chunk_bytes), 2 * least), max(-(-total // RANGE_BYTES), least)
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(n_chunks)).alias("chunk"), doc_id.alias("doc_id"), text.alias("text"), *carry).repartition(partitions, "chunk")
    entries, answer = "range long, chunk long, entries binary, seconds binary, firsts binary", "chunk long, step int, range long, n long, mask binary"
    by_chunk = texts.groupBy("chunk")

    def seeds(table: pa.Table) -> pa.Table:
        return _seeds(table, length, ranges)

    def answers(step: int) -> Callable[[pa.Table], pa.Table]:
        def answer_range(table: pa.Table) -> pa.Table:
            return _answers(table, step)

        return answer_range

    first = by_chunk.applyInArrow(seeds, entries).groupBy("range").applyInArrow(answers(1), answer)
    extended = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(partial(_extend, length=length, ranges=ranges), entries)
    second = extended.groupBy("range").applyInArrow(answers(2), answer)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields[3:])
    out = f"doc_id long, {types}kept_text string, n_words long, n_removed long, spans array<struct<start: long, end: long>>"
    return by_chunk.cogroup(first.union(second).groupBy("chunk")).applyInArrow(partial(_remove, length=length, as_is=as_is), out)
