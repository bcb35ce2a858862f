"""Chat formatting by token-level assembly.

A turn becomes [im_start] role newline text [im_end] newline. Role and text are encoded separately by a byte-level
vocabulary, and the reserved ids, which no encoding yields, are spliced in between, so no text can open or close a
turn. As readers may look at the formatted text as well, control strings in content are escaped: `<`, any number of
backslashes and `|` get one backslash more. Loss masks are prefix sums over the edges of the assistant's texts.

Turns are range-partitioned and sorted by conversation and turn, so a conversation of any length is formatted, cut into
parts of whole turns, and read back in many tasks. Only what is read of a conversation that crosses tasks, or is
longer than PENDING_BYTES, travels on to be hashed in one stream; all others are digested where they lie.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import chunks, small_batches, text_buffer

#: Reserved ids behind the vocabulary and its end of text, and how they are written.
START, END = 50257, 50258
START_TEXT, END_TEXT = "<|im_start|>", "<|im_end|>"
#: A part ends with the turn that reaches so many ids.
PART_IDS = 1 << 16
#: Read-back text of a conversation that a task holds before it hands it on.
PENDING_BYTES = 4 << 20
_LONG_SPACE = re.compile(r"\s{5000}")
_FORMATTED = "conv_id long, part long, n_turns long, ids binary, loss binary"
_DIGESTS = "conv_id long, part long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, turns binary, loss binary"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Vocabulary:
    """A byte-level vocabulary as ranks, and as a file of the tokenizers library for texts with very long white space,
    on which the faster library fails."""

    def __init__(self, ranks: str, whole: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(table.values()) >= START - 1:
            raise ValueError("the vocabulary reaches the reserved ids")
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = Tokenizer.from_file(whole)
        self.slow.encode_special_tokens = True
        self.newline = self.encode("\n")
        self.heads: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        if len(text) > 5000 and _LONG_SPACE.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranks.encode_to_numpy(text, disallowed_special=())

    def head(self, role: str) -> np.ndarray:
        if role not in self.heads:
            if len(self.heads) > 1000:
                self.heads.clear()
            self.heads[role] = np.concatenate([[START], self.encode(_role_out(role)), self.newline]).astype(np.uint32)
        return self.heads[role]

    def decode(self, ids: np.ndarray) -> str:
        return self.ranks.decode_bytes(ids.tolist()).decode()


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def _vocabulary(paths: tuple[str, str]) -> Vocabulary:
    if paths not in _vocabularies:
        _vocabularies[paths] = Vocabulary(*paths)
    return _vocabularies[paths]


def assemble(own: Vocabulary, roles: list[str], texts: list[str], learnt: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of turns in a row, their loss mask, and where each turn begins."""
    tail = np.concatenate([[END], own.newline]).astype(np.uint32)
    segments = [s for role, text in zip(roles, texts) for s in (own.head(role), own.encode(escape(text)), tail)]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    trained = np.array([role == learnt for role in roles], bool)
    edges = np.zeros(cuts[-1] + 1, np.int64)
    np.add.at(edges, cuts[1::3][trained], 1)
    np.add.at(edges, cuts[2::3][trained], -1)
    return np.concatenate(segments), np.cumsum(edges[:-1]).astype(np.uint8), cuts[::3]


def _format(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], learnt: str, part_ids: int) -> Iterator[pa.RecordBatch]:
    own, number = _vocabulary(paths), TaskContext.get().partitionId() << 33
    for batch in batches:
        _, offsets = text_buffer(batch.column(2))
        for a, b in chunks(offsets):
            convs, roles, texts = (batch.column(k).slice(a, b - a).to_pylist() for k in range(3))
            ids, mask, begin = assemble(own, [r or "" for r in roles], [t or "" for t in texts], learnt)
            begin = begin.tolist()
            firsts, at = [0], 0
            for k in range(1, b - a):
                if convs[k] != convs[at] or begin[k] - begin[at] >= part_ids:
                    at = k
                    firsts.append(k)
            cuts = [*firsts, b - a]
            spans = [(begin[x], begin[y]) for x, y in zip(cuts[:-1], cuts[1:])]
            columns = [pa.array([convs[k] for k in firsts], pa.int64()), pa.array(range(number, number + len(firsts)), pa.int64()), pa.array(np.diff(cuts), pa.int64())]
            columns += [pa.array([ids[x:y].astype("<u4").tobytes() for x, y in spans], pa.binary()), pa.array([mask[x:y].tobytes() for x, y in spans], pa.binary())]
            number += len(firsts)
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "ids", "loss"])


def format_chat(conversations: DataFrame, ranks: str, whole: str, learnt: str = "assistant", part_ids: int = PART_IDS) -> DataFrame:
    """Format all turns of conversations(conv_id, turn, role, text): (conv_id, part, n_turns, ids, loss).

    A conversation's turns go by turn (null first), equal ones by role and text, and are cut into parts that ascend; ids
    are little-endian uint32, loss has a byte for each id, 1 for those of texts whose role is `learnt`. A null text or
    role is empty; rows without a conv_id are one conversation; repeated rows are turns of their own; an empty table
    gives no row; other columns are ignored. ranks and whole name the same vocabulary in its two forms.
    """
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(partial(_format, paths=(ranks, whole), learnt=learnt, part_ids=part_ids), _FORMATTED)


def read_part(own: Vocabulary, ids: np.ndarray, loss: np.ndarray) -> tuple[list[tuple[str, str]], list[str], int]:
    """A part's (role, text) turns, its learnt texts, and the length of its formatted text."""
    starts, ends = np.flatnonzero(ids == START).tolist(), np.flatnonzero(ids == END).tolist()
    turns, chars = [], 0
    for k, (a, b) in enumerate(zip(starts, ends)):
        whole, after = own.decode(ids[a + 1 : b]), own.decode(ids[b + 1 : starts[k + 1] if k + 1 < len(starts) else len(ids)])
        chars += len(START_TEXT) + len(whole) + len(END_TEXT) + len(after)
        role, _, text = whole.partition("\n")
        turns.append((_role_in(role), unescape(text)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.view(np.int8), [0]]))).tolist()
    return turns, [unescape(own.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2])], chars


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _DIGESTS.split(", "))])


def _closed(pieces: list[tuple]) -> tuple:
    """One row for all pieces of a conversation."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for p in pieces:
        turns.update(p[7])
        loss.update(p[8])
    return (*pieces[0][:2], *(sum(p[k] for p in pieces) for k in (2, 3, 4)), turns.hexdigest(), loss.hexdigest(), None, None)


def _digest(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], pending_bytes: int) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a task as one row each; the first and the last one, and long ones, piece by piece."""
    own, pieces, size, open_, out = _vocabulary(paths), [], 0, True, []
    for conv, part, _, ids, loss in _parts(batches):
        if pieces and pieces[-1][0] != conv:
            out += pieces if open_ else [_closed(pieces)]
            pieces, size, open_ = [], 0, False
        turns, learnt, chars = read_part(own, np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.uint8))
        read = "".join(f"{role}\n{text}\n" for role, text in turns).encode(), "".join(learnt).encode()
        pieces.append((conv, part, len(turns), sum(map(len, learnt)), chars, None, None, *read))
        size += len(read[0]) + len(read[1])
        if size > pending_bytes:  # its last piece stays, so that the next row knows which conversation it follows
            out += pieces[:-1]
            pieces, size, open_ = pieces[-1:], 0, True
        if len(out) > 1000 or (open_ and out):
            yield _rows(out, _SCHEMA)
            out = []
    if out or pieces:
        yield _rows(out + pieces, _SCHEMA)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted conversations, hashed as they come."""
    last, sums, turns, loss, out = None, [], None, None, []

    def closed() -> tuple:
        return (*last, *sums, turns.hexdigest(), loss.hexdigest(), None, None)

    for row in _parts(batches):
        if row[7] is None:
            out.append(row)
        else:
            if last is None or last[0] != row[0]:
                if last is not None:
                    out.append(closed())
                last, sums, turns, loss = row[:2], [0, 0, 0], hashlib.sha256(), hashlib.sha256()
            sums = [s + x for s, x in zip(sums, row[2:5])]
            turns.update(row[7])
            loss.update(row[8])
        if len(out) > 1000:
            yield _rows(out, _SCHEMA)
            out = []
    if last is not None:
        out.append(closed())
    if out:
        yield _rows(out, _SCHEMA)


def chat_digests(formatted: DataFrame, ranks: str, whole: str, pending_bytes: int = PENDING_BYTES) -> DataFrame:
    """What is read back from format_chat()'s result: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    turns_sha256 is of role, newline, text, newline of every turn, loss_sha256 of all text under the mask, both
    unescaped. formatted must keep format_chat()'s order: a conversation's parts in one task, or in tasks in a row.
    """
    read = formatted.mapInArrow(partial(_digest, paths=(ranks, whole), pending_bytes=pending_bytes), _DIGESTS)
    merged = read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_merged, _DIGESTS)
    return merged.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
