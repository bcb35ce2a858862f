"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into units that no merge can cross: a run of spaces with what follows it up to the next space, and
characters that stand in no piece. Each distinct unit that a worker hasn't met is encoded together with all others:
their symbols lie in one flat array; in a round every unit finds the smallest rank of its pairs, merges the leftmost
pair of that rank (and further ones if that can't change the result), and the array is compacted, until no pair is
left. Characters without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import chunks, distinct_ranges, text_buffer

#: Units that a worker remembers, and their bytes; then it begins anew.
MOST_UNITS, MOST_BYTES = 200_000, 16 << 20
SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """A BPE model of the sentencepiece library with byte fallback, a leading space and no normalisation."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {names[i]: i for i in plain}
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(n, _NONE, np.int64)
        self.rank[plain] = [order[model.get_score(i)] for i in plain]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        inner = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        if inner - self.id_of.keys() or any(SPACE in names[i].lstrip(SPACE) for i in plain) or not all(map(model.is_byte, self.byte_id.tolist())):
            raise ValueError("the model has pieces of characters without a piece, pieces across a space, or no byte pieces")
        pairs = [(self.id_of[p[:k]], self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs))
        self._build(left * n + right, merged)
        self.n = n
        self.of_char = np.full(1 << 16, -1, np.int64)
        self.of_astral = {}
        for p, i in self.id_of.items():
            if len(p) == 1 and ord(p) < len(self.of_char):
                self.of_char[ord(p)] = i
            elif len(p) == 1:
                self.of_astral[ord(p)] = i
        self.of_char[ord(" ")] = self.id_of[SPACE]
        self.text = [b""] * n
        for i in plain:
            self.text[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id.tolist()):
            self.text[i] = bytes([b])
        self.decimal = [b"%d," % i for i in range(n)]
        #: ASCII characters other than a space that stand in no longer piece: no merge reaches across them.
        self.alone = np.zeros(256, bool)
        self.alone[[c for c in range(128) if chr(c) not in inner and c != 0x20]] = True
        widest = max((len(p) for p in self.id_of if not p.strip(SPACE)), default=1)
        even = len({self.rank[self.id_of[SPACE * k]] for k in range(2, widest + 1) if SPACE * k in self.id_of}) == 1
        #: Runs of spaces longer than this are cut at its multiples, which leftmost merges of equal rank do as well.
        self.space_run = widest if even and all(SPACE * k in self.id_of for k in range(2, widest + 1)) else 0
        for probe in ("", " a  b\n\tcd ", "ﬁ² Ångström \U0001f600x", "x" * 9 + " " * 40 + "the"):
            if PieceEncoder(self).encode_text(probe) != (model.encode(probe), model.decode(model.encode(probe))):
                raise ValueError("the model normalises texts or isn't a BPE model")

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(12, int(len(keys) * 6).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        place = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[place[left]] == -1
            self.keys[place[left[free]]] = keys[left[free]]
            own = self.keys[place[left]] == keys[left]
            self.values[place[left[own]]] = values[left[own]]
            left = left[~own]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = np.where((left < 0) | (right < 0), -2, left * self.n + right)
        place = self._place(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            at = place[open_]
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found != -1)]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged < 0, _NONE, self.rank[merged])


def merge_rounds(model: PieceModel, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ascending units to pieces: what is left, its units, and the index of its first symbol."""
    first = np.arange(len(symbols))
    done = []
    same = unit[1:] == unit[:-1]
    to = np.append(np.where(same, model.merged(symbols[:-1], symbols[1:]), -1), -1) if len(symbols) else np.zeros(0, np.int64)
    rank = model.ranks(to)
    while len(symbols):
        begins = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.append(begins, len(unit)))
        least = np.minimum.reduceat(rank, begins)
        if (least == _NONE).any():
            over = np.repeat(least == _NONE, sizes)
            done.append((symbols[over], unit[over], first[over]))
            symbols, unit, first, to, rank = (x[~over] for x in (symbols, unit, first, to, rank))
            if not len(symbols):
                break
            sizes, least = sizes[least != _NONE], least[least != _NONE]
            begins = np.cumsum(sizes) - sizes
        # candidates: pairs of the least rank that don't overlap, from the left
        index = np.repeat(np.arange(len(begins)), sizes)
        at = np.flatnonzero(rank == least[index])
        run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (index[at[1:]] != index[at[:-1]])])
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
        of = index[at]
        later = np.concatenate([[False], of[1:] == of[:-1]])
        if later.any():
            # a further merge may happen at once unless an earlier one makes a pair of the same or a better rank
            several = np.zeros(len(begins), bool)
            several[of[later]] = True
            mine = several[of]
            a, made = at[mine], to[at[mine]]
            new = symbols.copy()
            new[a] = made
            gone = np.zeros(len(symbols) + 2, bool)
            gone[a + 1] = True
            before = np.where(gone[np.maximum(a - 1, 0)], a - 2, a - 1)
            inside = (a > begins[index[a]])
            left = np.where(inside, model.merged(np.where(inside, new[np.maximum(before, 0)], -1), made), -1)
            after = np.minimum(a + 2, len(symbols) - 1)
            right = np.where((a + 2 < len(symbols)) & (index[after] == index[a]), model.merged(made, symbols[after]), -1)
            risky = np.minimum(model.ranks(left), model.ranks(right)) <= least[index[a]]
            unsafe = np.zeros(len(begins), bool)
            unsafe[index[a[risky]]] = True
            at = at[~(later & unsafe[of])]
        symbols[at] = to[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        symbols, unit, first, to, rank, touched = (x[keep] for x in (symbols, unit, first, to, rank, touched))
        again = touched.copy()
        again[:-1] |= touched[1:]
        again = np.flatnonzero(again)
        follows = np.minimum(again + 1, len(symbols) - 1)
        joined = (again + 1 < len(symbols)) & (unit[again] == unit[follows])
        to[again] = np.where(joined, model.merged(symbols[again], np.where(joined, symbols[follows], -1)), -1)
        rank[again] = model.ranks(to[again])
    if not done:
        return symbols, unit, first
    symbols, unit, first = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(first, kind="stable")
    return symbols[order], unit[order], first[order]


class PieceEncoder:
    """Encodes Arrow text buffers; keeps what it has learnt about units."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_bytes = 0
        self.counts: list[int] = []
        self.ids: list[bytes] = []
        self.decimals: list[bytes] = []
        self.texts: list[bytes] = []

    def _learn(self, units: list[bytes]) -> None:
        model = self.model
        chars = np.frombuffer(b"".join(units).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(u.decode()) for u in units], np.int64)
        symbols = np.where(chars < len(model.of_char), model.of_char[np.minimum(chars, len(model.of_char) - 1)], -1)
        for c in np.unique(chars[chars >= len(model.of_char)]).tolist():
            symbols[chars == c] = model.of_astral.get(c, -1)
        left, unit, first = merge_rounds(model, symbols, np.repeat(np.arange(len(units)), lengths))
        lone = np.flatnonzero(left < 0)
        if len(lone):  # characters without a piece: their bytes
            raw = [chr(c).encode() for c in chars[first[lone]].tolist()]
            sizes = np.ones(len(left), np.int64)
            sizes[lone] = list(map(len, raw))
            left, unit = np.repeat(left, sizes), np.repeat(unit, sizes)
            left[left < 0] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        ids = left.tolist()
        n = len(self.counts)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = ids[a:b]
            self.counts.append(b - a)
            self.ids.append(left[a:b].astype("<u4").tobytes())
            self.decimals.append(b"".join([model.decimal[i] for i in own]))
            self.texts.append(b"".join([model.text[i] for i in own]))
            self.known[units[k]] = n + k
        self.n_bytes += sum(map(len, units))

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the documents' units in what is known, and where each document's begin. Each full document begins with a space."""
        space = data == 0x20
        alone = self.model.alone[data]
        begins = alone.copy()
        begins[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
        full = offsets[1:] > offsets[:-1]
        begins[offsets[:-1][full]] = True
        if self.model.space_run and len(data) > 2 * self.model.space_run:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], space.view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if (edges[1::2] - edges[::2] > 2 * self.model.space_run).any() else ():
                if b - a > 2 * self.model.space_run:
                    begins[a : b - self.model.space_run : self.model.space_run] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        first, at = distinct_ranges(data, start, end)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        if len(self.known) + len(keys) > MOST_UNITS or self.n_bytes > MOST_BYTES:
            self._forget()
        new = [k for k in keys if k not in self.known]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return rows[at], np.searchsorted(start, offsets)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of units for whole UTF-8 texts, and where each text's begin."""
        spaced = [(b" " + t).replace(SPACE.encode(), b" ") if t else t for t in texts]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, spaced)))]).astype(np.int64)
        return self.units(np.frombuffer(b"".join(spaced), np.uint8), offsets)

    def encode_text(self, text: str) -> tuple[list[int], str]:
        """Ids of one text and what they decode to."""
        rows, _ = self.encode([text.encode()])
        ids = np.frombuffer(b"".join([self.ids[r] for r in rows.tolist()]), "<u4").tolist()
        return ids, b"".join([self.texts[r] for r in rows.tolist()])[1:].decode()


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(PieceModel(path))
    return _encoders[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    own = _encoder(path)
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets):
            texts = [bytes(data[s:e]) for s, e in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())]
            rows, ptr = own.encode(texts)
            rows, ptr = rows.tolist(), ptr.tolist()
            counts = [sum(map(own.counts.__getitem__, rows[s:e])) for s, e in zip(ptr[:-1], ptr[1:])]
            parts = own.decimals if digest else own.ids
            ids = [b"".join(map(parts.__getitem__, rows[s:e])) for s, e in zip(ptr[:-1], ptr[1:])]
            decoded = [b"".join(map(own.texts.__getitem__, rows[s:e]))[1:] for s, e in zip(ptr[:-1], ptr[1:])]
            if digest:
                ids = [hashlib.sha256(x[:-1]).hexdigest() for x in ids]
                decoded = [hashlib.sha256(x).hexdigest() for x in decoded]
            last = pa.array(decoded) if digest else pa.array(decoded, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids), last], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_pieces(docs: DataFrame, model: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: (doc_id, n_tokens, ids, decoded), one row for each row of docs.

    ids are little-endian uint32; with digest, (doc_id, n_tokens, ids_sha256, decoded_sha256) of the decimal ids
    joined by commas and of the decoded text, so that neither leaves the worker. A null or empty text has no ids and
    decodes to an empty text. Rows with a null or repeated id are encoded like any other; other columns are ignored.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = text.mapInArrow(partial(_encode, path=model, digest=digest), f"doc_id long, n_tokens long, ids {'string' if digest else 'binary'}, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digest else out
