"""Whole texts to token ids with a word-level BPE of the tokenizers library, each distinct word encoded once.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words in a row. Words
are cut further where plain ASCII letters, digits and signs meet, which the tokenizer's pattern does too, and
folded, which its normaliser does too; a word with any other character is encoded as it stands. The library encodes
the words that a worker hasn't met; vectors of known ids are then laid out for each document.
"""

from __future__ import annotations

import os

import numpy as np

from tocsin.llm.common import distinct_ranges, folded, split_words

#: Words that a worker remembers, and their bytes; then it begins anew.
MOST_WORDS, MOST_BYTES = 250_000, 16 << 20
_WORDS_AT_ONCE = 256

_WHITE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_kind = np.full(256, _OTHER, np.uint8)
_kind[0x21:0x7F] = _SIGN
_kind[[0x20, 9, 10, 11, 12, 13]] = _WHITE
_kind[ord("0") : ord("9") + 1] = _DIGIT
_kind[ord("A") : ord("Z") + 1] = _kind[ord("a") : ord("z") + 1] = _LETTER
_kind[[ord("'"), ord("<")]] = _OTHER  # they can begin a contraction or a special token
_kind[0xC3] = _LETTER  # with the byte after it a letter of Latin-1, but for two signs


def lay_out(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i] + lengths[i]] for all i in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class WordEncoder:
    """Encodes Arrow text buffers; keeps what it has learnt about words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_bytes = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, keys: list[bytes], words: list[str], odd: np.ndarray) -> None:
        """odd words may make several tokens' words or none; all others are one word of the tokenizer's own."""
        parts = []
        even, lone = np.flatnonzero(~odd).tolist(), np.flatnonzero(odd).tolist()
        texts = [words[i] for i in even]
        for e, k in zip(self._ids([" ".join(texts[k : k + _WORDS_AT_ONCE]) for k in range(0, len(texts), _WORDS_AT_ONCE)]), range(0, len(texts), _WORDS_AT_ONCE)):
            sizes = np.diff(np.flatnonzero(np.concatenate([[True], self.ends[e]])))
            if len(sizes) != min(_WORDS_AT_ONCE, len(texts) - k):
                raise ValueError("the tokenizer doesn't cut words where this library does")
            parts.append((e, sizes))
        parts += [(e, np.array([len(e)])) for e in self._ids([words[i] for i in lone])]
        flat, lengths = (np.concatenate(x) for x in zip(*parts))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) + len(words) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        n = len(self.known)
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.used += len(flat)
        self.known.update((keys[i], n + k) for k, i in enumerate([*even, *lone]))
        self.n_bytes += sum(map(len, keys))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents data[offsets[i]:offsets[i + 1]] in a row, and where each document's begin."""
        lo = int(offsets[0])
        words = split_words(data, offsets, hashes=False)
        n = len(words.start)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        buffer = data[lo : int(offsets[-1])]
        kind = _kind[buffer]
        lead = np.flatnonzero(buffer[:-1] == 0xC3)
        if len(lead):
            after = buffer[lead + 1]
            kind[lead + 1] = np.where((after == 0x97) | (after == 0xB7), _OTHER, _LETTER)
            capitals = lead[(after <= 0x9E) & (after != 0x97)] + 1
            if len(capitals):
                buffer = buffer.copy()
                buffer[capitals] += 0x20
        odd = np.zeros(n, bool)
        odd[np.searchsorted(words.start, np.flatnonzero(kind == _OTHER) + lo, side="right") - 1] = True
        begins = np.zeros(len(buffer), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins &= kind != _WHITE
        for a, b in zip((words.start[odd] - lo).tolist(), (words.end[odd] - lo).tolist()):
            begins[a:b] = False
        begins[words.start - lo] = True
        begins_word = np.zeros(len(buffer), bool)
        begins_word[words.start - lo] = True
        start = np.flatnonzero(begins)
        word = np.cumsum(begins_word[start]) - 1
        end = np.minimum(np.append(start[1:], len(buffer)), words.end[word] - lo)
        odd = odd[word]
        norm, raw = folded(buffer), data[lo : lo + len(buffer)]
        for a, b in zip(start[odd].tolist(), end[odd].tolist()):
            norm[a:b] = raw[a:b]
        first, at = distinct_ranges(norm, start, end)
        content = norm.tobytes()
        keys = [content[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        if len(self.known) + len(keys) > MOST_WORDS or self.n_bytes > MOST_BYTES:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            raw, places = raw.tobytes(), first[new]
            texts = [raw[a:b].decode() for a, b in zip(start[places].tolist(), end[places].tolist())]
            self._learn([keys[i] for i in new], texts, odd[places])
        rows = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[at]
        lengths = self.length[rows]
        ids = lay_out(self.begin[rows], lengths, self.flat)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(start, offsets - lo)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, ptr: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with end_id after them."""
    n = len(ptr) - 1
    ends = ptr[1:] + np.arange(n)
    out = np.empty(len(ids) + n, np.uint32)
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[ends] = end_id
    out[rest] = ids
    return out, ptr + np.arange(n + 1)
