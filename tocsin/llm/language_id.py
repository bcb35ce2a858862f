"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters': the first permuted twice, the
second once, multiplied component by component. A text's vector is the sum of its trigrams' vectors, a language's
prototype that of all its training texts, and the language of the closest prototype by cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import chunks, text_buffer

DIMENSIONS = 1024
UNKNOWN = "und"
#: Trigram vectors that a worker remembers; then it begins anew.
MOST_TRIGRAMS = 32_768
_CHUNK = 1 << 20


def _letters() -> np.ndarray:
    """For each code point below 65536 its lower case if that is a single letter, and 0 if it is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Space:
    """Letter and trigram vectors of one worker. They depend on the letters alone, so all workers have the same."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.table = dimensions, _letters()
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), np.int8)

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng([c, 271828]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[c]

    def rows(self, trigrams: np.ndarray) -> np.ndarray:
        """Rows of these distinct trigrams in self.vectors."""
        keys = trigrams.tolist()
        if len(self.known) + len(keys) > max(MOST_TRIGRAMS, len(keys)):
            self._forget()
        for key in keys:
            if key not in self.known:
                n = len(self.known)
                if n == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.vectors[n] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
                self.known[key] = n
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def trigrams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, trigrams and counts, ascending by document; runs of other characters than letters count as one."""
        lo, hi, n = int(offsets[0]), int(offsets[-1]), len(offsets) - 1
        chars = np.frombuffer(data[lo:hi].tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
        doc = np.repeat(np.arange(n), np.diff(heads[offsets - lo]))
        low = np.where(chars < len(self.table), self.table[np.minimum(chars, len(self.table) - 1)], 0)
        for c in np.unique(chars[chars >= len(self.table)]).tolist():
            if chr(c).isalpha():
                low[chars == c] = ord(chr(c).lower())
        # one break before and after each document, and one for each run of other characters
        ends = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        low, doc = np.insert(low, ends, 0), np.insert(doc, ends, doc[ends] if len(doc) else 0)
        low, doc = np.append(low, 0).astype(np.uint64), np.append(doc, n)
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0) | (doc[1:] != doc[:-1])
        low, doc = low[keep], doc[keep]
        # a document without a break at its end borrows that of the next one
        own = doc.copy()
        own[1:][low[1:] == 0] = doc[:-1][low[1:] == 0]
        whole = (own[2:] == doc[:-2]) & (doc[1:-1] == doc[:-2]) & (low[1:-1] != 0)
        key = (low[:-2] << np.uint64(42) | low[1:-1] << np.uint64(21) | low[2:])[whole]
        of = doc[:-2][whole]
        distinct, at = np.unique(key, return_inverse=True)
        both, counts = np.unique(of.astype(np.int64) * max(1, len(distinct)) + at, return_counts=True)
        return both // max(1, len(distinct)), distinct[both % max(1, len(distinct))] if len(distinct) else key, counts

    def vector(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.vectors[rows].astype(np.float32)


_spaces: dict[int, Space] = {}


def _space(dimensions: int) -> Space:
    if dimensions not in _spaces:
        _spaces[dimensions] = Space(dimensions)
    return _spaces[dimensions]


def _bundle(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    space, sums = _space(dimensions), {}
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), object)
        for a, b in chunks(offsets, _CHUNK):
            doc, key, counts = space.trigrams(data, offsets[a : b + 1])
            distinct, at = np.unique(key, return_inverse=True)
            rows = space.rows(distinct)
            for lang in set(langs[a:b]):
                own = (langs[a:b] == lang)[doc]
                each = np.bincount(at[own], counts[own], len(distinct))
                used = np.flatnonzero(each)
                sums[lang] = sums.get(lang, 0) + space.vector(rows[used], each[used]).astype(np.float64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions), pa.int32()), pa.array(np.broadcast_to(total, dimensions))], ["lang", "place", "value"])


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of each language: the bundled vectors of all its documents with a text and a language.

    What comes back is one vector for each language, however many documents there are.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(partial(_bundle, dimensions=dimensions), "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for lang, place, value in sums.collect():
        found.setdefault(lang, np.zeros(dimensions))[place] = value
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if np.linalg.norm(v)}


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    space = _space(known.shape[1])
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets, _CHUNK):
            doc, key, counts = space.trigrams(data, offsets[a : b + 1])
            distinct, at = np.unique(key, return_inverse=True)
            rows = space.rows(distinct)[at]
            cuts = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
            names, scores = [UNKNOWN] * (b - a), np.zeros(b - a)
            for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > s and len(langs):
                    vector = space.vector(rows[s:e], counts[s:e]).astype(np.float64)
                    cosines = known @ vector / max(np.linalg.norm(vector), 1e-30)
                    best = int(np.argmax(cosines))
                    names[i], scores[i] = langs[best], min(1.0, max(0.0, float(cosines[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text: the closest prototype and its cosine, from 0 to 1.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing has been learnt; of equally
    close prototypes the first by name wins. Rows with a null or repeated id are judged like any other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    matrix = np.array(list(known.values())) if known else np.zeros((0, DIMENSIONS))
    return rows.mapInArrow(partial(_predict, langs=list(known), known=matrix), "doc_id long, lang_pred string, score double")
