"""Spelling variants: words one edit apart, found in tries of letter-group counts.

A word is arranged by how often each group of letters occurs in it, group after group. One replaced letter changes such a
vector by a surplus of one and a deficit of one at most, one inserted letter by one of them; so a depth-first search of
the trie needs to follow only counts that a budget of one surplus and one deficit allows. What reaches a leaf is
verified letter by letter; a large leaf by joining hashes of words with one letter left out, so that words of one
vector are never compared all with all.

The upper levels of the trie, the word's length and its first counts, deal words into shards; a word visits the shards
that its budget reaches, and a shard of more words than BLOCK_BYTES is dealt in blocks. How many levels are upper ones
follows from the size of the vocabulary. A task searches its shard with all visitors of a trie node at once and returns
one row a word: how many near words it met there and the most frequent one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, mix

RUN = r"[A-Za-zÀ-ÿ]"
#: Letters by how common they are; each is a group. Letters beyond ASCII make four groups more.
LETTERS = "etaoinsrhldcumgpfybwvkjxqz"
GROUPS = len(LETTERS) + 4
#: Letters of a shard's words in one task, and words of a trie node that is a leaf.
BLOCK_BYTES, LEAF = 1 << 19, 24
#: A leaf with more pairs is joined by hashes; so many pairs are verified at once.
MOST_PAIRS, PAIRS_AT_ONCE = 1 << 14, 1 << 18
#: Rows of shard sizes that every task may get.
MOST_SHARDS = 50_000
#: Each form is ten times as frequent as the word before, so no chain of them is longer than a long has digits.
RATIO, MOST_FORMS = 10, 18

_group = np.full(256, GROUPS, np.uint8)
_group[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
_group[0xC0:] = len(LETTERS) + np.arange(0x40) % 4
_PARTIAL = "word string, n long, n_near long, near_n long, near string"


def word_counts(docs: DataFrame, least_letters: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of runs of letters in all whole texts, A-Z as a-z, with at least so many letters and occurrences.

    Where 31 divides crc32("doc_id:run"), the letter at that number modulo the run's length is left out first, a planted
    misspelling. A null text has no runs, a null id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{least_letters},}}"), F.lit(0))).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _first_counts(levels: int) -> list[Column]:
    return [F.length("word") - F.length(F.translate("word", c, "")) for c in LETTERS[:levels]]


def _shard(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", length, *counts)


def _reached(levels: int) -> Column:
    """The shards of the word's length and of one letter more that its budget reaches: no deficit of the word's for these."""
    counts, steps = _first_counts(levels), [(up, down) for up in range(-1, levels) for down in range(-1, levels) if up < 0 or up != down]
    moved = lambda up, down: [c + (int(k == up) - int(k == down)) for k, c in enumerate(counts)]
    same = [F.when(counts[down] > 0, _shard(F.length("word"), moved(up, down))) if down >= 0 else _shard(F.length("word"), moved(up, down)) for up, down in steps]
    longer = [_shard(F.length("word") + 1, moved(up, -1)) for up in range(-1, levels)]
    return F.filter(F.array(*same, *longer), lambda s: s.isNotNull())


class Shard:
    """Words of one length and their visitors, of the same length or one letter less, as rows of letters."""

    def __init__(self, home: list[str], visitors: list[str]) -> None:
        self.n, self.width = len(home), len(home[0])
        raw = [w.encode("latin-1") for w in (*home, *visitors)]
        size = np.array([len(w) for w in raw])
        self.letters = np.zeros((len(raw), self.width), np.uint8)
        full = size == self.width
        self.letters[full] = np.frombuffer(b"".join([w for w, f in zip(raw, full) if f]), np.uint8).reshape(-1, self.width)
        self.letters[~full, : self.width - 1] = np.frombuffer(b"".join([w for w, f in zip(raw, full) if not f]), np.uint8).reshape(-1, self.width - 1)
        self.shorter = ~full
        groups = _group[self.letters]
        self.counts = np.stack([(groups == g).sum(axis=1) for g in range(GROUPS)])
        self.order = np.lexsort(self.counts[::-1, : self.n])  # the trie: words by their vectors, a node is a range
        self.found: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_pairs = 0

    def links(self) -> np.ndarray:
        """Pairs (visitor, home word) one edit apart; of words of one length, the visitor is the smaller one."""
        visitors = np.arange(self.n, len(self.letters))
        surplus = np.where(self.shorter[visitors], 0, 1).astype(np.int8)
        self._search(0, 0, self.n, visitors, surplus, np.ones(len(visitors), np.int8))
        self._verify()
        return np.concatenate([np.zeros((2, 0), np.int64), *self.found], axis=1)

    def _search(self, level: int, lo: int, hi: int, visitors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Depth first below the node of the words order[lo:hi], with the visitors that are left and what they may still spend."""
        if hi - lo <= LEAF or level == GROUPS:
            self._leaf(self.order[lo:hi], visitors)
            return
        own, theirs = self.counts[level, self.order[lo:hi]], self.counts[level, visitors]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), hi - lo]
        for a, b in zip(cuts[:-1], cuts[1:]):
            more = theirs - own[a]
            left, right = surplus - (more > 0), deficit - (more < 0)
            stay = np.flatnonzero((np.abs(more) <= 1) & (left >= 0) & (right >= 0))
            if len(stay):
                self._search(level + 1, lo + a, lo + b, visitors[stay], left[stay], right[stay])

    def _leaf(self, home: np.ndarray, visitors: np.ndarray) -> None:
        if len(home) * len(visitors) > MOST_PAIRS:
            for kind in (False, True):
                self._join(home, visitors[self.shorter[visitors] == kind], kind)
            return
        self.pairs.append((np.repeat(visitors, len(home)), np.tile(home, len(visitors))))
        self.n_pairs += len(home) * len(visitors)
        if self.n_pairs > PAIRS_AT_ONCE // max(1, self.width // 16):
            self._verify()

    def _join(self, home: np.ndarray, visitors: np.ndarray, shorter: bool) -> None:
        """Candidates of a large leaf: equal hashes of words without one letter, place by place."""
        if not len(visitors):
            return
        keys = mix(np.arange(1, self.width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        term = lambda rows, shift=0: mix(self.letters[rows].astype(np.uint64) ^ (np.roll(keys, shift) if shift else keys))
        own = term(home)
        if shorter:  # without a letter, those behind it are one place further to the left
            moved = term(home, 1)
            before = np.cumsum(own, axis=1) - own
            after = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1] - moved
            theirs = term(visitors)[:, :-1].sum(axis=1)
        else:
            theirs = term(visitors)
        for place in range(self.width):
            a = before[:, place] + after[:, place] if shorter else own.sum(axis=1) - own[:, place]
            b = theirs if shorter else theirs.sum(axis=1) - theirs[:, place]
            order = np.argsort(a, kind="stable")
            lo, hi = np.searchsorted(a[order], b), np.searchsorted(a[order], b, side="right")
            each = hi - lo
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
            pairs = np.repeat(visitors, each), home[order[at]]
            if shorter:  # a letter that is doubled can be left out at two places; the first one counts
                again = (self.letters[pairs[1], place - 1] == self.letters[pairs[1], place]) if place else np.zeros(len(at), bool)
                pairs = pairs[0][~again], pairs[1][~again]
            self.pairs.append(pairs)
            self._verify()

    def _verify(self) -> None:
        if not self.pairs:
            return
        visitors, home = (np.concatenate(x) for x in zip(*self.pairs))
        self.pairs, self.n_pairs = [], 0
        for shorter in (False, True):
            own = self.shorter[visitors] == shorter
            v, h = visitors[own], home[own]
            x, y = self.letters[v], self.letters[h]
            if shorter:
                front = np.logical_and.accumulate(x[:, :-1] == y[:, :-1], axis=1).sum(axis=1)
                back = np.logical_and.accumulate((x[:, :-1] == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                near = front + back >= self.width - 1
            else:
                near = ((x != y).sum(axis=1) == 1) & ((x < y).sum(axis=1) == 1)
            self.found.append(np.stack([v[near], h[near]]))


def _near(home: pa.Table, visitors: pa.Table) -> pa.Table:
    """One row for each home word, and for each visitor that is near one: near words met here and the most frequent of them."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    if not home.num_rows:
        return schema.empty_table()
    words = pa.concat_arrays([t.column("word").combine_chunks().cast(pa.string()) for t in (home, visitors)])
    n = np.concatenate([t.column("n").to_numpy() for t in (home, visitors)])
    shard = Shard(home.column("word").to_pylist(), visitors.column("word").to_pylist())
    a, b = shard.links()
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(np.ascontiguousarray(shard.letters).view(f"S{shard.width}").ravel(), kind="stable")] = np.arange(len(n))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
    n_near, near = np.zeros(len(n), np.int64), np.full(len(n), -1)
    n_near[one[first]], near[one[first]] = np.diff(np.append(first, len(one))), other[first]
    rows = np.flatnonzero((np.arange(len(n)) < shard.n) | (near >= 0))
    best = pa.array(near[rows], mask=near[rows] < 0)
    return pa.table([words.take(pa.array(rows)), pa.array(n[rows]), pa.array(n_near[rows]), pa.array(n[near[rows]], mask=near[rows] < 0), words.take(best)], schema=schema)


def upper_levels(letters: int) -> int:
    """Levels of counts that deal words into shards: about a third of a shard's words share the next count."""
    levels, left = 0, letters / (4 * BLOCK_BYTES)
    while left > 1 and levels < 8:
        levels, left = levels + 1, left / 3
    return levels


def _near_words(words: DataFrame, levels: int, block: int) -> DataFrame:
    home = words.select("word", "n", _shard(F.length("word"), _first_counts(levels)).alias("shard"))
    shards = home.groupBy("shard").agg(F.ceil(F.sum(F.length("word")) / block).cast("int").alias("blocks"))
    if shards.count() <= MOST_SHARDS:
        shards = F.broadcast(shards)
    others = lambda name: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name)
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    home = home.join(shards, "shard").select("word", "n", "shard", own.alias("i"), others("j"))
    visits = words.select(F.col("word").alias("word"), F.col("n").alias("n"), F.explode(_reached(levels)).alias("shard")).join(shards, "shard").select("word", "n", "shard", others("i"), own.alias("j"))
    keys = ["shard", "i", "j"]
    partial = home.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_near, _PARTIAL)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))).alias("best")
    return partial.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)


def spelling_variants(words: DataFrame, block: int = BLOCK_BYTES, levels: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) of letters up to U+00FF.

    n_near counts words one inserted, deleted or replaced letter away. form is the most frequent of them (ties: the
    smallest) if it is at least ten times as frequent as the word, else null; root is the last of a word's forms, the word
    itself if it has none. Null words are left out; an empty table gives no row.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.write(words.where("word is not null and word <> ''").select("word", "n"))
    letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    near = scratch.write(_near_words(words, upper_levels(letters) if levels is None else levels, block))
    frequent = -F.col("best.n") >= RATIO * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n"))
    roots = scratch.write(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(MOST_FORMS.bit_length()):  # each turn doubles how far a word has been followed
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, roots = roots, scratch.write(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(last)
        if roots.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
