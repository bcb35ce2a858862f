"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words and the beginnings of longer ones. A term weighs (1 + log count) * idf * relevance: idf counts all
documents, relevance is LEAST_RELEVANCE plus the squared log ratio of the smoothed shares of toxic and other examples
that hold it, so no term is dropped, but a few insults in a long text aren't drowned by its other words (with plain
TF-IDF a third to two thirds of them are). A text's length counts its terms outside all examples too.

All examples but a calibration fold lie in the index. Terms that few examples hold have postings, which are summed for
each text; terms that many hold lie in blocks of examples with each block's largest weight, which bounds its scores.
A search opens blocks by falling bound, twice as many each time, and stops when no block can reach the k-th best score:
the k nearest are exact. Their votes, weighted by closeness and by how many labelled rows an example stands for, go
through a monotone map that is fitted on the calibration fold, which makes them probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, chunks, hash_ranges, refuse, small_batches, text_buffer

#: Labelled examples of each class that are learnt from at most, and neighbours.
EXAMPLES, NEIGHBOURS = 1500, 15
#: One example of so many is for calibration.
CALIBRATION = 5
BLOCK = 64
#: A term in at least 1 of so many examples lies in blocks, others have postings.
FREQUENT = 8
BEGINNINGS = (5,)
#: Documents of the average class mixture that are added to a term's counts, and the relevance of a term that tells nothing.
SMOOTHING, LEAST_RELEVANCE = 5.0, 0.02
#: Terms that no example holds share document frequencies by this many hash buckets; they only enter a text's length.
BUCKET_BITS = 16
#: Bytes of text that are taken apart at once.
TEXT_BYTES = 1 << 18
#: Votes of the class sizes that are added to each score.
PRIOR_WEIGHT = 0.5

_letter = np.zeros(256, bool)
_letter[ord("a") : ord("z") + 1] = _letter[ord("A") : ord("Z") + 1] = True
_letter[0x80:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the documents data[offsets[i]:offsets[i + 1]], and the document of each."""
    lo = int(offsets[0])
    buffer = data[lo : int(offsets[-1])]
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    accented = np.flatnonzero((buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E) & (buffer[1:] != 0x97)) + 1
    if len(accented):  # capitals with accents count as small ones, as A-Z do
        buffer = buffer.copy()
        buffer[accented] += 0x20
    letter = _letter[buffer]
    heads = letter.copy()
    heads[1:] &= ~letter[:-1]
    tails = letter.copy()
    tails[:-1] &= ~letter[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = (offsets[:-1] - lo)[full], (offsets[1:] - lo - 1)[full]
    heads[first], tails[last] = letter[first], letter[last]
    start, end = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    doc = np.searchsorted(offsets - lo, start, side="right") - 1
    found, of = [hash_ranges(buffer, start, end, fold=True)], [doc]
    for n in BEGINNINGS:
        longer = end - start > n
        found.append(hash_ranges(buffer, start[longer], start[longer] + n, fold=True) ^ np.uint64(n))
        of.append(doc[longer])
    return np.concatenate(found), np.concatenate(of)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their distinct terms and how often each occurs."""
    hashes, doc = terms(data, offsets)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    begins = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[begins], hashes[begins], np.diff(np.append(begins, len(doc)))


def _places(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the ascending `known`, and whether it is there."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        for a, b in chunks(offsets, TEXT_BYTES):
            doc, found, counts = _counted(data, offsets[a : b + 1])
            at = pa.array(np.concatenate([np.arange(b - a), doc]))  # first a row without a term for each example
            term = pa.array(np.concatenate([np.zeros(b - a, np.int64), found.view(np.int64)]), mask=np.arange(b - a + len(doc)) < b - a)
            n = pa.array(np.concatenate([np.zeros(b - a, np.int32), counts.astype(np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), term, n], ["doc_id", "toxic", "term", "n"])


def _document_counts(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of a task by place in `known`, by bucket behind these, and all of them at -1."""
    total, docs = np.zeros(len(known) + (1 << BUCKET_BITS), np.int64), 0
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        docs += batch.num_rows
        for a, b in chunks(offsets, TEXT_BYTES):
            _, hashes, _ = _counted(data, offsets[a : b + 1])
            at, own = _places(known, hashes)
            at = np.where(own, at, len(known) + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            total += np.bincount(at, minlength=len(total))
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], met]), pa.int32()), pa.array(np.concatenate([[docs], total[met]]))], ["term", "n"])


class Index:
    """Examples' vectors: postings of rare terms, blocks of BLOCK examples with each block's largest weight for others."""

    def __init__(self, example: np.ndarray, term: np.ndarray, value: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_terms: int) -> None:
        self.labels, self.weights, self.n = labels, weights, len(labels)
        size = np.bincount(term, minlength=n_terms)
        self.frequent = np.full(n_terms, -1, np.int32)
        often = np.flatnonzero(size * FREQUENT >= max(self.n, FREQUENT))
        self.frequent[often] = np.arange(len(often))
        self.blocks = -(-self.n // BLOCK)
        rows = self.frequent[term]
        self.table = np.zeros((self.blocks, len(often), BLOCK), np.float32)
        self.table[example[rows >= 0] // BLOCK, rows[rows >= 0], example[rows >= 0] % BLOCK] = value[rows >= 0]
        self.most = np.ascontiguousarray(self.table.max(axis=2).T) if self.n else np.zeros((len(often), 0), np.float32)
        rare = rows < 0
        order = np.lexsort((example[rare], term[rare]))
        self.example, self.value = example[rare][order].astype(np.int32), value[rare][order].astype(np.float32)
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=n_terms))]).astype(np.int32)

    def nearest(self, at: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Examples and cosines of the k nearest with a cosine above 0, ties by example, and how many blocks were opened."""
        row = self.frequent[at]
        rare, often = row < 0, row >= 0
        begin, size = self.ptr[at[rare]], self.ptr[at[rare] + 1] - self.ptr[at[rare]]
        places = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if rare.any() else np.zeros(0, np.int64)
        rows, weight = row[often], value[often].astype(np.float32)
        sums = np.bincount(self.example[places], np.repeat(value[rare], size) * self.value[places], minlength=self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bounds = weight @ self.most[rows] + sums.max(axis=1) if self.n else np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        found, scores, opened, wave = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while opened < len(order) and (len(found) < k or bounds[order[opened]] >= scores[-1] - 1e-5):
            now = order[opened : opened + wave]
            if len(found) == k:
                now = now[bounds[now] >= scores[-1] - 1e-5]
            own = np.round(weight @ self.table[now[:, None], rows] + sums[now], 6)
            x, y = np.nonzero(own > max(0.0, scores[-1] - 1e-6 if len(found) == k else 0.0))
            found, scores = np.concatenate([found, now[x] * BLOCK + y]), np.concatenate([scores, own[x, y]])
            best = np.lexsort((found, -scores))[:k]
            found, scores, opened, wave = found[best], scores[best], opened + len(now), 2 * wave
        return found, scores, opened


class Model:
    """What scoring needs; the sample of labelled rows bounds its size."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, bucket_weight: np.ndarray, index: Index, examples: np.ndarray, prior: float, k: int) -> None:
        self.known, self.weight, self.bucket_weight, self.index, self.examples, self.prior, self.k = known, weight, bucket_weight, index, examples, prior, k
        self.knots = np.zeros(0), np.zeros(0)

    def vectors(self, doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, places and weights of their known terms in vectors of length 1 over all their terms."""
        at, own = _places(self.known, hashes)
        value = (1 + np.log(counts)) * self.bucket_weight[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        value[own] = (1 + np.log(counts[own])) * self.weight[at[own]]
        length = np.sqrt(np.bincount(doc, value * value, minlength=n))
        return doc[own], at[own], value[own] / np.maximum(length[doc[own]], 1e-30)

    def vote(self, at: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic votes, and the neighbours with their cosines as evidence."""
        found, cosines, _ = self.index.nearest(at, value, self.k)
        cosines = np.minimum(cosines, 1.0)
        votes = self.index.weights[found] * cosines**3 / (1.05 - cosines)
        scale = PRIOR_WEIGHT * max(float(self.index.weights[found].mean()), 1e-9) if len(found) else 1.0
        return (float(votes @ self.index.labels[found]) + scale * self.prior) / (float(votes.sum()) + scale), found, cosines

    def calibrated(self, vote: float) -> float:
        return float(min(1.0, max(0.0, np.interp(vote, *self.knots) if len(self.knots[0]) else vote)))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from votes to the share of y: weighted isotonic regression, steps joined by lines.

    Each step is drawn to the prior by one row's weight, so that a step of a few rows isn't certain.
    """
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    one = float(weight.mean()) if len(weight) else 1.0
    for v, label, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        steps.append([w * label, w, w * v])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    level = np.array([(s[0] + one * prior) / (s[1] + one) for s in steps])
    return np.array([s[2] / s[1] for s in steps]), np.maximum.accumulate(level) if len(level) else level


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """Learn from labels(id, label 0/1): at most `examples` rows of each class, chosen by a hash of their id.

    Labels that are null, or whose document is missing or has no text, teach nothing. Of an id with clashing labels the
    larger one counts, of one with several texts the first in their order. Without any label every score is 0. Only the
    sample's terms and their counts come to the driver, all of a size that the sample bounds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sizes = dict(labelled.groupBy("toxic").count().collect())
    by_hash = F.xxhash64("doc_id", F.lit(17))
    sample = labelled.where("toxic = 0").orderBy(by_hash, "doc_id").limit(examples).union(labelled.where("toxic = 1").orderBy(by_hash, "doc_id").limit(examples))
    sample = spark.createDataFrame(sample.collect(), "doc_id long, toxic int")  # at most 2 * examples rows
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = text.join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    scratch = Scratch(spark)
    rows = scratch.write(held.select("text", "toxic", "doc_id").mapInArrow(_example_terms, "doc_id long, toxic int, term long, n int"))
    spares = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATION)) == 0
    owners = rows.where("term is null").select("doc_id", "toxic", spares.alias("spare")).toArrow().sort_by("doc_id")
    found = rows.where(F.col("term").isNotNull() & ~spares).select("doc_id", "term", "n").toArrow()
    scratch.drop(rows)
    ids, label, spare = (owners.column(c).to_numpy() for c in ("doc_id", "toxic", "spare"))
    ids, label, kept_for_fit = ids[~spare], label[~spare], ids[spare]
    term = found.column("term").to_numpy().view(np.uint64)
    own, count = np.searchsorted(ids, found.column("doc_id").to_numpy()), found.column("n").to_numpy()
    known, place = np.unique(term, return_inverse=True)
    counted = text.select("text").mapInArrow(partial(_document_counts, known=known), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 + len(known) + (1 << BUCKET_BITS), np.int64)
    frequency[counted.column("term").to_numpy() + 1] = counted.column("n").to_numpy()
    idf = np.log((1 + frequency[0]) / (1 + np.minimum(frequency[1:], frequency[0]))) + 1
    size = np.array([(label == 0).sum(), (label == 1).sum()])
    share = size / max(1, size.sum())
    held_by = [np.bincount(place[label[own] == c], minlength=len(known)) for c in (0, 1)]
    shares = [(held_by[c] + SMOOTHING * share[c] + 1e-9) / (size[c] + 2 * SMOOTHING * share[c] + 2e-9) for c in (0, 1)]
    relevance = LEAST_RELEVANCE + (np.log(shares[1] / shares[0]) ** 2 if size.all() else 1.0)
    stands_for = np.array([sizes.get(c, 0) / max(1, size[c]) for c in (0, 1)])
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    model = Model(known, (idf[: len(known)] * relevance).astype(np.float32), (idf[len(known) :] * LEAST_RELEVANCE).astype(np.float32), None, ids, prior, k)
    own, place, value = model.vectors(own, term, count, len(ids))
    top = np.full(len(ids), -1)  # an example's heaviest term: examples with the same one lie together, which tightens the bounds
    by_weight = np.argsort(value, kind="stable")
    top[own[by_weight]] = place[by_weight]
    turn = np.lexsort((ids, top))
    to = np.empty(len(ids), np.int64)
    to[turn] = np.arange(len(ids))
    model.index = Index(to[own], place, value, label[turn].astype(float), stands_for[label[turn]] if len(label) else np.zeros(0), len(known))
    model.examples = ids[turn]
    if len(kept_for_fit):
        fit = spark.createDataFrame([(int(i),) for i in kept_for_fit], "doc_id long")
        votes = scratch.write(held.join(F.broadcast(fit), "doc_id").select("doc_id", "text", "toxic").mapInArrow(partial(_score, model=model, evidence=0), "doc_id long, text string, toxic int, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>").select("doc_id", "toxic", "score"))
        votes = votes.toArrow().sort_by("doc_id")
        y = votes.column("toxic").to_numpy()
        per_class = np.array([sizes.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)])
        model.knots = monotone(votes.column("score").to_numpy(), y, per_class[y], prior)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, evidence: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets, TEXT_BYTES):
            doc, at, value = model.vectors(*_counted(data, offsets[a : b + 1]), b - a)
            cuts = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
            scores, seen = [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                vote, found, cosines = model.vote(at[s:e], value[s:e])
                scores.append(model.calibrated(vote))
                seen.append([{"doc_id": int(model.examples[i]), "cosine": float(c), "toxic": int(model.index.labels[i])} for i, c in zip(found[:evidence], cosines)])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(scores, pa.float64()), pa.array(seen, kind)], [*batch.schema.names, "score", "evidence"])


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), evidence: int = 3) -> DataFrame:
    """(doc_id, text, *carry, score, evidence) of every whole text, one row for each row of docs.

    score is the probability of label 1; a text without any term of an example, a null text included, gets that of
    the labelled rows' share of 1. evidence has the nearest examples with their cosines and labels. Ids and other
    columns are no inputs. Rows with a null or repeated id are scored like any other. carry names columns to hand
    through; a name of the result is refused.
    """
    refuse(carry, "doc_id", "text", "score", "evidence")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(partial(_score, model=model, evidence=evidence), f"{types}, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds
