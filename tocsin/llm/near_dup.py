"""MinHash near-duplicate grouping with SuperMinHash signatures.

Each distinct word shingle of a document draws a random permutation of the signature's places, one rank after the
other, and offers rank + uniform(0, 1) to the place of that rank (Ertl, "SuperMinHash", 2017). Ranks are drawn for
all shingles of a few megabytes of text together and stop for a document once no place can still improve, mostly
after two ranks. Bands of the signature are joined to find candidates, which are then confirmed on whole shingle sets.

Documents with equal shingle sets are folded into one class before anything is joined, with map-side combining, and
bands with the same members count once. In a bucket, one pivot is compared with the other members first, which connects
most of a group of near copies at the cost of one comparison each. Then whoever isn't connected with a bucket's largest
group is compared with all that it isn't connected with, in blocks by products of incidence matrices, so that only close
pairs leave a task. Members meet a pivot in parts, blocks meet one by one, and a pivot's set is sent once for each part, so
that no task gets a whole bucket. For pivots, pairs whose signatures, cut to four bits a place, differ in
more places than a pair at the threshold would at five standard deviations, aren't candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, as_long, chunks, lists, mix, small_batches, split_words, text_buffer, windows
from tocsin.llm.components import components

#: A pair of similarity 0.8 meets in one of 30 bands of 5 with a probability of 1 - (1 - 0.8 ** 5) ** 30 = 0.999993.
ROWS, BANDS = 5, 30
#: Further pivots are taken while open pairs are more than FEW_PAIRS for each row of a bucket, and each halves them.
FEW_PAIRS = 8
DEVIATIONS = 5.0
#: Rows of a bucket that are compared with others at once.
BLOCK = 64
#: Rows of a bucket that meet its pivot in one part, and parts over which any band's rows are spread before its size is known.
PART, SALTS = 256, 32
_FRACTION_BITS = 40


def superminhash(items: np.ndarray, ptr: np.ndarray, size: int) -> np.ndarray:
    """Signatures of `size` places of the sets items[ptr[i]:ptr[i + 1]] of 64-bit hashes. An empty set has all ones."""
    n = len(ptr) - 1
    places = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    doc, left, drawn = np.repeat(np.arange(n), np.diff(ptr)), items, []
    for rank in range(size):
        if rank:
            worst = places.reshape(n, size).max(axis=1)
            open_ = (worst >= np.uint64(rank << _FRACTION_BITS))[doc]
            if not open_.all():
                doc, left, drawn = doc[open_], left[open_], [d[open_] for d in drawn]
        if not len(left):
            break
        bits = mix(left + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        drawn.append((rank + ((bits >> np.uint64(_FRACTION_BITS)) * np.uint64(size - rank) >> np.uint64(64 - _FRACTION_BITS)).astype(np.int64)).astype(np.int16))
        place = drawn[rank].astype(np.int64)
        for earlier in range(rank - 1, -1, -1):
            place[drawn[earlier] == place] = earlier
        np.minimum.at(places, doc * size + place, np.uint64(rank << _FRACTION_BITS) | (bits & np.uint64((1 << _FRACTION_BITS) - 1)))
    return places.reshape(n, size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each document's begin."""
    words = split_words(data, offsets, fold)
    hashes, fits = windows(words, shingle)
    sets = []
    for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist()):
        if b - a >= shingle:
            own = np.sort(hashes[a : b - shingle + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            total = np.uint64(b - a)
            for h in words.hash[a:b]:
                total = mix(np.atleast_1d(total) * np.uint64(0xD6E8FEB86659FD93) + h)[0]
            sets.append(np.array([total], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, fold: bool, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets):
            items, ptr = shingle_sets(data, offsets[a : b + 1], shingle, fold)
            n = np.diff(ptr)
            full = n > 0
            finger = np.zeros((2, b - a), np.uint64)
            if full.any():
                finger[0, full] = np.add.reduceat(items, ptr[:-1][full])
                finger[1, full] = np.bitwise_xor.reduceat(mix(items + np.uint64(7)), ptr[:-1][full])
            signature = superminhash(items, ptr, rows * bands).reshape(b - a, bands, rows)
            cut = np.zeros((b - a, -(-rows * bands // 16) * 16), np.uint64)
            cut[:, : rows * bands] = signature.reshape(b - a, -1) >> np.uint64(2) & np.uint64(15)
            cut = (cut.reshape(b - a, -1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            band = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (b - a, 1))
            for row in range(rows):
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + signature[:, :, row])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), as_long(n), as_long(finger[0]), as_long(finger[1]), lists(band.ravel(), np.arange(b - a + 1) * bands), lists(cut.ravel(), np.arange(b - a + 1) * cut.shape[1])],
                ["doc_id", "n_shingles", "finger1", "finger2", "bands", "places"],
            )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, fold: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in chunks(offsets):
            items, ptr = shingle_sets(data, offsets[a : b + 1], shingle, fold)
            short, cuts = (items >> np.uint64(32)).astype("<u4").tobytes(), (4 * ptr).tolist()
            brief = pa.array([short[s:e] for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(items, ptr), brief], ["rep", "items", "brief"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of two blocks that are in different groups and whose sets, cut to 32 bits a shingle, are close.

    Two shingles of tolerance stand for what cutting may have folded; the pairs are confirmed on whole sets later.
    """
    for batch in batches:
        found = [np.zeros((2, 0), np.int64)]
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sides = []
            for side in (x, y):
                sets = [np.frombuffer(r["brief"], "<u4") for r in side]
                rep, group = (np.array([r[c] for r in side], np.int64) for c in ("rep", "group"))
                sizes = np.array([len(s) for s in sets])
                sides.append((rep, group, sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)))
            both = np.intersect1d(np.unique(sides[0][3]), np.unique(sides[1][3]), assume_unique=True)
            if not len(both):
                continue
            tables = []
            for _, _, sizes, values, row in sides:
                at = np.minimum(np.searchsorted(both, values), len(both) - 1)
                own = both[at] == values
                table = np.zeros((len(sizes), len(both)), np.float32)
                table[row[own], at[own]] = 1
                tables.append(table)
            (a, ga, na, _, _), (b, gb, nb, _, _) = sides
            common = tables[0] @ tables[1].T + 2
            i, j = np.nonzero((100 * common >= percent * (na[:, None] + nb[None, :] - common)) & (ga[:, None] != gb[None, :]))
            found.append(np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])]))
        a, b = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(hub, other, part) whose sets have 100 * intersection >= percent * union, as links (a, b).

    A hub may have many pairs; its set goes once to each of their parts.
    """
    items = lambda x: sets.select(F.col("rep").alias(x), F.col("items").alias(f"{x}_items"))
    hubs = pairs.select("hub", "part").distinct().join(items("hub"), "hub")
    both = pairs.join(items("other"), "other").join(hubs.hint("merge"), ["hub", "part"])
    sizes = both.select("hub", "other", (F.size("hub_items") + F.size("other_items")).alias("total"), F.size(F.array_intersect("hub_items", "other_items")).alias("common"))
    near = sizes.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
    return near.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


def _parts(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / PART) - 1))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, fold: bool = True, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """Group near-duplicate documents: (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    A document's set holds its distinct shingles of `shingle` words (fewer words: the whole sequence); fold lets A-Z
    count as a-z. Documents are linked when 100 * intersection >= percent * union; component_id is the smallest id
    reachable by links, kept says that it is the document's own. A document without words, or with a null text, is
    linked with nothing. A row with a null id is linked with nothing, has a null component and is kept. Rows that
    repeat an id are one node of the graph and all returned. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = ["finger1", "finger2", "n_shingles"]
    sketched = scratch.write(text.mapInArrow(partial(_sketch, shingle=shingle, fold=fold, rows=rows, bands=bands), "doc_id long, n_shingles long, finger1 long, finger2 long, bands array<long>, places array<long>"))
    with_words = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(with_words.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "places"), "doc_id").alias("own")))
    sketches = scratch.write(sketched.select("doc_id", *key))
    scratch.drop(sketched)

    rows_ = classes.select(F.explode("own.bands").alias("band"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(41)), F.lit(SALTS)).cast("int"))
    shared = rows_.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1")
    shared = shared.groupBy("n", "first", "members").agg(F.min("band").alias("band"))
    shared = shared.select("band", F.col("n").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    buckets = rows_.join(shared, ["band", "salt"]).join(classes.select("rep", "n_shingles", "own.places"), "rep")
    buckets = scratch.write(buckets.select("band", F.pmod(F.xxhash64("rep", F.lit(43)), F.ceil(F.col("size") / PART)).alias("part"), "rep", "n_shingles", "places"))
    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.write(text.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(partial(_sets, shingle=shingle, fold=fold), "rep long, items array<long>, brief binary"))

    m, q = rows * bands, (1 - percent / 100) * 15 / 16
    most_differ = m * q + DEVIATIONS * (m * q * (1 - q)) ** 0.5

    def candidate(x: str, y: str) -> Column:
        """Whether the rows x and y may be linked, by their sizes and signatures."""
        differ = F.lit(0)
        for k in range(-(-m // 16)):
            bits = F.get(f"{x}.places", F.lit(k)).bitwiseXOR(F.get(f"{y}.places", F.lit(k)))
            for shift in (2, 1):
                bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
            differ += F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))
        a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ <= most_differ)

    groups, tested, before = None, None, None
    while True:
        if groups is None:
            labelled = buckets.withColumn("group", F.col("rep"))
        else:
            labelled = buckets.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component")
        turn = F.lit(0) if groups is None else F.xxhash64("rep", F.lit(before or 0))
        parts = labelled.groupBy("band", "group").agg(F.count("*").alias("n"), F.min_by(F.struct("rep", "n_shingles", "places"), F.struct(turn, "rep")).alias("pivot"))
        open_ = parts.groupBy("band").agg(
            F.count("*").alias("parts"), F.min_by(F.struct("pivot", "group"), F.struct("n", "group")).alias("smallest"), F.max(F.struct("n", "group")).alias("largest"), F.sum("n").alias("n")
        )
        open_ = open_.where("parts > 1").select("band", "smallest.pivot", F.col("smallest.group").alias("pivot_group"), F.col("largest.group").alias("largest"), (F.col("n") - F.col("largest.n")).alias("outside"), "n")
        last = False
        if groups is not None:
            open_ = scratch.write(open_)
            n, pairs_left = open_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("outside")), F.lit(0))).first()
            if not n:
                break
            last = pairs_left <= FEW_PAIRS * n or (before is not None and 2 * pairs_left > before)
            before = pairs_left
        meet = open_.withColumn("part", _parts(F.col("n")))
        if last:
            here = labelled.join(meet, ["band", "part"]).join(sets.select("rep", "brief"), "rep")
            block = lambda of: F.pmod(F.xxhash64("rep"), F.ceil(F.col(of) / BLOCK))
            rows_of = lambda df, of, x, *more: df.groupBy("band", block(of).alias(f"{x}_block")).agg(F.collect_list(F.struct("rep", "group", "brief")).alias(x), *more)
            xs = rows_of(here.where("group <> largest"), "outside", "x", F.first("n").alias("n"))
            xs = xs.withColumn("y_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)))
            met = xs.join(rows_of(here, "n", "y"), ["band", "y_block"]).select("x", "y")
            pairs = met.mapInArrow(partial(_close, percent=percent), "a long, b long").distinct()
            pairs = pairs.select(F.col("a").alias("hub"), F.col("b").alias("other"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("part"))
        else:
            met = labelled.select("band", "part", F.struct("rep", "n_shingles", "places", "group").alias("x")).join(meet.select("band", "part", "pivot_group", F.col("pivot").alias("y")), ["band", "part"])
            met = met.where((F.col("x.group") != F.col("pivot_group")) & candidate("x", "y"))
            pairs = met.groupBy(F.col("y.rep").alias("hub"), F.col("x.rep").alias("other")).agg(F.min("part").alias("part"))
        least, most = F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")
        pairs = scratch.write((pairs.select("*", least, most).join(tested, ["a", "b"], "left_anti") if tested else pairs).select("hub", "other", "part"))
        now = pairs.select(least, most)
        tested = tested.union(now) if tested else now
        found = scratch.write(_confirm(pairs, sets, percent).distinct())
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found) if groups else found
        old, groups = groups, components(stars, scratch)
        scratch.drop(old)
        if last:
            break
    scratch.drop(sets, buckets)

    named = scratch.write(classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id")))
    scratch.drop(classes)
    result = sketches.join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
