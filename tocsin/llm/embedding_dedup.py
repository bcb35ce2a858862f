"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learnt from a bounded sample so that signs make balanced binary codes
(Gong et al., "Iterative quantization", 2013); codes of more bits than dimensions get several rotations. Codes are
split into substrings, one a table; two codes are compared when some substring differs in at most one bit, which finds
every pair of codes at a Hamming distance below twice the tables (Norouzi et al., "Fast exact search in Hamming space
with multi-index hashing", 2014). A substring has as many bits as log2 of the vectors of the largest label, so that a
bucket of a table doesn't grow with them, and there are as many tables as a pair at the threshold needs to meet in one of
them; a bucket that is heavy even so is split. Codes don't bound cosines, so links may be lost; `exact` uses cells of a
grid over three principal components instead, whose width no linked pair exceeds.

Equal vectors are folded into one row with a count first. Rows of one code make a cell, kept in blocks of about BLOCK
vectors, and pairs of blocks are dealt one by one, so a cell of near copies is spread. Each pair is compared by one
product of matrices in double precision, which returns counts and a spanning forest of the links, never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch, lists
from tocsin.llm.components import components

#: Principal components that are quantised; bits of a substring, at least and most; chance of a pair at the threshold to meet.
BITS, LEAST_SUB, MOST_SUB, MEETS = 64, 16, 40, 0.99
#: Cells of a bucket that one task compares with those that ask for it.
BUCKET = 4096
SAMPLE, ROUNDS = 8192, 40
BLOCK = 256
#: Parts over which the rows of one cell are spread while they get their blocks.
SALTS = 32
GRID_AXES, GRID_BITS = 3, 10
#: Share of a code's bits; cells further apart aren't compared. A pair at cosine 0.98 differs in 0.064 on average.
MOST_APART = 20 / 64


class Layout(NamedTuple):
    """Bits of a substring, tables, and the 64-bit words of a code, each of which holds whole substrings."""

    sub: int
    tables: int

    @property
    def a_word(self) -> int:
        return min(64 // self.sub, self.tables)

    @property
    def words(self) -> int:
        return -(-self.tables // self.a_word)

    @property
    def bits(self) -> int:
        return self.sub * self.tables


def layout(vectors: int, least: float) -> Layout:
    """Substrings for so many vectors of one label: a bit of a pair at the threshold differs with the chance angle / pi."""
    sub = min(MOST_SUB, max(LEAST_SUB, (max(vectors, 1) - 1).bit_length()))
    differs = math.acos(max(-1.0, min(1.0, least))) / math.pi
    apart = 1 - (1 - differs) ** sub - sub * differs * (1 - differs) ** (sub - 1)
    tables = math.ceil(math.log(1 - MEETS) / math.log(min(apart, 0.75))) if apart > 0 else 1
    return Layout(sub, max(tables, 4))


def _rotated(shown: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """A rotation that brings the rows of `shown` close to the corners of a cube, from a random one."""
    rotation = np.linalg.qr(rng.normal(size=(shown.shape[1], shown.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(shown @ rotation >= 0, 1.0, -1.0).T @ shown)
        rotation = (u @ vt).T
    return rotation


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 5, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of unit vectors, their projection (dimensions x bits), and their first principal axes for a grid."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, basis = np.linalg.eigh(centred.T @ centred)
    basis = basis[:, ::-1][:, :BITS]
    shown, rng = centred @ basis, np.random.default_rng(seed)
    turns = -(-bits // basis.shape[1])
    return mean, np.concatenate([basis @ _rotated(shown, rounds, rng) for _ in range(turns)], axis=1)[:, :bits], basis[:, :GRID_AXES]


def _unlearnt(size: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As learn_rotation for vectors of a length that isn't the usual one: random directions."""
    rng = np.random.default_rng(size)
    return np.zeros(size), rng.normal(size=(size, bits)), np.linalg.qr(rng.normal(size=(size, min(size, GRID_AXES))))[0]


def _unit(rows: list, n: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), n)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(batches: Iterator[pa.RecordBatch], at: int, learnt: tuple[np.ndarray, np.ndarray, np.ndarray], shape: Layout, width: float | None) -> Iterator[pa.RecordBatch]:
    """Adds `words`, the signs of the projection, or with a width the cell of a grid as one word."""
    n_words = shape.words if width is None else 1
    for batch in batches:
        rows = batch.column(at).to_pylist()
        words, sizes = np.zeros((len(rows), n_words), np.uint64), np.array([len(r) for r in rows], np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            mean, projection, axes = learnt if size == len(learnt[0]) else _unlearnt(size, shape.bits)
            x = _unit([rows[i] for i in own], size) - mean
            if width is None:
                signs = (x @ projection > 0).astype(np.uint64)
                for k in range(n_words):
                    part = signs[:, k * shape.a_word * shape.sub : (k + 1) * shape.a_word * shape.sub]
                    words[own, k] = (part << np.arange(part.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            else:
                cell = np.floor(x @ axes / width).astype(np.int64) + (1 << GRID_BITS - 1)
                words[own, 0] = (cell << GRID_BITS * np.arange(cell.shape[1])).sum(axis=1).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, lists(words.ravel(), np.arange(len(rows) + 1) * n_words)], [*batch.schema.names, "words"])


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of each row, and a spanning forest of them: (kind 0, rep, links) and (kind 1, rep, smaller rep)."""
    for batch in batches:
        out: list[np.ndarray] = []
        for same, left, right in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a, b = (np.array([r["rep"] for r in side], np.int64) for side in (left, right))
            m, n = (np.array([r["copies"] for r in side], np.int64) for side in (left, right))
            size = len(left[0]["vector"])
            near = _unit([r["vector"] for r in left], size) @ _unit([r["vector"] for r in right], size).T >= least
            if same:
                near &= a[:, None] != b[None, :]
            if not near.any():
                continue
            links = [(a, near @ n)] if same else [(a, near @ n), (b, m @ near)]
            for ids, count in links:
                out.append(np.stack([np.zeros(int((count > 0).sum()), np.int64), ids[count > 0], count[count > 0]]))
            far = np.iinfo(np.int64).max
            la, lb = a.copy(), b.copy()
            while True:
                na = np.minimum(la, np.where(near, lb[None, :], far).min(axis=1))
                nb = np.minimum(lb, np.where(near, na[:, None], far).min(axis=0))
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
            for ids, label in ((a, la), (b, lb)):
                moved = ids != label
                out.append(np.stack([np.ones(int(moved.sum()), np.int64), ids[moved], label[moved]]))
        rows = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], ["kind", "a", "b"])


def _sub(words: Column, table: int, shape: Layout) -> Column:
    word, place = divmod(table, shape.a_word)
    return F.shiftrightunsigned(F.get(words, F.lit(word)), place * shape.sub).bitwiseAND(F.lit((1 << shape.sub) - 1))


def _candidates(cells: DataFrame, shape: Layout) -> DataFrame:
    """Pairs (label, size, code_a, words_a, code_b, words_b, table) of cells that meet in a table."""
    key = ["label", "size", "table", "sub"]
    subs = F.explode(F.array(*(F.struct(F.lit(t).alias("table"), _sub(F.col("words"), t, shape).alias("sub")) for t in range(shape.tables)))).alias("s")
    side = lambda x: cells.select("label", "size", F.col("code").alias(f"code_{x}"), F.col("words").alias(f"words_{x}"), subs).select("label", "size", f"code_{x}", f"words_{x}", "s.*")
    home, probes = side("b"), F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(shape.sub)))
    asked = side("a").withColumn("flip", F.explode(probes)).withColumn("sub", F.col("sub").bitwiseXOR(F.col("flip"))).drop("flip")
    heavy = home.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select(*key, F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    home = home.join(heavy, key, "left").withColumn("part", F.pmod(F.xxhash64("code_b"), parts).cast("int")).drop("parts")
    asked = asked.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return asked.join(home, [*key, "part"]).where(F.col("code_a") < F.col("code_b"))


def _near_codes(cells: DataFrame, shape: Layout) -> DataFrame:
    """Pairs (label, size, code_a < code_b) of cells that some table finds, each once."""
    apart = F.zip_with("words_a", "words_b", lambda a, b: a.bitwiseXOR(b))
    bits = sum((F.bit_count(F.get(apart, F.lit(k))) for k in range(shape.words)), F.lit(0))
    first = F.coalesce(*(F.when(F.bit_count(_sub(apart, t, shape)) <= 1, t) for t in range(shape.tables)))  # a pair counts in its first table alone
    pairs = _candidates(cells, shape).where((bits <= int(MOST_APART * shape.bits)) & (first == F.col("table")))
    return pairs.select("label", "size", "code_a", "code_b")


def _near_grid(cells: DataFrame) -> DataFrame:
    """Pairs of neighbouring cells of the grid, each once."""
    steps = [x + (y << GRID_BITS) + (z << 2 * GRID_BITS) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    next_to = F.explode(F.array(*(F.lit(s).cast("long") for s in steps if s > 0)))
    asked = cells.select("label", "size", F.col("code").alias("code_a"), next_to.alias("step")).withColumn("code_b", F.col("code_a") + F.col("step"))
    return asked.join(cells.select("label", "size", F.col("code").alias("code_b")), ["label", "size", "code_b"]).select("label", "size", "code_a", "code_b")


def near_vectors(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = BLOCK, exact: bool = False, shape: Layout | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of table.

    Vectors are linked when their labels are equal and not null (label_col None: always) and their cosine is at least
    `least`; component_id is the smallest id reachable by links, kept says that it is the vector's own. A vector that
    is null, empty, zero, or holds null or non-finite components is linked with nothing; vectors of different lengths
    are never linked. A row with a null id is linked with nothing, has a null component and is kept. Rows that repeat
    an id are links of each other if their vectors are close, and share the component. Other columns are ignored.
    exact finds all links, at the cost of more comparisons. shape: other tables than those that the vectors ask for.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    vector = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull()
    fit &= F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fit, label).alias("label"), F.when(fit, vector).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(11), "vector")})
    key = ["label", "h1", "h2"]
    folded = rows.where("vector is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("vector", "vec_id").alias("vector"))
    folded = scratch.write(folded.select(*key, "rep", "copies", F.size("vector").alias("size"), "vector"))
    sample = folded.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(SAMPLE).select("vector").toArrow().column("vector").to_pylist()  # a bounded sample
    sizes = [len(v) for v in sample]
    usual = max(set(sizes), key=sizes.count) if sizes else 1
    if shape is None:
        largest = folded.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        shape = layout(largest, least)
    learnt = learn_rotation(_unit([v for v in sample if len(v) == usual], usual), bits=shape.bits) if sizes else _unlearnt(1, shape.bits)
    width = max(2 - 2 * least, 1e-4) ** 0.5 * (1 + 1e-6) if exact else None
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema.fields)
    coded = folded.mapInArrow(partial(_code, at=folded.columns.index("vector"), learnt=learnt, shape=shape, width=width), f"{types}, words array<long>")
    code = F.col("words")[0] if exact or shape.words == 1 else F.xxhash64("words")
    coded = scratch.write(coded.withColumn("code", code))
    names = scratch.write(folded.select(*key, "rep", "copies"))
    scratch.drop(folded)

    cell = ["label", "size", "code"]
    cells = scratch.write(coded.groupBy(*cell).agg(F.count("*").alias("n"), F.first("words").alias("words")).select(*cell, "words", "n", F.ceil(F.col("n") / block).alias("blocks")))
    large = cells.where("blocks > 1").select(*cell, "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(23)), F.lit(SALTS)).cast("int")).hint("merge")
    blocks = salted.join(large, [*cell, "salt"], "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))))
    blocks = scratch.write(blocks.groupBy(*cell, "block").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("rows")))

    pairs = _near_grid(cells) if exact else _near_codes(cells, shape)
    written = scratch.write(pairs.union(cells.where("n > 1").select("label", "size", "code", "code")))
    n_blocks = lambda x: cells.select("label", "size", F.col("code").alias(f"code_{x}"), F.col("blocks").alias(f"n_{x}"))
    pairs = written.join(n_blocks("a"), ["label", "size", "code_a"]).join(n_blocks("b"), ["label", "size", "code_b"])
    pairs = pairs.withColumn("block_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_a") - 1)))
    side = lambda x: blocks.select("label", "size", F.col("code").alias(f"code_{x}"), F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}")).hint("merge")
    met = pairs.join(side("a"), ["label", "size", "code_a", "block_a"])
    start = F.when(F.col("code_a") == F.col("code_b"), F.col("block_a")).otherwise(F.lit(0).cast("long"))
    met = met.withColumn("block_b", F.explode(F.sequence(start, F.col("n_b") - 1))).join(side("b"), ["label", "size", "code_b", "block_b"])
    same = (F.col("code_a") == F.col("code_b")) & (F.col("block_a") == F.col("block_b"))
    found = scratch.write(met.select(same.alias("same"), "rows_a", "rows_b").mapInArrow(partial(_compare, least=least), "kind int, a long, b long"))
    scratch.drop(coded, blocks, written)

    groups = components(found.where("kind = 1").select("a", "b"), scratch)
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    named = names.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.write(named.select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = rows.select("vec_id", *key, F.col("vector").isNotNull().alias("fit")).withColumn("label", F.when(F.col("fit"), F.col("label"))).join(named, key, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
