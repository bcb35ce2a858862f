"""Connected components of a link table, without gathering it anywhere.

Links are first thinned by union-find inside each partition (only a spanning forest of a partition's links goes
on). Then the graph is contracted: every node moves to the best node of its neighbourhood, links follow, and the
moves are composed until no link is left. The best node is the smallest id in the first rounds, which settles
stars at once, and the smallest hash in every other later round, which halves long chains whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch

ID_ROUNDS = 2


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node that each is joined with by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, roots = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        rest = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(roots[rest]), pa.array(nodes[rest])], ["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(a long, b long) -> (node, component): each node of a link and the smallest node reachable from it.

    Links with a null end and links of a node with itself say nothing and are left out. An empty table gives an
    empty table. The result is a table of `scratch`.
    """
    edges = scratch.write(links.where("a <> b").mapInArrow(_thin, "a long, b long").distinct())
    moved, turn, shuffled = None, 0, False
    while turn == 0 or not edges.isEmpty():
        by_hash = turn >= ID_ROUNDS and turn % 2 == 0
        shuffled |= by_hash
        rank = (lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c), c.alias("v"))) if by_hash else (lambda c: F.struct(c.alias("v")))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a"))
        step = scratch.write(both.groupBy("u").agg(F.min(rank(F.col("w"))).alias("best")).select("u", F.least(rank(F.col("u")), "best")["v"].alias("to")))
        left, right = step.select(F.col("u").alias("a"), F.col("to").alias("a_to")), step.select(F.col("u").alias("b"), F.col("to").alias("b_to"))
        ends = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        old, edges = edges, scratch.write(ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if moved is None:
            moved = scratch.write(step.select(F.col("u").alias("node"), F.col("to").alias("component")))
        else:
            to = step.select(F.col("u").alias("component"), "to")
            last, moved = moved, scratch.write(moved.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            scratch.drop(last)
        scratch.drop(old, step)
        turn += 1
    scratch.drop(edges)
    if shuffled:
        least = moved.groupBy("component").agg(F.min("node").alias("least"))
        last, moved = moved, scratch.write(moved.join(least, "component").select("node", F.col("least").alias("component")))
        scratch.drop(last)
    return moved
