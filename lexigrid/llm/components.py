"""Connected components of an edge table: stars within tasks, then alternating large-star and small-star rounds.

A task replaces its edges by stars around the least node of each component that it sees, which keeps the
components and takes no shuffle. Edges that fit one chunk are settled by that; more of them go to as many tasks as they
fill chunks, and what these leave is settled by rounds of joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm.common import written

MAX_ROUNDS = 60
#: Edges that a task holds as stars, 8 MB; and those that it gathers at least before it looks at them.
CHUNK, _AT_ONCE = 1 << 19, 1 << 16


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of these edges, for nodes other than it."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(place.reshape(-1), 2)
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[others], nodes[root[others]]


def _in_tasks(edges: DataFrame, chunk: int) -> DataFrame:
    """(a, b): a task's edges as stars; a task that holds more than a chunk passes them on and begins anew."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, _AT_ONCE
        batch_of = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        stars = lambda: _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            size += batch.num_rows
            if size > min(most, chunk):
                held = [stars()]
                size = len(held[0][0])
                if size > chunk:
                    yield batch_of(*held[0])
                    held, size = [], 0
                most = max(_AT_ONCE, 2 * size)
        if size:
            yield batch_of(*stars())

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to its least neighbour, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())


def connected_components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) long -> (node, root): the least node of each node's component, for nodes other than it.

    Each round is written to the shared folder, which cuts lineage; hubs are aggregated before the
    shuffle and their joins may be split.
    """
    edges = written(_in_tasks(edges.where("a <> b"), chunk), "components")
    chunks, n = math.inf, edges.count()
    while 0 < (fewer := math.ceil(n / chunk)) < chunks:
        edges, chunks = written(_in_tasks(edges.coalesce(fewer), chunk), "components"), fewer
        n = edges.count() if chunks > 1 else 0  # one chunk holds whole components
    mark = _mark(edges) if n else (0,)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        edges = written(_small_star(_large_star(edges)), "components")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
