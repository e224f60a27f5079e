"""Components by chunks of edges, and how many jobs they and the order of shingles ask of the driver."""

import uuid

import numpy as np
import pytest

import brute
from lexigrid.llm import components, simhash


def jobs_of(spark, f):
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "counted")
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def rooted(n, edges):
    least = {}
    for i, c in enumerate(brute.components(n, edges)):
        least.setdefault(c, i)
    return {i: least[c] for i, c in enumerate(brute.components(n, edges)) if least[c] != i}


@pytest.mark.parametrize("chunk", [components.CHUNK, 60, 7])
def test_components_by_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    n = 400
    shuffled = rng.permutation(120).tolist()
    edges = list(zip(shuffled, shuffled[1:])) + [(399, i) for i in range(150, 250)] + [tuple(e) for e in rng.integers(260, 390, (70, 2)).tolist()] + [(3, 3), (5, 9), (9, 5)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = components.connected_components(rows, chunk).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == rooted(n, edges)


def test_stars_of_a_long_path_and_of_a_late_hub():
    path = np.random.default_rng(2).permutation(20_000)
    node, root = components._stars(path[1:], path[:-1])
    assert len(node) == 19_999 and not root.any() and node.min() == 1
    node, root = components._stars(np.full(50, 99), np.arange(10, 60))
    assert sorted(node.tolist()) == [*range(11, 60), 99] and set(root.tolist()) == {10}


def test_few_jobs_for_few_edges(spark):
    """Each round of joins was some ten stages of as many tasks as shuffle partitions, which the driver keeps account of."""
    edges = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    got, jobs = jobs_of(spark, lambda: components.connected_components(edges).count())
    assert got == 299 and jobs <= 8


def test_order_of_shingles_in_few_jobs(spark):
    """It was fetched by a job for each shuffle partition."""
    texts = spark.createDataFrame([("a b c d e f g",), ("b c d e f g h",), (None,)], "text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order, jobs = jobs_of(spark, lambda: simhash.shingle_order(texts, 5, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert order.sum() == 6 and jobs <= 8
