"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class from the start, with a weight. The signs of a class's products with `bits`
random directions are its key in a table; two vectors at the wanted cosine share a key in one table
or another with the probability RECALL, from which the number of tables follows; closer ones are surer.
A sketch of 128 more signs rules out most others that share a key, and whatever is left is decided by
cosines in double precision.

Groups of close vectors would mean all pairs within a key. So vectors within half the wanted angle of the first
vector of one of their keys are put into a ball around it, if it has MIN_BALL or more. All vectors of a ball are
linked, by the triangle inequality: nobody compares them. A ball counts as one unit in a key, however many
of its vectors are there. Units that share a key are compared in blocks of CHUNK vectors, by a matrix product each;
what leaves a block is each vector's number of links and a link that joins both sides, never pairs.

Defined cases. Null, empty and zero vectors, and those that hold null or non-finite numbers, link with
nothing. Vectors of different lengths don't link. Equal vectors link, as do repeated rows. Null ids: such a row is
linked like any other; a component without any id has a null component_id, and kept is false for null ids.
An empty table gives no rows. Any magnitude is fine: vectors are brought to a common exponent, exactly.
Other columns are kept if they are named in `keep`.

Scale: bits grow with the logarithm of the classes, so keys stay small; a key holds 24 bytes of a class, and
vectors move only to be verified. First vectors of keys are found by an aggregation, and met in SALTS parts of each
key, so that a key with a third of all rows is spread. Keys of more than CELL units are a grid of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm.common import boxed, written
from lexigrid.llm.components import connected_components

COSINE = 0.95
#: Probability that a pair at the wanted cosine shares a key.
RECALL = 0.99999
#: Classes in a key, as a power of two, if all were spread evenly.
KEY_BITS = 8
SKETCH = 128
#: Standard deviations by which a sketch may differ from what is expected.
SLACK = 6.0
MIN_BALL, CHUNK, CELL, SALTS = 8, 256, 512, 16
OWN = ("n_links", "component_id", "kept")


def plan(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key, and tables."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(4, min(48, math.ceil(math.log2(max(classes, 2))) - KEY_BITS))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def _apart(angle: float) -> int:
    """Signs of a sketch that two vectors at this angle may differ in."""
    p = min(angle / math.pi, 0.5)
    return math.ceil(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, brought to a largest exponent of 0, which changes no bit of their fractions."""
    x = np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, weight, vector): arrays of doubles as bytes."""
    for batch in batches:
        packed = [np.asarray(v, np.float64).tobytes() for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "weight", "vector"])


def _hash(bits: int, tables: int, seed: int):
    """(node, sketch, keys) of (node, vector)."""

    def planes(size: int) -> np.ndarray:
        return np.random.default_rng([seed, size]).standard_normal((size, bits * tables + SKETCH))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column(1).to_pylist()])
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                if size not in of:
                    of = {**of, size: planes(int(size))} if len(of) < 8 else {size: planes(int(size))}
                for begin in range(0, rows.num_rows, 1024):
                    part = rows.slice(begin, 1024)
                    positive = _matrix(part.column(1)) @ of[size] > 0
                    sketch = np.packbits(positive[:, -SKETCH:], axis=1).view(np.int64)
                    keys = positive[:, :-SKETCH].reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    # table, length and signs in one number; a clash of lengths only adds candidates
                    keys = (keys * tables + np.arange(tables)) * 64 + int(size) % 64
                    made = pa.StructArray.from_arrays([pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["a", "b"])
                    yield pa.RecordBatch.from_arrays([part.column(0), made, pa.array(list(keys), pa.list_(pa.int64()))], ["node", "sketch", "keys"])

    return sign


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"]))


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of (a, b, va, vb); vectors of different lengths are left out."""
    for batch in batches:
        same = np.array([len(x) == len(y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], bool)
        rows = batch.filter(pa.array(same))
        sizes = np.array([len(v) for v in rows.column(2).to_pylist()])
        for size in np.unique(sizes):
            part = rows.filter(pa.array(sizes == size))
            x, y = _matrix(part.column(2)), _matrix(part.column(3))
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cosine)], ["a", "b", "cosine"])


def _balls(classes: DataFrame, signs: DataFrame, cosine: float) -> DataFrame:
    """(node, center): vectors within half the angle of a center that has many of them."""
    half = math.acos(cosine) / 2
    keys = signs.select("node", "sketch", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("node", "sketch")).alias("c"), F.count("*").alias("n")).where(f"n >= {MIN_BALL}").select("key", "c")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keys.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).where(F.col("node") != F.col("c.node"))
    near = met.where(_differ(F.col("sketch"), F.col("c.sketch")) <= _apart(half)).groupBy(F.col("node").alias("a"), F.col("c.node").alias("b")).agg(F.count("*").alias("often"))
    asked = written(near, "vectors-centers")
    wide = classes.select("node", "vector")
    both = asked.select("a", "b").join(wide.toDF("a", "va"), "a").join(wide.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    # a little less than half, as cosines are rounded
    good = both.mapInArrow(_angles, "a long, b long, cosine double").where(F.col("cosine") >= math.cos(half) + 1e-9)
    chosen = written(good.groupBy("a").agg(F.min("b").alias("center")), "vectors-chosen")
    many = chosen.groupBy("center").agg(F.count("*").alias("n")).where(f"n >= {MIN_BALL}").select("center")
    return written(chosen.join(many, "center").select(F.col("a").alias("node"), "center"), "vectors-balls")


def _unit_pairs(signs: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """(u, v): units that share a key and may hold a link. A unit is a ball, by its center as -1 - center, or a vector."""
    angle, c = math.acos(cosine), F.col
    centers = balls.select("center").distinct().join(signs.select(c("node").alias("center"), c("sketch").alias("at")), "center")
    member = balls.join(centers, "center")
    mine = signs.join(member, "node", "left")
    units = mine.select(F.coalesce(-1 - c("center"), c("node")).alias("u"), F.coalesce("at", "sketch").alias("s"), c("center").isNotNull().alias("ball"), F.explode("keys").alias("key"))
    once = written(units.groupBy("key", "u", "ball").agg(F.first("s").alias("s")), "vectors-units")
    shared = once.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(c("n") / CELL).cast("int").alias("cells"))
    own = once.join(shared, "key").withColumn("i", F.pmod(F.xxhash64("u"), c("cells")).cast("int"))
    placed = own.select("key", "i", F.explode(F.sequence(F.lit(0), c("cells") - 1)).alias("o"), F.struct("u", "ball", "s").alias("t"))
    cells = placed.groupBy("key", F.least("i", "o").alias("low"), F.greatest("i", "o").alias("high")).agg(F.collect_list(F.struct("i", "t")).alias("ts"))
    limits = [_apart(angle + k * angle / 2) for k in (0, 1, 2)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high, ts in zip(*(batch.column(k) for k in range(3)), strict=True):
                flat = ts.values.flatten()
                i, (u, ball, s) = flat[0].to_numpy(), flat[1].flatten()
                u, ball, (a, b) = u.to_numpy(), ball.to_numpy(zero_copy_only=False), (x.to_numpy().view(np.uint64) for x in s.flatten())
                x = np.flatnonzero(i == low.as_py())
                y = x if low == high else np.flatnonzero(i == high.as_py())
                most = np.array(limits)[ball[x, None].astype(int) + ball[None, y]]
                p, q = np.nonzero(np.bitwise_count(a[x, None] ^ a[None, y]).astype(np.int16) + np.bitwise_count(b[x, None] ^ b[None, y]) <= most)
                pairs = np.stack([u[x[p]], u[y[q]]], axis=1)
                pairs.sort(axis=1)
                found.append(pairs[pairs[:, 0] != pairs[:, 1]])
            every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0].copy()), pa.array(every[:, 1].copy())], ["u", "v"])

    return written(cells.select("low", "high", "ts").mapInArrow(near, "u long, v long").distinct(), "vectors-pairs")


def _compare(cosine: float):
    """(kind, a, b, n): links of vector a to n others (kind 0), or a link between a and b (kind 1)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, ends = [], [], []
            for row in range(batch.num_rows):
                (na, wa, xa), (nb, wb, xb) = (_side(batch.column(k)[row]) for k in (0, 1))
                if xa.shape[1] != xb.shape[1]:
                    continue
                norms = np.linalg.norm(xa, axis=1)[:, None] * np.linalg.norm(xb, axis=1)[None, :]
                near = xa @ xb.T / norms >= cosine
                if near.any():
                    nodes += [na, nb]
                    counts += [near @ wb, wa @ near]
                    ends.append(_forest(na, nb, near))
            if nodes:
                every, at = np.unique(np.concatenate(nodes), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
                pairs = np.concatenate(ends)
                size, more = np.count_nonzero(n), len(pairs)
                columns = [np.repeat([0, 1], [size, more]), np.append(every[n > 0], pairs[:, 0]), np.append(np.zeros(size, np.int64), pairs[:, 1]), np.append(n[n > 0], np.zeros(more, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "a", "b", "n"])

    return compare


def _side(chunk: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, weights, vectors = chunk.values.flatten()
    return nodes.to_numpy(), weights.to_numpy().astype(np.float64), _matrix(vectors)


def _forest(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Links that join what all links of two blocks join: a link of each vector to a first one, and of these to each other where they meet."""
    label, rows = np.arange(len(a)), np.arange(len(a))
    while True:  # the least row that each column, then each row, reaches
        least = np.where(near, label[:, None], len(a)).min(axis=0)
        new = np.minimum(label, np.where(near, least[None, :], len(a)).min(axis=1))
        if (new == label).all():
            break
        label = new
    out, some = [], near.any(axis=0)
    least = np.where(near, label[:, None], len(a)).min(axis=0)
    out.append(np.stack([b[some], a[least[some]]], axis=1))
    out.append(np.stack([a, a[label]], axis=1)[rows != label])
    return np.concatenate(out)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None, cosine: float = COSINE, recall: float = RECALL, seed: int = 42) -> DataFrame:
    """The columns in `keep` (the id by default) with n_links, component_id and kept.

    n_links counts the other rows with a cosine of at least `cosine`; component_id is the least id that links reach.
    """
    keep, c = [x for x in ([id_col] if keep is None else keep) if x not in OWN], F.col
    vector = c(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(boxed(vectors, keep), c(f"`{id_col}`").cast("long").alias("id"), F.when(_usable(vector), vector).alias("v"))
    marked = rows.withColumns({"h": F.xxhash64(F.lit(1), "v"), "g": F.xxhash64(F.lit(2), "v"), "fine": c("v").isNotNull()})
    grouped = written(marked.where("fine").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors-grouped")
    numbered = grouped.select(F.struct("id", F.xxhash64(F.lit(1), "v").alias("h"), F.xxhash64(F.lit(2), "v").alias("g")).alias("id"), "weight", "v")
    packed = numbered.mapInArrow(_to_bytes, "id struct<id: long, h: long, g: long>, weight long, vector binary")
    classes = written(packed.select(F.monotonically_increasing_id().alias("node"), "id.*", "weight", "vector"), "vectors-classes")
    bits, tables = plan(classes.count(), cosine, recall)
    signs = written(classes.select("node", "vector").mapInArrow(_hash(bits, tables, seed), "node long, sketch struct<a: long, b: long>, keys array<long>"), "vectors-signs")
    balls = _balls(classes, signs, cosine)
    pairs = _unit_pairs(signs, balls, cosine)
    # units in chunks; the vectors of units that meet no other don't move
    asked = pairs.select("u").union(pairs.select("v")).distinct()
    member = classes.select("node", "weight", "vector").join(balls, "node", "left").withColumn("u", F.coalesce(-1 - c("center"), c("node")))
    sizes = written(member.groupBy("u").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("node").alias("first")), "vectors-sizes")
    wanted = member.join(asked, "u", "left_semi").join(sizes.select("u", F.ceil(c("n") / CHUNK).cast("int").alias("parts")), "u")
    chunks = written(wanted.groupBy("u", F.pmod(F.xxhash64("node"), c("parts")).alias("part")).agg(F.collect_list(F.struct("node", "weight", "vector")).alias("x")), "vectors-chunks")
    met = pairs.join(chunks.select("u", c("x").alias("x")), "u").join(chunks.select(c("u").alias("v"), c("x").alias("y")), "v").select("x", "y")
    across = written(met.mapInArrow(_compare(cosine), "kind long, a long, b long, n long"), "vectors-links")
    inside = member.where("center IS NOT NULL").join(sizes.select("u", c("weight").alias("whole"), "first"), "u")
    own = member.select("node", (c("weight") - 1).alias("n")).union(inside.select("node", c("whole") - c("weight")))
    degrees = own.union(across.where("kind = 0").select("a", "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    edges = across.where("kind = 1").select("a", "b").union(inside.select("node", "first"))
    roots = connected_components(edges)
    rooted = classes.select("node", "id", "h", "g", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = written(rooted.join(least, "root").join(degrees, "node"), "vectors-found")
    # back to the rows: a class of one row is where its row is, one of many in all parts
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    spread = found.select("h", "g", "n_links", "component_id", F.explode(F.when(c("weight") == 1, F.array(salt)).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("salt"), F.lit(True).alias("fine"))
    slim = marked.select("__in", "id", "fine", "h", "g", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = slim.where("fine").join(spread, ["h", "g", "salt", "fine"]).select("__in", "id", "n_links", "component_id")
    alone = slim.where("NOT fine").select("__in", "id", F.lit(0).cast("long").alias("n_links"), c("id").alias("component_id"))
    return out.union(alone).select("__in.*", "n_links", "component_id", F.coalesce(c("id") == c("component_id"), F.lit(False)).alias("kept"))
