"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits over the XXH64 hashes of a text's word shingles. To find all pairs that
differ in at most TAU bits, the bits are put into groups of correlated ones; if the groups' own
thresholds add up to TAU - groups + 1, any such pair is within the threshold of one group at least
(a threshold of -1 leaves a group out). Dynamic programming picks the thresholds with the least
estimated work: keys to write, and candidates to compare. Each fingerprint then probes with its
group's bits, or with these less one or two bits where the threshold is 1 or 2; fingerprints that
share a key are compared. The links' connected components are the groups of near-duplicates.

Exact copies share a fingerprint and are one row from the start. Keys shared by more than BUCKET
fingerprints aren't compared pair by pair. Their fingerprints are put under each fingerprint within
one bit of them, 65 keys each: two share one if and only if they differ in two bits at most, and at
most 65 can share one. So the rest is handled exactly as well, in linear time. That is why TAU is fixed
at two bits; keys per fingerprint then grow little with the table (44 up to a million fingerprints).

`drop_near_copies` links texts by their sets of word shingles. Fingerprints within TAU bits find most
near copies; a text whose fingerprint strays further is found by the rare shingles that it shares, so
that no pair of the similarity is lost. Every link is decided on whole texts.

Defined cases. Null or empty text: fingerprint zero, linked like any other; texts without words are copies.
Fewer words than a shingle: one shingle of all words. Null ids: a component without any id has a null
component; the dropper keeps the least id, nulls last. Repeated rows are copies. An empty table gives no
rows. Very long texts: hashed in pieces, verified a few pairs at a time. Other columns pass through if
named in `keep`, and may have any name but __fp, __row, __first and component_id, which the operator's
own replace; the dropper keeps all columns whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from lexigrid.llm.common import boxed, written
from lexigrid.llm.components import connected_components
from lexigrid.llm.hashing import NOT_SPACE, hash_words, mix

BITS = 64
TAU = 2
#: Fingerprints that may share a key and be compared pair by pair.
BUCKET = 32
#: Cost of comparing a candidate pair against that of writing a key.
PAIR_COST = 0.2
_AT_ONCE = 1 << 15
#: Buckets by which shingles are ordered, parts in which they are summed, and texts that are counted for it.
ORDER_BITS, ORDER_PARTS = 20, 16
ORDER_DOCS = 50_000
#: Ids of texts to verify, or of rows to leave out, that may be broadcast, so that other texts aren't moved.
WANTED = 1_000_000
#: Texts of a key in a block.
CELL = 256
#: Bytes of text that are described or verified at once.
VERIFY_BYTES = 4 << 20
#: Words of 64 marks that a text has for its shingles.
LANES = 8
MARK_NAMES = [f"m{k}" for k in range(LANES)]
OWN = ("__fp", "__row", "__first", "component_id")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number; only A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    ones, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    for begin in range(0, n, _AT_ONCE):
        count = min(_AT_ONCE, n - begin)
        h = np.fromiter(map(xxh64_intdigest, islice(shingles, count), repeat(seed)), np.uint64, count)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n), bitorder="little").view(np.uint64)[0])


def _with_fingerprints(shingle: int, seed: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(found.view(np.int64))], [*(n for _, n in rest), "__fp"])

    return fill


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns in `keep` (all by default) and __fp, the fingerprint as a signed long."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(boxed(docs, [c for c in keep if c not in OWN]), F.col(f"`{text_col}`").cast("string").alias("__text"))
    found = rows.mapInArrow(_with_fingerprints(shingle, seed), StructType([rows.schema["__in"], StructField("__fp", LongType())]))
    return found.select("__in.*", "__fp")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are set together, once per task; bit pairs as 64 i + j."""
    sums = np.zeros((BITS, BITS))
    for batch in batches:
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for begin in range(0, len(x), _AT_ONCE):
            part = x[begin : begin + _AT_ONCE]
            sums += part.T @ part
    if sums.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(sums.ravel())], ["ij", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and the matrix of how often two bits are set together."""
    together = np.zeros(BITS * BITS)
    for row in fps.select("fp").mapInArrow(_cooccur, "ij long, n double").groupBy("ij").agg(F.sum("n").alias("n")).collect():  # 4096 numbers
        together[row["ij"]] = row["n"]
    return fps.count(), together.reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, groups: int) -> list[list[int]]:
    """Groups of equal width; each takes the bits that correlate most with those it has."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        width = BITS // groups + (g < BITS % groups)
        rest = sorted(left)
        mine = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(mine[0])
        while len(mine) < width:
            best = max(sorted(left), key=lambda b: (corr[b, mine].sum(), -b))
            mine.append(best)
            left.discard(best)
        out.append(mine)
    return out


def agreement(n: int, together: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated probability that two fingerprints differ in at most t of the bits, for t up to `most`.

    Bits are taken in turn; how often one agrees, given that the bit before agrees, follows from the
    four cells of their table, so correlated bits don't count twice.
    """
    n = max(n, 1)
    p = np.diag(together) / n
    alone = lambda b: p[b] ** 2 + (1 - p[b]) ** 2
    agree = [alone(bits[0])]
    for a, b in zip(bits, bits[1:], strict=False):
        both = together[a, b] / n
        cells = (both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both)
        agree.append(min(max(sum(c * c for c in cells) / max(alone(a), 1e-9), 1e-3), 1.0))
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for a in agree:
        dist = dist * a + np.concatenate([[0.0], dist[:-1] * (1 - a)])
    return list(np.cumsum(dist))


def allocate(n: int, together: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group in use, by dynamic programming over groups and sums of thresholds."""
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(2, tau + 3):
        groups, need = group_bits(n, together, m), tau - m + 1
        table: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for bits in groups:
            near, after = agreement(n, together, bits, 2), {}
            for t in (-1, 0, 1, 2):
                cost = 0.0 if t < 0 else n * math.comb(len(bits), t) + PAIR_COST * n * n / 2 * near[t] * (math.comb(len(bits), t) if t else 1) ** 0.5
                for s, (c, chosen) in table.items():
                    if s + t not in after or after[s + t][0] > c + cost:
                        after[s + t] = (c + cost, [*chosen, *([(bits, t)] if t >= 0 else [])])
            table = after
        if need in table and table[need][0] < best[0]:
            best = table[need]
    return best[1]


def _masks(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """The bits that each key keeps: a group's, less as many as its threshold."""
    out = [sum(1 << b for b in bits if b not in gone) for bits, t in plan for gone in combinations(bits, t)]
    return np.array(out, np.uint64)


def _probe(masks: np.ndarray):
    """(key, fp) of each fingerprint and mask. Two masks may give one key; that only adds candidates."""
    salts = mix(masks + np.uint64(0x9E3779B97F4A7C15))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for begin in range(0, len(every), 4096):
                fps = every[begin : begin + 4096]
                keys = mix((fps[:, None] & masks[None, :]) ^ salts[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["key", "fp"])

    return probe


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, fp): each fingerprint under itself and all that differ from it in one bit."""
    flips = np.concatenate([[0], 1 << np.arange(BITS, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for begin in range(0, len(every), 4096):
            fps = every[begin : begin + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((fps[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], ["mid", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprints that differ in at most TAU bits.

    fps: distinct, in a column fp. Crowds are chained, so that their components come out as of all pairs.
    """
    plan = allocate(*bit_statistics(fps))
    keys = fps.select("fp").mapInArrow(_probe(_masks(plan)), "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(shared, "key"), "simhash-met")
    pairs = met.where(f"n <= {BUCKET}").groupBy("key").agg(F.collect_set("fp").alias("fps"))
    near = F.flatten(
        F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= TAU)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    few = pairs.select(F.explode(near).alias("e")).select("e.a", "e.b")
    crowd = met.where(f"n > {BUCKET}").select("fp").distinct()
    mids = crowd.mapInArrow(_around, "mid long, fp long").groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")  # 65 at most
    many = mids.select(F.explode(F.transform(F.slice("fps", F.lit(2), F.size("fps") - 1), lambda b, i: F.struct(F.get("fps", i).alias("a"), b.alias("b")))).alias("e")).select("e.a", "e.b")
    return few.union(many).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns in `keep` (the id by default) with __fp, component_id and __row, which counts rows.

    component_id is the least id of the row's component; __first is true for one row of each.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c not in OWN]
    asked = docs.select(boxed(docs, keep), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(with_fingerprints(asked, keep=["__in", "id"], shingle=shingle, seed=seed).withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("__row").alias("row"))
    classes = written(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(order).alias("first")), "simhash-classes")
    roots = connected_components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.where("fp <> root").select("root").distinct()  # components of one class need no further look
    firsts = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("best"))
    final = written(rooted.join(firsts, "root", "left").select("fp", F.coalesce("best", "first").alias("best")), "simhash-components")
    return rows.join(final, rows["__fp"] == final["fp"]).select("__in.*", "__fp", "__row", F.col("best.id").alias("component_id"), (F.col("__row") == F.col("best.row")).alias("__first"))


def hex_fingerprint(fp="__fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _shingle_sets(texts: list[str | None], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's word hashes and the sorted distinct hashes of its shingles; one of all words if these are fewer."""
    powers = np.array([0x9E3779B97F4A7C15], np.uint64) ** np.arange(shingle, dtype=np.uint64)
    words, offsets = hash_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], NOT_SPACE)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = words[a:b]
        k = min(shingle, len(own))
        found = sum((own[j : len(own) - k + 1 + j] * powers[j] for j in range(k)), np.zeros(max(len(own) - k + 1, 0) if k else 0, np.uint64))
        yield own, np.unique(mix(found))


def _count_shingles(shingle: int):
    """How many texts have a shingle of each bucket, in parts, once per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << ORDER_BITS, np.int32)
        for batch in batches:
            for _, found in _shingle_sets(batch.column(0).to_pylist(), shingle):
                np.add.at(n, found >> np.uint64(64 - ORDER_BITS), 1)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(ORDER_PARTS), pa.int64()), pa.array([x.tobytes() for x in np.split(n, ORDER_PARTS)], pa.binary())], ["part", "sums"])

    return count


def _add_counts(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.int32) for x in group.column("sums")], axis=0, dtype=np.int32)
    return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def shingle_order(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """How common the shingles of each bucket are, by a sample of some ORDER_DOCS texts.

    The prefix filter misses nothing by any order that is the same for all texts; a good one saves work.
    """
    sample = texts.sample(min(1.0, ORDER_DOCS / max(texts.count(), 1)), seed)
    out = np.zeros((ORDER_PARTS, (1 << ORDER_BITS) // ORDER_PARTS), np.int32)
    for r in sample.mapInArrow(_count_shingles(shingle), "part long, sums binary").groupBy("part").applyInArrow(_add_counts, "part long, sums binary").collect():  # 4 MB
        out[r["part"]] = np.frombuffer(r["sums"], np.int32)
    return out.ravel()


def _slices(batch: pa.RecordBatch, columns: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in these columns come to some VERIFY_BYTES."""
    sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in columns))
    ends = np.append(np.flatnonzero(np.diff(sizes // VERIFY_BYTES)) + 1, batch.num_rows)
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        yield batch.slice(begin, end - begin)


def _parities(found: np.ndarray) -> np.ndarray:
    """Marks as bytes, two to four times as many as there are hashes, a power of two: set where an odd number falls."""
    bits = max(64 * LANES, 1 << int(2 * len(found) - 1).bit_length() if len(found) else 0)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def _folded(marks: np.ndarray, size: int) -> np.ndarray:
    """The marks for the same hashes in fewer bytes."""
    while len(marks) > size:
        marks = marks[: len(marks) // 2] ^ marks[len(marks) // 2 :]
    return marks


def _close_marks(similarity: float):
    """Pairs (a, b) whose marks leave room for the similarity; columns a, b, n, marks, m, marks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            most, good = (1 - similarity) / (1 + similarity) * (n + m) + 1e-6, []
            for x, y, limit in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), most, strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                good.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= limit)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return check


def _describe(shingle: int, similarity: float, seed: int, order):
    """__fp, __digest of the word sequence, __n distinct shingles, __prefix: the rarest of them, and __marks.

    Two sets of at least the similarity share a shingle of both prefixes, n - ceil(similarity n) + 1 long.
    A mark is set if an odd number of the shingles has its hash; so two texts have at most as many
    different marks as there are shingles that only one of them has. __wide: the same with marks for more shingles.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, (whole.num_columns - 1,))):
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            fps, digests, sizes, prefixes, marks, wides = [], [], [], [], [], []
            for text, (own, found) in zip(texts, _shingle_sets(texts, shingle), strict=True):
                fps.append(fingerprint(text, seed=seed))
                digests.append(xxh64_intdigest(own.tobytes(), seed))
                n = len(found)
                rare = np.argsort(order.value[found >> np.uint64(64 - ORDER_BITS)], kind="stable")
                sizes.append(n)
                wide = _parities(found)
                wides.append(wide.tobytes())
                marks.append(_folded(wide, 8 * LANES).view(np.int64))
                prefixes.append(found[rare[: n - math.ceil(similarity * n - 1e-9) + 1]].tobytes())
            rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())]
            lanes = pa.StructArray.from_arrays([pa.array(x) for x in np.array(marks, np.int64).reshape(-1, LANES).T], MARK_NAMES)
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), *made, lanes, pa.array(wides, pa.binary())], [*(n for _, n in rest), "__fp", "__digest", "__n", "__prefix", "__marks", "__wide"])

    return fill


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, r): a row for each shingle of a prefix."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            found = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            r = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(r)], ["key", "r"])


def _may_be_alike(similarity: float, x: str, y: str):
    """Whether sets of these sizes and marks can have the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = reduce(add, (F.bit_count(F.col(f"{x}.marks.{k}").bitwiseXOR(F.col(f"{y}.marks.{k}"))) for k in MARK_NAMES))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _alike(shingle: int, similarity: float):
    """Pairs (a, b) whose whole texts have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, (2, 3)):
                x, y = ((f for _, f in _shingle_sets(part.column(k).to_pylist(), shingle)) for k in (2, 3))
                good = [jaccard(a, b) >= similarity for a, b in zip(x, y, strict=True)]
                yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return check


def _to_hubs(met: DataFrame, central: DataFrame, similarity: float) -> DataFrame:
    """(x, y): each text y with a hub, that with which it shares most keys of those that may be alike.

    A key's hub is the text that shares most of its own keys with others: of copies with edits that is the one
    that has none, if it is there.
    """
    c, w = F.col, Window.partitionBy("key")
    ranked = met.join(central.select("r", "shared"), "r").withColumn("hub", F.min(F.struct(-c("shared"), "r")).over(w)["r"])
    counted = ranked.where("r <> hub").groupBy("r", "hub").agg(F.count("*").alias("common"))
    of = lambda name: central.select(c("r").alias(name), F.struct("n", "marks").alias(f"{name}_is"))
    fit = counted.join(of("r"), "r").join(of("hub"), "hub").where(_may_be_alike(similarity, "r_is", "hub_is"))
    return fit.groupBy("r").agg(F.max(F.struct("common", -c("hub"), "hub"))["hub"].alias("x")).select("x", c("r").alias("y"))


def _across_components(met: DataFrame, central: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(x, y): texts of different components that meet under a key and may be alike. Crowded keys are compared in blocks."""
    c = F.col
    rooted = met.join(roots.select(c("node").alias("r"), "root"), "r", "left").select("key", "r", F.coalesce("root", "r").alias("root"))
    split = rooted.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", F.ceil(c("rows") / CELL).cast("int").alias("blocks"))
    own = rooted.join(split, "key").join(central, "r").select("key", "blocks", F.struct("r", "n", "root", "marks").alias("t"), F.pmod(F.xxhash64("r"), c("blocks")).cast("int").alias("s"))
    cells = own.withColumn("o", F.explode(F.sequence(F.lit(0), c("blocks") - 1))).select("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "t", "s")
    left, right = cells.select("key", "i", "j", c("t").alias("x"), c("s").alias("x_s")), cells.select("key", "i", "j", c("t").alias("y"), c("s").alias("y_s"))
    once = (c("x.r") < c("y.r")) & (c("x.root") != c("y.root")) & (F.least("x_s", "y_s") == c("i")) & (F.greatest("x_s", "y_s") == c("j"))
    return left.join(right, ["key", "i", "j"]).where(once & _may_be_alike(similarity, "x", "y")).select(c("x.r").alias("x"), c("y.r").alias("y"))


def _chosen_rows(rows: DataFrame, chosen: DataFrame, tag: str) -> DataFrame:
    """The rows whose __row is among the chosen.

    The ids of the others are counted; if WANTED or fewer, they are broadcast and no text moves. Else rows meet the chosen ids by a shuffle.
    """
    others = written(rows.select("__row").join(chosen, "__row", "left_anti"), tag)
    if others.count() <= WANTED:
        return rows.join(F.broadcast(others), "__row", "left_anti")
    return rows.join(chosen, "__row", "left_semi")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """docs with one row, that with the least id, of each group of texts that are alike.

    Texts with the same words are copies. Others are linked if their whole sets of word shingles have the
    Jaccard similarity. First, texts are compared whose fingerprints differ in at most TAU
    bits, or that share one, and each text with one that shares most of its rare shingles; this joins most.
    Then all texts that share such a shingle and aren't joined yet are compared, which misses no pair.
    """
    sc = docs.sparkSession.sparkContext
    text = F.col(f"`{text_col}`").cast("string")
    order = sc.broadcast(shingle_order(docs.select(text.alias("text")), shingle, seed))
    asked = docs.select(boxed(docs), F.col(f"`{id_col}`").alias("id"), text.alias("__text"))
    schema = StructType([asked.schema["__in"], asked.schema["id"], StructField("__fp", LongType()), StructField("__digest", LongType()), StructField("__n", LongType()), StructField("__prefix", BinaryType()), StructField("__marks", StructType([StructField(k, LongType()) for k in MARK_NAMES])), StructField("__wide", BinaryType())])
    rows = written(asked.mapInArrow(_describe(shingle, similarity, seed, order), schema).withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    least = F.struct(F.col("id").isNull().alias("none"), "id", F.col("__row").alias("row"), F.col("__n").alias("n"))
    texts = written(rows.groupBy("__fp", "__digest").agg(F.min(least).alias("first")).select(F.col("__fp").alias("fp"), "first"), "simhash-texts")
    heads = written(texts.groupBy("fp").agg(F.min("first").alias("head")), "simhash-heads")
    sized = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    across = links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    within = texts.join(heads, "fp").where("first.row <> head.row").select(F.col("head").alias("x"), F.col("first").alias("y"))
    near = across.select("x", "y").union(within).where(sized).select(F.col("x.row").alias("x"), F.col("y.row").alias("y"))
    keys = _chosen_rows(rows, texts.select(F.col("first.row").alias("__row")), "simhash-repeated").where("__n > 0").select("__row", "__prefix").mapInArrow(_spread, "key long, r long")
    met = written(keys.withColumn("others", F.count("*").over(Window.partitionBy("key"))).where("others > 1").drop("others"), "simhash-shared")

    def alike(asked_pairs: DataFrame) -> DataFrame:
        given = written(asked_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-asked")
        wide = rows.select(F.col("__row").alias("r"), F.col("__n").alias("n"), F.col("__wide").alias("w"))
        wide = wide.join(given.select(F.col("a").alias("r")).union(given.select("b")).distinct(), "r", "left_semi")
        marked = given.join(wide.toDF("a", "n", "w"), "a").join(wide.toDF("b", "m", "v"), "b").select("a", "b", "n", "w", "m", "v")
        ordered = written(marked.mapInArrow(_close_marks(similarity), "a long, b long"), "simhash-close")
        wanted = ordered.select(F.col("a").alias("r")).union(ordered.select("b")).distinct()
        wanted = F.broadcast(wanted) if 2 * ordered.count() <= WANTED else wanted
        bodies = rows.select(F.col("__row").alias("r"), F.col(f"__in.`{text_col}`").cast("string").alias("t")).join(wanted, "r", "left_semi")
        both = ordered.join(bodies.toDF("a", "s"), "a").join(bodies.toDF("b", "t"), "b").select("a", "b", "s", "t")
        return written(both.mapInArrow(_alike(shingle, similarity), "a long, b long"), "simhash-alike")

    described = rows.select(F.col("__row").alias("r"), F.col("__n").alias("n"), F.col("__marks").alias("marks"))
    central = written(described.join(met.groupBy("r").agg(F.count("*").alias("shared")), "r"), "simhash-central")
    known = alike(near.union(_to_hubs(met, central, similarity)))
    late = alike(_across_components(met, central, connected_components(known), similarity))
    roots = connected_components(known.union(late))
    rooted = texts.join(roots, F.col("first.row") == F.col("node"), "left").select(F.coalesce("root", "first.row").alias("root"), "first")
    kept = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")), "simhash-kept")
    return _chosen_rows(rows, kept, "simhash-dropped").select("__in.*")
