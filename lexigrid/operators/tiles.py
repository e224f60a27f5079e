"""Products of strips of vectors, by tiles of bounded size, and what can be said of their pairs within a task.

Items are dealt to strips by a hash of their ids; a task holds two strips and multiplies them a tile at a time, in single
precision less SLACK, after which the few pairs that are left are judged in double precision. A summary gathers what a query
needs of them in the task, a row per item or label, so that the pairs themselves leave it only where they are asked for.

Null vectors, and vectors of zeros, are in no pair. Neither are items without an id, nor two with equal ids.

Scale: every item goes to as many tasks as there are strips, GRID until they would exceed STRIP rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strips of a table, and rows of a strip: below FEW it isn't worth more of them, above STRIP there are more than GRID.
GRID, FEW, STRIP = 8, 2_000, 50_000
#: Rows and columns of a tile, and pairs that are judged at once.
ROWS, COLUMNS, AT_ONCE = 512, 8_192, 1 << 16
#: By how much a cosine in single precision may be off.
SLACK = 1e-4

Tiles = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Strips:
    """Two strips as arrays: ids in order, unit vectors, further columns, and where the second begins."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.low, self.high = rows["i"][0].as_py(), rows["j"][0].as_py()
        lists = rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        own, ids = rows["own"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, own != self.low))
        order = order[norm[order] > 0]
        self.ids, self.x = ids[order], x[order] / norm[order, None]
        self.start = 0 if self.low == self.high else int((own[order] == self.low).sum())
        self.more = {n: rows[n].take(pa.array(order)).combine_chunks() for n in rows.column_names if n not in ("i", "j", "own", "id", "v")}

    def tiles(self, threshold: float) -> Tiles:
        """(l, r, cosine): places of the pairs at the threshold, the lesser id first; a part of a tile at a time."""
        single = self.x.astype(np.float32)
        end = len(self.x) if self.low == self.high else self.start
        for i in range(0, end, ROWS):
            left = single[i : min(i + ROWS, end)]
            for j in range(self.start, len(self.x), COLUMNS):
                right = single[j : j + COLUMNS]
                if self.low == self.high and j + len(right) <= i:
                    continue  # ids are in order: the tile holds each pair a second time
                p, q = np.nonzero(left @ right.T >= threshold - SLACK)
                for k in range(0, len(p), AT_ONCE):
                    l, r = p[k : k + AT_ONCE] + i, q[k : k + AT_ONCE] + j  # noqa: E741
                    score = np.einsum("ij,ij->i", self.x[l], self.x[r])
                    fits = (score >= threshold) & ((l < r) if self.low == self.high else True) & (self.ids[l] != self.ids[r])
                    l, r, score = l[fits], r[fits], score[fits]  # noqa: E741
                    swap = self.ids[l] > self.ids[r]
                    if len(l):
                        yield np.where(swap, r, l), np.where(swap, l, r), score


Summary = Callable[[Strips, Tiles], Iterator[list]]


def strips(items: DataFrame, id_col: str, vector_col: str, blocks: int, *more: str) -> DataFrame:
    """id, v, own and more: the items that may be in pairs, dealt to strips. Numbers are moved in the precision that they have."""
    kind = "array<float>" if dict(items.dtypes)[vector_col] == "array<float>" else "array<double>"
    picked = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), *more).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return picked.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def in_tasks(threshold: float, schema: str, summary: Summary):
    """The function of a group i, j of rows of strips that yields the summary of its pairs, in batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Strips(list(batches))
        for columns in summary(own, own.tiles(threshold)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return compare


def compared(items: DataFrame, id_col: str, vector_col: str, threshold: float, schema: str, summary: Summary, *more: str) -> DataFrame:
    """The summaries of all pairs of strips; every pair of items is in one of them."""
    count = items.count()
    n = max(1, min(-(-count // FEW), GRID), -(-count // STRIP))
    dealt = strips(items, id_col, vector_col, n, *more).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    return met.groupBy("i", "j").applyInArrow(in_tasks(threshold, schema, summary), schema)


# summaries


def every(own: Strips, tiles: Tiles) -> Iterator[list]:
    """a, b, score of each pair."""
    for l, r, score in tiles:  # noqa: E741
        yield [own.ids[l], own.ids[r], score]


def labelled(own: Strips, tiles: Tiles) -> Iterator[list]:
    """a, b, la, lb of each pair: ids and labels."""
    for l, r, _ in tiles:  # noqa: E741
        yield [own.ids[l], own.ids[r], own.more["label"].take(pa.array(l)), own.more["label"].take(pa.array(r))]


def degrees(high: float):
    """id, n and best: how many pairs up to `high` an item has, and the highest score of these."""

    def summary(own: Strips, tiles: Tiles) -> Iterator[list]:
        n, best = np.zeros(len(own.ids), np.int64), np.full(len(own.ids), -np.inf)
        for l, r, score in tiles:  # noqa: E741
            fits = score <= high
            for side in (l[fits], r[fits]):
                n += np.bincount(side, minlength=len(n))
                np.maximum.at(best, side, score[fits])
        some = n > 0
        yield [own.ids[some], n[some], best[some]]

    return summary


def nearest(k: int):
    """src, dst, score of the k best partners that an item has here; ties by id."""

    def best(src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> tuple:
        order = np.lexsort((dst, -score, src))
        src = src[order]
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.zeros(0, np.int64)
        place = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src))))
        keep = order[place < k]
        return keep

    def summary(own: Strips, tiles: Tiles) -> Iterator[list]:
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def pruned():
            src, dst, score = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = best(src, dst, score)
            return src[keep], dst[keep], score[keep]

        for l, r, score in tiles:  # noqa: E741
            held += [(l, own.ids[r], score), (r, own.ids[l], score)]
            size += len(l)
            if size > (1 << 20) + 4 * k * len(own.ids):
                held, size = [pruned()], 0
        src, dst, score = pruned()
        yield [own.ids[src], dst, score]

    return summary


def bands(floors: list[float], digits: int):
    """band, n, least: pairs by the first floor that their rounded score reaches, len(floors) if none."""

    def summary(own: Strips, tiles: Tiles) -> Iterator[list]:
        n, least = np.zeros(len(floors) + 1, np.int64), np.full(len(floors) + 1, np.inf)
        for _, _, score in tiles:
            score = np.round(score, digits)
            band = (score[:, None] < np.array(floors)[None, :]).sum(axis=1)
            n += np.bincount(band, minlength=len(n))
            np.minimum.at(least, band, score)
        some = np.flatnonzero(n)
        yield [some, n[some], least[some]]

    return summary


def by_label(own: Strips, tiles: Tiles) -> Iterator[list]:
    """label, n, total, same: pairs by the label of the lesser id, their scores and how many have one label. Null is a label, but not the same."""
    coded = own.more["label"].dictionary_encode()
    kinds = len(coded.dictionary)
    code = np.where(own.more["label"].is_null().to_numpy(zero_copy_only=False), kinds, coded.indices.fill_null(kinds).to_numpy(zero_copy_only=False))
    n, total, same = np.zeros(kinds + 1, np.int64), np.zeros(kinds + 1), np.zeros(kinds + 1, np.int64)
    for l, r, score in tiles:  # noqa: E741
        n += np.bincount(code[l], minlength=kinds + 1)
        total += np.bincount(code[l], score, minlength=kinds + 1)
        same += np.bincount(code[l][(code[l] == code[r]) & (code[l] < kinds)], minlength=kinds + 1)
    some = np.flatnonzero(n)
    yield [coded.dictionary.take(pa.array([int(s) if s < kinds else None for s in some], pa.int64())), n[some], total[some], same[some]]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least place of each place's component, once a and b are joined as well."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up


def density(own: Strips, tiles: Tiles) -> Iterator[list]:
    """kind, a, b, score: links (kind 0) that join the cores that pairs join here, and the nearest core (kind 1) of each other item here."""
    core = own.more["core"].to_numpy(zero_copy_only=False).astype(bool)
    root = np.arange(len(own.ids))
    best, at = np.full(len(own.ids), -np.inf), np.full(len(own.ids), np.iinfo(np.int64).max)
    for l, r, score in tiles:  # noqa: E741
        both = core[l] & core[r]
        root = _merge(root, l[both], r[both])
        for a, b in ((l, r), (r, l)):
            near = ~core[a] & core[b]
            item, other, s = a[near], own.ids[b[near]], score[near]
            order = np.lexsort((other, -s, item))
            item, other, s = item[order], other[order], s[order]
            first = np.append(True, item[1:] != item[:-1]) if len(item) else np.zeros(0, bool)
            item, other, s = item[first], other[first], s[first]
            better = (s > best[item]) | ((s == best[item]) & (other < at[item]))
            best[item[better]], at[item[better]] = s[better], other[better]
    joined, near = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(best > -np.inf)
    yield [np.zeros(len(joined), np.int64), own.ids[joined], own.ids[root[joined]], np.zeros(len(joined))]
    yield [np.ones(len(near), np.int64), own.ids[near], at[near], best[near]]
