"""Pairs of texts within a share of edits, in groups of texts that may be close, by strips of bounded size.

Texts of a key are dealt to strips; a task holds two strips of one key and compares them a tile at a time. What rules pairs out
comes first: lengths, which are in order, then the letters that one text has and the other hasn't, as the 64 bits that tell most
of these texts apart, then those of both halves. An edit adds one letter to either of these at most. What is left is measured within the band of the usual
table that so few edits can reach, for many pairs at once, as long as they may still fit; an end that all texts share is left out.

Scale: a text goes to as many tasks as its key has strips, which is one below STRIP texts; a task holds two strips, a tile, and AT_ONCE pairs
and those of a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts of a strip, rows and columns of a tile, pairs that are measured at once.
STRIP, ROWS, COLUMNS, AT_ONCE = 20_000, 16, 4_096, 1 << 18
#: Letters are counted in SLOTS, by their codes, up to MOST.
SLOTS, MOST = 32, 6
#: Rows of a table between two looks at which pairs may still fit; pairs for which a band of their own is worth it.
LOOK, TOGETHER = 3, 8_192

#: The greatest share of edits, of the longer length, that two texts may need, by the numbers that they come with.
Share = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, one more than their place among those that occur, padded with zeros; and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def small_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same in bytes, if few characters occur."""
    codes, sizes = _codes(texts)
    found, at = np.unique(codes, return_inverse=True)
    if not len(found) or found[0]:  # zero is what texts are padded with, also where none is
        at = at + 1
    return (at.reshape(codes.shape).astype(np.uint8) if len(found) < 256 else codes), sizes


def _letters(*parts: np.ndarray) -> np.ndarray:
    """64 bits for each text, each of which tells that one of its parts has a letter so many times: those that tell most of the texts apart."""
    n, counts = len(parts[0]), []
    for codes in parts:
        row, _ = np.nonzero(codes)
        counts.append(np.bincount(row * SLOTS + codes[codes > 0] % SLOTS, minlength=n * SLOTS).reshape(n, SLOTS))
    counts = np.concatenate(counts, axis=1)
    shares = np.stack([(counts > k).mean(axis=0) for k in range(MOST)], axis=1)
    slot, more = np.unravel_index(np.argsort(-(shares * (1 - shares)).ravel(), kind="stable")[:64], shares.shape)
    return np.ascontiguousarray(np.packbits(counts[:, slot] > more, axis=1, bitorder="little")).view("<u8")[:, 0]


def within(codes: np.ndarray, sizes: np.ndarray, l: np.ndarray, r: np.ndarray, room: np.ndarray) -> np.ndarray:  # noqa: E741
    """The edit distance of each pair l, r of rows of codes, which are padded with zeros; one more than its room where it needs more."""
    m, n = sizes[l], sizes[r]
    if (m > n).any():
        l, r = np.where(m > n, r, l), np.where(m > n, l, r)  # noqa: E741
        m, n = np.minimum(m, n), np.maximum(m, n)
    out, apart = room + 1, n - m
    some = np.flatnonzero(apart <= room)
    width = len(codes.T) + 1
    # pairs of one difference of lengths and room have one band; few of them are measured with the next ones
    kind = apart[some] * (int(room.max(initial=0)) + 1) + room[some]
    n = np.bincount(kind)
    group = ((np.cumsum(n) - n) // TOGETHER)[kind]
    order = group * width + width - 1 - m[some]  # long ones first
    some = some[np.argsort(order.astype(np.uint16) if order.max(initial=0) < 1 << 16 else order, kind="stable")]
    group = np.sort(group)
    turned = np.ascontiguousarray(codes.T)
    ends = (np.flatnonzero(np.diff(group)) + 1).tolist()
    for a, b in zip([0, *ends], [*ends, len(some)], strict=True) if len(some) else ():
        part = some[a:b]
        out[part] = _banded(turned, m[part], l[part], r[part], room[part], apart[part])
    return out


def _banded(turned: np.ndarray, sizes: np.ndarray, l: np.ndarray, r: np.ndarray, room: np.ndarray, apart: np.ndarray) -> np.ndarray:  # noqa: E741
    """Distances of pairs whose lengths are `apart`, the shorter text first, in descending order of its length; one more than the room if it is more.

    So many edits stay between the diagonals `low` and `high` of the table; the last cell is on diagonal `apart`.
    """
    aside = (room - apart) // 2
    low, high, big = -int(aside.max()), int((apart + aside).max()), int(room.max()) + 1
    type_ = np.uint8 if big + len(turned) + high - low < 250 else np.uint32  # a cell is one more than that before it at most
    one, room, apart = type_(1), room.astype(type_), (apart - low).astype(type_)
    out = (room + one).astype(np.int64)
    place = np.arange(len(l))
    row = [np.full(len(l), j if 0 <= j < big else big, type_) for j in range(low, high + 1)]  # before the first letter
    letter = lambda j: turned[j].take(r) if 0 <= j < len(turned) else None
    beside = [letter(j) for j in range(low - 1, high)]  # the longer text's letters along the band
    none = int(np.searchsorted(-sizes, 0, side="left"))
    out[none:] = apart[none:].astype(np.int64) + low
    for i in range(1, int(sizes.max(initial=0)) + 1):
        n = int(np.searchsorted(-sizes, -i, side="right")) if sizes[-1] < i else len(sizes)  # longer ones go on
        if not n:
            break
        if n < len(sizes):
            place, sizes, l, r, room, apart = place[:n], sizes[:n], l[:n], r[:n], room[:n], apart[:n]  # noqa: E741
            row, beside = [x[:n] for x in row], [None if x is None else x[:n] for x in beside]
        beside = [*beside[1:], letter(i + high - 1)]
        mine = turned[i - 1].take(l)
        for t in range(len(row)):
            j = i + low + t
            if j <= 0:
                row[t] = np.full(n, min(i, big) if j == 0 else big, type_)
                continue
            cell = row[t] if beside[t] is None else row[t] + (mine != beside[t]).view(np.uint8)
            if t + 1 < len(row):
                cell = np.minimum(cell, row[t + 1] + one)
            if t:
                cell = np.minimum(cell, row[t - 1] + one)
            row[t] = cell
        if sizes[-1] == i:
            ended = int(np.searchsorted(-sizes, -i, side="left"))
            least = np.stack([x[ended:] for x in row])[apart[ended:], np.arange(n - ended)]
            out[place[ended:]] = np.minimum(least, room[ended:] + one)
        if i % LOOK == 0:
            least = row[0] + apart
            for t in range(1, len(row)):
                least = np.minimum(least, row[t] + np.where(apart < t, type_(t) - apart, apart - type_(t)))
            alive = np.flatnonzero(least <= room)
            if 4 * len(alive) < 3 * n:
                place, sizes, l, r, room, apart = (x[alive] for x in (place, sizes, l, r, room, apart))  # noqa: E741
                row, beside = [x[alive] for x in row], [None if x is None else x[alive] for x in beside]
                if not len(alive):
                    break
    return out


def full(codes: np.ndarray, sizes: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """The edit distance of each pair, by bands that grow until they hold it."""
    out = np.zeros(len(l), np.int64)
    left, room = np.arange(len(l)), 3
    while len(left):
        a, b = l[left], r[left]
        most = np.minimum(np.maximum(np.abs(sizes[a] - sizes[b]) + 1, room), np.maximum(sizes[a], sizes[b]))
        out[left] = within(codes, sizes, a, b, most)
        left, room = left[out[left] > most], 2 * room
    return out


def distances(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The edit distance of each pair of rows."""
    width = max(a.shape[1], b.shape[1])
    codes = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b)])
    return full(codes, np.concatenate([a_sizes, b_sizes]), np.arange(len(a)), len(a) + np.arange(len(b)))


class Strips:
    """One or two strips of texts, each in order of length."""

    def __init__(self, texts: list[str], numbers: np.ndarray, second: np.ndarray):
        turned = [t[::-1] for t in texts]
        shared = len(commonprefix([min(turned, default=""), max(turned, default="")]))  # the end of all texts
        codes, rest = small_codes([t[: len(t) - shared] for t in texts])
        self.order = np.lexsort((numbers, rest, second))
        self.codes, self.rest, self.numbers = codes[self.order], rest[self.order].astype(np.int32), numbers[self.order]
        self.sizes = self.rest + shared
        cut = int(np.median(rest)) // 2 if len(rest) else 0
        self.letters, self.halves = _letters(self.codes), _letters(self.codes[:, :cut], self.codes[:, cut:])
        self.start = int((~second).sum()) if second.any() else 0
        self.end = self.start or len(texts)

    def _rooms(self, share: Share) -> None:
        """Kinds of texts by length and number, how many edits pairs of kinds may need, and below how many bits they may differ."""
        both, self.kind = np.unique(np.stack([self.sizes.astype(np.float64), self.numbers.astype(np.float64)]), axis=1, return_inverse=True)
        self.kind = self.kind.reshape(-1).astype(np.int32)
        size, number = both
        room = np.floor(share(number[:, None], number[None, :]) * np.maximum(size[:, None], size[None, :])).astype(np.int32)
        apart = np.abs(size[:, None] - size[None, :]).astype(np.int32)
        self.room = room
        self.below = np.where(room >= apart, np.minimum(2 * room - apart + 1, 255), 0).astype(np.uint8)

    def close(self, share: Share, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs that need no more edits than their share; no pair has a greater share than `most`."""
        for l, r, _ in self.measured(share, most):  # noqa: E741
            yield l, r

    def measured(self, share: Share, most: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same with their edits."""
        if len(self.sizes) < 2:
            return
        self._rooms(share)
        held, size = [], 0
        for a in range(0, self.end, ROWS):
            b = min(a + ROWS, self.end)
            low, high = self.sizes[a], self.sizes[b - 1]
            right = self.sizes[self.start :]
            begin = self.start + int(np.searchsorted(right, low - np.floor(most * low)))
            to = self.start + int(np.searchsorted(right, np.floor(high / max(1 - most, 1e-9)), side="right"))
            for c in range(max(begin, 0 if self.start else a), to, COLUMNS):
                held.append(self._tile(a, b, c, min(c + COLUMNS, to)))
                size += len(held[-1][0])
                if size >= AT_ONCE:
                    yield from self._measured(held)
                    held, size = [], 0
        yield from self._measured(held)

    def _tile(self, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile whose letters may fit."""
        first, last = self.kind[a], self.kind[b - 1]  # mostly the same
        below = self.below[first].take(self.kind[c:d]) if first == last else self.below[self.kind[a:b]].take(self.kind[c:d], axis=1)
        found = np.flatnonzero(np.bitwise_count(self.letters[a:b, None] ^ self.letters[None, c:d]) < below).astype(np.int32)
        p, q = np.divmod(found, np.int32(d - c))
        p, q = p + np.int32(a), q + np.int32(c)
        return (p, q) if self.start or b <= c else (p[p < q], q[p < q])

    def _measured(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not held:
            return
        l, r = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: E741
        room = self.room.ravel().take(self.kind.take(l) * np.int32(len(self.room)) + self.kind.take(r))
        apart = np.abs(self.rest.take(l) - self.rest.take(r))
        # cut at one place, both halves are as near but for what the edits have moved across, which is as much as the lengths differ at most
        near = np.flatnonzero(np.bitwise_count(self.halves.take(l) ^ self.halves.take(r)) <= 2 * room + apart)
        l, r, room = l[near], r[near], room[near]  # noqa: E741
        edits = within(self.codes, self.rest, l, r, room)
        fits = np.flatnonzero(edits <= room)
        if len(fits):
            yield self.order[l[fits]], self.order[r[fits]], edits[fits]


#: What is made of a task's rows and the places and edits of its close pairs: columns of what it returns.
Said = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]]


def in_tasks(share: Share, most: float, said: Said, names: list[str]):
    """The function of a group key, i, j of rows of strips that yields what is said of its close pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        second = rows["own"].to_numpy() != i if i != j else np.zeros(len(rows), bool)
        if len(rows) < 2 or i != j and (second.all() or not second.any()):
            return  # one of the strips is empty
        tell = said(rows)
        for l, r, needed in Strips(rows["text"].to_pylist(), rows["number"].to_numpy(), second).measured(share, most):  # noqa: E741
            columns = tell(l, r, needed)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names)

    return compare


def close_texts(rows: DataFrame, share: Share, most: float, said: Said, schema: str) -> DataFrame:
    """What is said of the pairs of one key whose texts need no more edits than their share. rows: key, word, text, number and more."""
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for, as the rows are few and the work is not
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > STRIP).select("key", F.ceil(F.col("n") / STRIP).cast("int").alias("strips"))
    dealt = rows.join(F.broadcast(many), "key", "left").withColumn("strips", F.coalesce("strips", F.lit(1)))  # a row per key of many texts
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("strips")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    met = dealt.withColumns({"number": F.col("number").cast("double"), "i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "strips")
    names = [c.split()[0] for c in schema.split(", ")]
    return met.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(in_tasks(share, most, said, names), schema)
