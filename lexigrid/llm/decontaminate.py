"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages whose TF-IDF vectors (over hashed words) are projected by a randomised
SVD, whitened, so that every latent direction counts alike. All words weigh something, common ones little.
For each piece of a benchmark item, all passages of fitting length with a cosine of at least COSINE are candidates.
A candidate is confirmed by the longest common subsequence of words: at once if it holds most of the item. It is a
paraphrase, which may have its clauses in another order, if the passage has a good part of the item's words at all and a fair
part of them in order, and holds all words of the item's answer, its rarest words.
Items under SHORT words have no more than a few words to go by: they are looked for as n-grams, whole, by
the hash of each sequence of as many words.

The SVD is distributed: tasks multiply their passages' TF-IDF matrix with a random one and with its
own transpose; these products, whose size is fixed, are summed by Spark, and the small rest is
solved on the driver. Word statistics and the SVD cover all documents, as does the search every passage of them.

Defined cases. Null or empty text: no passages. Items without words, or null, match nothing; items under
SHORT words match only if whole. Items over 64 words are cut into pieces, any of which counts.
Repeated rows are judged alike, repeated items give their ids, items of equal ids are each looked for. Very long texts are
searched in blocks, whole. An empty table or benchmark gives no hits. Other columns pass through whatever their names; __items
replaces a column so called.

Scale: four scans of the documents; no shuffle but of word counts and products of
fixed size, and only texts go to Python. The benchmark is a stated query set: its pieces go to all tasks in blocks of
ITEMS, of which the driver holds one at a time. The work is a product of passages and pieces in RANK dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from lexigrid.llm.common import boxed, written
from lexigrid.llm.hashing import ALNUM, hash_words, mix

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
RANK = 48
#: What a word weighs that is in every passage.
LEAST_WEIGHT = 0.3
BLOCK = 16
#: (most words of an item, blocks of a passage that holds such an item wherever it begins)
WIDTHS = ((17, 2), (33, 3), (65, 5))
PIECE_WORDS = 64
COSINE = 0.2
#: Shares of an item's words: in the common subsequence at once, or in a passage at all and in the common subsequence.
SURE, LIKELY, ORDERED = 0.8, 0.6, 0.4
ANSWER_WORDS = 3
SHORT = 8
#: Pieces that are broadcast at once, and cosines that a task holds.
ITEMS, COSINES = 20_000, 1 << 20
_SUM_ROWS = 1024
WIDEST = WIDTHS[-1][1]
#: Marks of a block, in numbers of 64 bits: for all candidates, and, by other bits of the hashes, for those that are left.
LANES, MORE_LANES = 8, 16
#: Runs of words whose vectors are gathered at once, few enough for the processor's cache, and the places that runs are given.
RUNS = 256
PLACES = (BLOCK // 4, BLOCK)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # FEATURES x RANK: TF-IDF to latent

    @cached_property
    def weighted(self) -> np.ndarray:
        """Made in the tasks, so that the driver neither holds nor sends it."""
        return self.basis * self.idf.astype(np.float32)[:, None]


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], ALNUM)


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20):
    """Slices of batches with some 4 MB of text each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        begin, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
            size += n
            if size > limit:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block of BLOCK words, and the text it is of; blocks don't cross texts."""
    n = np.diff(offsets)
    per = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), per)
    first = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return offsets[:-1][text] + first * BLOCK, text


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, passages that have it); feature -1 counts passages."""
    sums, passages = np.zeros(FEATURES, np.int64), 0
    for batch in _batches(batches, "text"):
        hashes, offsets = _words(batch.column(0).to_pylist())
        starts, _ = _blocks(offsets)
        passages += len(starts)
        if len(starts):
            block = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff(np.append(starts, len(hashes))))
            both = np.sort(block * FEATURES + _features(hashes))
            sums += np.bincount(both[np.append(True, both[1:] != both[:-1])] % FEATURES, minlength=FEATURES)
    if passages:
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], passages))], ["feature", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the feature)) + LEAST_WEIGHT, over all documents."""
    n = np.zeros(FEATURES + 1)
    counted = docs.mapInArrow(_count_features, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # FEATURES numbers
        n[row["feature"]] = row["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])) + LEAST_WEIGHT


def _tfidf(hashes: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, passage and weight of each word; a passage's vector of weights has length 1 (words counted apart)."""
    features = _features(hashes)
    passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
    weight = idf.astype(np.float32)[features]
    norm = np.sqrt(np.maximum(np.add.reduceat(weight * weight, starts), 1e-12))
    return features, passage, weight / norm[passage]


def _sums(vectors: np.ndarray, rows: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows of vectors that a run names; runs have BLOCK places at most.

    A small product for each run, as reduceat takes several times as long for sums over rows. Short runs get fewer places.
    """
    out = np.zeros((len(starts), vectors.shape[1]), np.float32)
    gathered = np.empty((RUNS * BLOCK, vectors.shape[1]), np.float32)
    least = 0
    for width in PLACES:
        places = np.arange(width)
        mine = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        for a in range(0, len(mine), RUNS):
            runs = mine[a : a + RUNS]
            at = starts[runs, None] + places
            there = places < sizes[runs, None]
            named = np.where(there, rows.take(at, mode="clip"), 0)
            scaled = np.where(there, weight.take(at, mode="clip"), np.float32(0))
            got = vectors.take(named.ravel(), axis=0, out=gathered[: named.size], mode="clip").reshape(len(runs), width, -1)
            out[runs] = np.matmul(scaled[:, None, :], got)[:, 0]
    return out


def _add_by_feature(z: np.ndarray, y: np.ndarray, features: np.ndarray, passage: np.ndarray, weight: np.ndarray) -> None:
    """Adds A'y to z: to each feature's row those of its passages, by its weight there. A feature's words are summed by BLOCK first."""
    order = np.argsort(features.astype(np.uint16), kind="stable")
    found = features[order]
    heads = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    n = np.diff(np.append(heads, len(found)))
    runs = -(-n // BLOCK)
    first = np.cumsum(runs) - runs
    skipped = (np.arange(runs.sum()) - np.repeat(first, runs)) * BLOCK
    sums = _sums(y, passage[order], weight[order], np.repeat(heads, runs) + skipped, np.minimum(np.repeat(n, runs) - skipped, BLOCK))
    one = runs == 1
    z[found[heads[one]]] += sums[first[one]]
    if not one.all():
        z[found[heads[~one]]] += np.add.reduceat(sums[~np.repeat(one, runs)], np.cumsum(runs[~one]) - runs[~one])


def _random(seed: int) -> np.ndarray:
    """FEATURES x RANK, the same wherever it is drawn; by parts, so that only one is held in double precision."""
    draw = np.random.default_rng(seed)
    out = np.empty((FEATURES, RANK), np.float32)
    for a in range(0, FEATURES, _SUM_ROWS):
        out[a : a + _SUM_ROWS] = draw.standard_normal((_SUM_ROWS, RANK))
    return out


def _sketch(idf, seed: int):
    """Rows of A'(A omega), A the tasks' passages by features, omega drawn at random, in blocks of _SUM_ROWS."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _random(seed)
        z = np.zeros((FEATURES, RANK), np.float32)
        for batch in _batches(batches, "text"):
            hashes, offsets = _words(batch.column(0).to_pylist())
            starts, _ = _blocks(offsets)
            if not len(starts):
                continue
            features, passage, weight = _tfidf(hashes, starts, idf.value)
            y = _sums(omega, features, weight, starts, np.diff(np.append(starts, len(hashes))))
            _add_by_feature(z, y, features, passage, weight)
        if z.any():
            parts = range(0, FEATURES, _SUM_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([p // _SUM_ROWS for p in parts], pa.int64()), pa.array([z[p : p + _SUM_ROWS].tobytes() for p in parts], pa.binary())], ["part", "sums"])

    return sketch


def _gram(idf, basis):
    """B'B of the tasks' passages in the basis."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((RANK, RANK), np.float32)
        for batch in _batches(batches, "text"):
            hashes, offsets = _words(batch.column(0).to_pylist())
            starts, _ = _blocks(offsets)
            if len(starts):
                features, _, weight = _tfidf(hashes, starts, idf.value)
                y = _sums(basis.value, features, weight, starts, np.diff(np.append(starts, len(hashes))))
                c += y.T @ y
        if c.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["part", "sums"])

    return gram


def _add(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in group.column("sums")], axis=0, dtype=np.float32)
    return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame) -> np.ndarray | None:
    """Sums by part, one part after the other, RANK columns; a part has a row per task. None if there are none."""
    parts = sorted((r["part"], r["sums"]) for r in rows.groupBy("part").applyInArrow(_add, "part long, sums binary").collect())
    return np.frombuffer(b"".join(sums for _, sums in parts), np.float32).reshape(-1, RANK).copy() if parts else None


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """z, overwritten by an orthonormal basis of what its columns span, blank where they depend on each other.

    From its small Gram matrix, twice for precision, by parts: so the driver holds z once, and a part in double precision.
    """
    for _ in range(2):
        parts = [z[a : a + _SUM_ROWS] for a in range(0, len(z), _SUM_ROWS)]
        values, vectors = np.linalg.eigh(sum(p.T @ p for p in (part.astype(np.float64) for part in parts)))
        turn = vectors * np.where(values > values.max() * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
        for part in parts:
            part[:] = part.astype(np.float64) @ turn
    return z


def fit(docs: DataFrame, *, text_col: str = "text", fit_docs: int | None = None, seed: int = 42) -> Model:
    """The latent model of all documents, or of some fit_docs of them if asked for; a plain random projection if none of these has words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    idf = inverse_frequencies(texts)
    sample = texts if fit_docs is None else texts.sample(min(1.0, fit_docs / max(docs.count(), 1)), seed)
    shared_idf = sc.broadcast(idf)
    z = _summed(sample.mapInArrow(_sketch(shared_idf, seed), "part long, sums binary"))
    if z is None:
        return Model(idf, _random(seed))
    q = _orthonormal(z)
    basis = sc.broadcast(q)
    c = _summed(sample.mapInArrow(_gram(shared_idf, basis), "part long, sums binary"))
    basis.destroy()
    shared_idf.destroy()
    values, vectors = np.linalg.eigh(c.astype(np.float64))
    scale = np.where(values > values.max() * 1e-7, 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
    return Model(idf, q @ (vectors * scale).astype(np.float32))


@dataclass
class Piece:
    item_id: int
    words: np.ndarray
    blocks: int
    answer: frozenset[int]

    def __post_init__(self):
        self.masks: dict[int, int] = {}
        for k, w in enumerate(self.words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << k


def pieces_of(items: list[tuple[int, str | None]], model: Model) -> list[Piece]:
    out = []
    for item_id, text in items:
        hashes, _ = _words([text])
        n = max(1, -(-len(hashes) // PIECE_WORDS))
        for part in np.array_split(hashes, n):
            if len(part):
                rare = sorted(set(part.tolist()), key=lambda w: (-model.idf[w >> (64 - FEATURE_BITS)], w))[:ANSWER_WORDS]
                out.append(Piece(item_id, part, next(b for most, b in WIDTHS if len(part) <= most), frozenset(rare)))
    return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    full = v = (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def confirmed(piece: Piece, words: np.ndarray) -> bool:
    """Whether a passage holds the piece: in order, or as a paraphrase. Pieces under SHORT words have to be whole."""
    n, region = len(piece.words), words.tolist()
    if n < SHORT:
        return any(region[k : k + n] == piece.words.tolist() for k in range(len(region) - n + 1))
    return _held(piece, region, set(region))


def _held(piece: Piece, region: list[int], distinct: set[int]) -> bool:
    """The same for pieces that aren't short, of a passage's words and the set of these."""
    n = len(piece.words)
    there = piece.masks.keys() & distinct
    if len(there) < len(piece.masks) - (1 - LIKELY) * n:  # more words are missing than may be
        return False
    found = common_subsequence(piece.masks, n, region)
    return found >= SURE * n or (found >= ORDERED * n and piece.answer <= there)


def _marks(hashes: np.ndarray, starts: np.ndarray, lanes: int = LANES, skipped: int = 0) -> np.ndarray:
    """64 * lanes bits for each block: one for each of its words, by its hash without the lowest bits."""
    out = np.empty((len(starts), lanes), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    bit = (hashes >> np.uint64(skipped) & np.uint64(64 * lanes - 1)).astype(np.int64)
    for a in range(0, len(starts), RUNS):
        mine, to = starts[a : a + RUNS], ends[a : a + RUNS]
        set_ = np.zeros((len(mine), 64 * lanes), bool)
        set_[np.repeat(np.arange(len(mine)), to - mine), bit[mine[0] : to[-1]]] = True
        out[a : a + RUNS] = np.packbits(set_, axis=1, bitorder="little").view("<u8")
    return out


def _more_marks(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _marks(hashes, starts, MORE_LANES, (64 * LANES).bit_length() - 1)


def _bits(marks: np.ndarray) -> np.ndarray:
    """Number of bits set in each row, 255 at most: the bytes of a number's product with ones are sums of its bytes."""
    by_lane = np.bitwise_count(marks)
    return sum((by_lane.view(np.uint64)[:, k] * np.uint64(0x0101010101010101)) >> np.uint64(56) for k in range(marks.shape[1] // 8))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    return mix(sum((hashes[k : len(hashes) - n + 1 + k] * powers[k] for k in range(n)), np.zeros(max(len(hashes) - n + 1, 0), np.uint64)))


class Searcher:
    """Finds pieces in texts; built once in a task."""

    def __init__(self, model: Model, pieces: list[Piece], cosine: float):
        self.model, self.cosine, self.by_width = model, cosine, {}
        self.short: dict[int, dict[int, list[Piece]]] = {}  # by number of words and hash
        for p in pieces:
            if len(p.words) < SHORT:
                self.short.setdefault(len(p.words), {}).setdefault(int(_sequences(p.words, len(p.words))[0]), []).append(p)
        long = [p for p in pieces if len(p.words) >= SHORT]
        self.at_once = max(64, COSINES // max(len(long), 1))
        for blocks in sorted({p.blocks for p in long}):
            mine = [p for p in long if p.blocks == blocks]
            vectors = np.stack([model.weighted[_features(p.words)].sum(axis=0) for p in mine])
            wanted = np.concatenate([_marks(p.words, np.zeros(1, np.int64)) for p in mine])
            more = np.concatenate([_more_marks(p.words, np.zeros(1, np.int64)) for p in mine])
            # so many words may be missing at most; marks can hide that words are missing, not make them so
            missing = np.array([int((1 - LIKELY) * len(p.words) + 1e-9) for p in mine], np.uint64)
            self.by_width[blocks] = (mine, np.ascontiguousarray(_unit(vectors).T), wanted, more, missing)

    def hits(self, texts: list[str | None]) -> list[set[int]]:
        """The ids of the items found in each text."""
        hashes, offsets = _words(texts)
        out: list[set[int]] = [set() for _ in texts]
        starts, text = _blocks(offsets)
        if len(starts):
            self._whole(hashes, offsets, out)
            for a in range(0, len(starts), self.at_once):
                self._near(hashes, offsets, starts, text, a, min(a + self.at_once, len(starts)), out)
        return out

    def _whole(self, hashes: np.ndarray, offsets: np.ndarray, out: list[set[int]]) -> None:
        """Short pieces, by equal n-grams."""
        for n, asked in self.short.items():
            found = _sequences(hashes, n)
            for at in np.flatnonzero(np.isin(found, np.array(list(asked), np.uint64))).tolist():
                t = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + n <= offsets[t + 1]:
                    out[t].update(p.item_id for p in asked[int(found[at])] if (p.words == hashes[at : at + n]).all())

    def _near(self, hashes, offsets, starts, text, a: int, b: int, out: list[set[int]]) -> None:
        """Pieces near the passages that begin with the blocks a to b, by cosine, then confirmed."""
        if not self.by_width:
            return
        ends = np.append(starts, len(hashes))
        # sums of blocks, with blank ones after each text, so that no passage holds words of two texts
        gap = WIDEST - 1
        first, last = a, b - 1
        low = first + gap * text[first]
        upto = b
        while upto < len(starts) and upto - b < WIDEST and text[upto] == text[last]:  # blocks that the last passages reach
            upto += 1
        place = np.arange(first, upto) + gap * text[first:upto] - low
        n = int(last + gap * text[last] - low + 1)
        mine = hashes[ends[first] : ends[upto]]
        padded = np.zeros((n + WIDEST + 1, RANK), np.float32)
        sizes = ends[first + 1 : upto + 1] - starts[first:upto]
        padded[place] = _sums(self.model.weighted, _features(mine), np.ones(len(mine), np.float32), starts[first:upto] - ends[first], sizes)
        block_at = np.full(n, -1)
        block_at[place[: b - a]] = np.arange(a, b)
        # a row before the first block: a passage's region begins within the block before
        low_block = first - 1 if a and text[a - 1] == text[a] else first
        marks, more_marks = (np.zeros((n + WIDEST + 2, lanes), np.uint64) for lanes in (LANES, MORE_LANES))
        marked = np.append(0, place + 1)[low_block - first + 1 :]
        of = hashes[ends[low_block] : ends[upto]], starts[low_block:upto] - ends[low_block]
        marks[marked], more_marks[marked] = _marks(*of), _more_marks(*of)
        window, had = padded[:n].copy(), 1
        room = max(COSINES >> 7, 1)
        asked, absent = np.empty((room, LANES), np.uint64), np.empty((room, LANES), np.uint64)
        for blocks, (pieces, vectors, wanted, more, missing) in self.by_width.items():
            for k in range(had, blocks):
                window += padded[k : k + n]
            had = blocks
            least = self.cosine * np.sqrt(np.einsum("ij,ij->i", window, window))
            least[block_at < 0] = np.inf
            near = window @ vectors >= np.maximum(least, 1e-9)[:, None]
            at = np.repeat(np.arange(n), np.count_nonzero(near, axis=1))
            p = np.flatnonzero(near) - at * len(pieces)
            words = marks[:n].copy()
            for k in range(1, blocks + 2):
                words |= marks[k : k + n]
            np.invert(words, out=words)
            for begin in range(0, len(at), room):
                i, j = at[begin : begin + room], p[begin : begin + room]
                gone = np.bitwise_and(wanted.take(j, axis=0, out=asked[: len(j)], mode="clip"), words.take(i, axis=0, out=absent[: len(i)], mode="clip"), out=asked[: len(j)])
                fits = np.flatnonzero(_bits(gone) <= missing.take(j))
                if not len(fits):
                    continue
                i, j = i[fits], j[fits]
                had_words = more_marks[i]
                for k in range(1, blocks + 2):
                    had_words |= more_marks[i + k]
                fits = _bits(more[j] & ~had_words) <= missing[j]
                before = -1
                for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                    if x != before:  # a passage's candidates follow each other
                        before, block = x, block_at[x]
                        t = text[block]
                        start = max(starts[block] - BLOCK // 2, offsets[t])
                        region = hashes[start : min(starts[block] + blocks * BLOCK + BLOCK // 2, offsets[t + 1])].tolist()
                        distinct = set(region)
                    if pieces[y].item_id not in out[t] and _held(pieces[y], region, distinct):
                        out[t].add(pieces[y].item_id)


def _text_slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices with some 4 MB of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    ends = np.append(np.flatnonzero(np.diff(sizes // limit)) + 1, len(texts))
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        yield texts.slice(begin, end - begin)


def _search(shared, cosine: float):
    """A function of texts: the sorted ids of the items that each holds."""

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(*shared.value, cosine)
        for texts in batches:
            found = [sorted(x) for part in _text_slices(texts) if len(part) for x in searcher.hits(part.to_pylist())]
            yield pa.array(found, pa.list_(pa.int64()))

    # not repeated where its result is used twice, as by a filter that Spark infers
    return F.arrow_udf(search, ArrayType(LongType())).asNondeterministic()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, fit_docs: int | None = None) -> DataFrame:
    """The documents with __items, the sorted ids of the benchmark items that each holds."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(boxed(docs, [c for c in docs.columns if c != "__items"]), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = written(benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("id IS NOT NULL").withColumn("n", F.monotonically_increasing_id()), "benchmark-items")
    blocks = -(-items.count() // ITEMS)
    found = rows.select("__in", F.expr("CAST(array() AS array<bigint>)").alias("items"), "text")
    model = fit(docs, text_col=text_col, fit_docs=fit_docs) if blocks else None
    for k in range(blocks):  # blocks of the query set
        asked = [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == k).orderBy("n").collect()]
        if k:
            found = written(found, "benchmark-found")
        hits = _search(sc.broadcast((model, pieces_of(asked, model))), cosine)(F.col("text"))
        found = found.select("__in", (F.array_sort(F.array_union("items", hits)) if k else hits).alias("items"), "text")
    return found.select("__in.*", F.col("items").alias("__items"))
