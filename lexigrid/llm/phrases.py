"""Collocations: frequent phrases of two to five words, counted by tries that are broadcast.

Texts become sequences of word numbers. Only words that occur often enough have one; they are counted
first, by language, as are all words. Then phrases grow by a word at a time. In each round a double-array
trie of the phrases so far is broadcast, and numpy advances the states of all positions of a batch of
texts together, level by level: the next state is base[state] + word, if check says that it is that
state's child. Accepting states are counted by bincount, and Spark sums the shards.
A phrase can only be frequent if both its parts, without the last and without the first word, are
(Apriori). So each round also takes the positions where such a phrase starts and another one follows a
word later, as pairs of a state and a word; what all shards together see often enough is a candidate,
and goes into the next trie.

Words have 64-bit hashes by language; a clash of two frequent words, one in 2e11 for ten million of
them, would merge them and is refused when numbers are given out. Pieces end at PIECE_END; a sign that no phrase can cross stands
there, and between texts. Counts are exact, overlaps included, and the scores are decimal arithmetic.

Defined cases. Null or empty text: no words. Null language: UNKNOWN. A text without spaces is one word,
of any length. Repeated rows count as often as they are there. An empty table, or one without frequent
words, gives no rows. Columns other than text and language aren't read, so their names can't clash.

Scale: texts are read twice, and written once as numbers of four bytes a word, which each round reads.
Words, states and pairs are counted in the tasks before they are shuffled. A broadcast trie holds TRIE
phrases at most: there is one phrase per `least` words of the corpus at most, and longer lists are cut into blocks, for
each of which the numbers are read again. No row holds more than one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from lexigrid.llm.common import written
from lexigrid.llm.hashing import hash_words, mix
from lexigrid.llm.ranking import ranked

#: Signs at which a piece ends; spaces and tabs end words.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
UNKNOWN = "und"
#: Phrases in one broadcast trie, and words in one broadcast list.
TRIE = 2_000_000
#: Bytes of text, and words, that are handled at once.
TEXT_BYTES, WORDS = 4 << 20, 1 << 20
_MARK = b"."
_TO_MARK = bytes.maketrans(PIECE_END, _MARK * len(PIECE_END))
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9]] = False


# words


def _blob(text: str | None) -> bytes:
    """The text with a mark of its own wherever a piece ends, the end included."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_MARK).replace(_MARK, b" . ") + b" . "


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // TEXT_BYTES)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _hashed(langs: list[str], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words by language, 0 for marks; the language's number of each word; where each text begins."""
    hashes, offsets = hash_words(blobs, NOT_BLANK)
    of, index = {}, []
    for lang in langs:
        index.append(of.setdefault(lang, len(of)))
    salts = np.array([xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang in of], np.uint64)
    own = np.repeat(np.array(index, np.int64), np.diff(offsets))
    mark = hash_words([_MARK], NOT_BLANK)[0][0]
    return np.where(hashes == mark, np.uint64(0), mix(hashes ^ salts[own]) | np.uint64(1)), own, offsets


def _cut(blob: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    begin = 0
    while begin < len(blob):
        end = blob.find(b" ", begin + TEXT_BYTES)
        end = len(blob) if end < 0 else end
        yield blob[begin:end]
        begin = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n), added up for some texts; a null word stands for all words."""
    for batch in _slices(batches, 1):
        given = [(lang, part) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for part in _cut(_blob(t))]
        groups = np.cumsum([len(part) for _, part in given]) // (2 * TEXT_BYTES)
        for k in np.unique(groups):
            yield _counted([x for x, g in zip(given, groups, strict=True) if g == k])


def _counted(given: list[tuple[str, bytes]]) -> pa.RecordBatch:
    langs, blobs = [lang for lang, _ in given], [part for _, part in given]
    hashes, own, _ = _hashed(langs, blobs)
    names = list(dict.fromkeys(langs))
    found, first, n = np.unique(hashes, return_index=True, return_counts=True)
    real = found != 0
    found, first, n = found[real], first[real], n[real]
    tokens = b" ".join(blobs).split()
    every = np.bincount(own[hashes != 0], minlength=len(names))
    columns = [
        pa.array([*(names[k] for k in own[first]), *names], pa.string()),
        pa.array([*(tokens[i].decode("utf-8", "replace") for i in first), *[None] * len(names)], pa.string()),
        pa.array(np.append(found.view(np.int64), np.zeros(len(names), np.int64))),
        pa.array(np.append(n, every).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, hashes) of each text: its words' hashes, and room for their numbers."""
    for batch in _slices(batches, 1):
        hashes, _, offsets = _hashed(batch.column(0).to_pylist(), [_blob(t) for t in batch.column(1).to_pylist()])
        parts = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([bytes(4 * len(x)) for x in parts], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())], ["ids", "hashes"])


def _number(vocabulary, rest: bool):
    """Fills in the numbers of the words that are in this block of the vocabulary; keeps the hashes if more blocks follow."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = vocabulary.value
        for batch in batches:
            hashes = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(known, every), len(known) - 1)
            before = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            ids = np.where(known[at] == every, numbers[at], before).astype(np.int32)
            cuts = np.cumsum([0, *map(len, hashes)])
            whole = pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([whole, *([batch.column(1)] * rest)], ["ids", *["hashes"] * rest])

    return fill


# tries


@dataclass
class Trie:
    """A double array over word numbers. State s has the child base[s] + w if check there is s; the root is 0.

    symbols: the words of the trie, sorted; their places, from 1, are what the array works with, and the
    states of the root's children. phrase: the number of the phrase that ends at a state, else 0.
    """

    symbols: np.ndarray
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray
    depth: int

    def known(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
        return np.where(self.symbols[at] == ids, at + 1, 0)

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Next states, 0 where there is none."""
        at = self.base[states] + words
        at[(states == 0) | (words == 0) | (at < 0) | (at >= len(self.check))] = 0
        at[self.check[at] != states] = 0
        return at

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The number of the phrase that starts at each position, 0 if none does: all positions advance together."""
        words = self.known(ids)
        states = words
        for k in range(1, self.depth):
            states = self.step(states, np.append(words[k:], np.zeros(min(k, len(words)), words.dtype)))
        return self.phrase[states]


def build_trie(rows: np.ndarray, numbers: np.ndarray, seed: int = 42) -> Trie:
    """The trie of phrases of equal length, a row of word numbers each, distinct.

    States with most children are placed first, at the first of some random places where all fit; if none does, the
    array grows. States with a single child fill what is free.
    """
    rng, none = np.random.default_rng(seed), -(1 << 40)
    symbols = np.unique(rows)
    order = np.lexsort(rows.T[::-1])
    local = np.searchsorted(symbols, rows[order]) + 1
    check = np.full(len(symbols) + 1, -1, np.int64)
    check[0], check[1:] = -2, 0
    base = np.full(len(check), none, np.int64)

    def grown(n: int) -> None:
        nonlocal check, base
        check, base = np.append(check, np.full(n, -1, np.int64)), np.append(base, np.full(n, none, np.int64))

    above = local[:, 0].astype(np.int64)  # the state of each row's prefix
    for k in range(1, rows.shape[1]):
        new = np.append(True, np.any(local[1:, : k + 1] != local[:-1, : k + 1], axis=1))
        parents, words = above[new], local[new, k].astype(np.int64)
        begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(begins, len(parents)))
        mine = np.zeros(len(parents), np.int64)
        for j in np.argsort(-sizes, kind="stable"):
            if sizes[j] == 1:
                break
            c = words[begins[j] : begins[j] + sizes[j]]
            span = int(c[-1] - c[0]) + 1
            tries = rng.integers(0, max(len(check) - span, 1), 64) - c[0]
            free = np.zeros(0, bool) if len(check) <= span else (check[tries[:, None] + c[None, :]] == -1).all(axis=1)
            if free.any():
                offset = int(tries[np.argmax(free)])
            else:
                offset = len(check) - int(c[0])
                grown(span)
            base[parents[begins[j]]], check[offset + c] = offset, parents[begins[j]]
            mine[begins[j] : begins[j] + sizes[j]] = offset + c
        one = begins[sizes == 1]
        free = np.flatnonzero(check == -1)
        if len(free) < len(one):
            grown(len(one) - len(free))
            free = np.flatnonzero(check == -1)
        free = free[: len(one)]
        base[parents[one]], check[free], mine[one] = free - words[one], parents[one], free
        above = mine[np.cumsum(new) - 1]
    phrase = np.zeros(len(check), np.int64)
    phrase[above] = numbers[order]
    return Trie(symbols, base, check, phrase, rows.shape[1])


def _words_are_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
        yield ids, ids.astype(np.int64)


def _found(trie):
    """Word numbers of each batch, and the numbers of the phrases that start at each; adds to those found before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        one = trie.value
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            found = np.zeros(len(ids), np.int64) if batch.num_columns == 1 else np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).copy()
            for begin in range(0, len(ids), WORDS):  # what a part's last phrases reach is seen with it
                part = one.find(ids[begin : begin + WORDS + one.depth])[:WORDS]
                found[begin : begin + WORDS] = np.where(part > 0, part, found[begin : begin + WORDS])
            yield ids, found

    return find


def _kept(find):
    """The same as rows, for the next block of phrases."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in find(batches):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["ids", "found"])

    return keep


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    firsts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[firsts], np.add.reduceat(n, firsts) if len(firsts) else n


def _tally(find, phrases: int, extend: bool):
    """(phrase, following, n): how often each phrase is there (following: 0), and a phrase with that which starts a word later."""
    bits = int(phrases).bit_length()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> bits), pa.array(keys & ((1 << bits) - 1)), pa.array(n.astype(np.int64))], ["phrase", "following", "n"])

        accepted, keys, counts, held = np.zeros(min(phrases, TRIE) + 1, np.int64), [], [], 0
        for ids, found in find(batches):
            if phrases <= TRIE:
                accepted += np.bincount(found, minlength=len(accepted))
            else:
                several, n = np.unique(found[found > 0], return_counts=True)
                yield rows(several << bits, n)
            if extend:
                grows = np.flatnonzero((found[:-1] > 0) & (found[1:] > 0))
                some, n = np.unique(found[grows] << bits | found[grows + 1], return_counts=True)
                keys.append(some)
                counts.append(n)
                held += len(some)
                if held > 4 * WORDS:
                    some, n = _merged(keys, counts)
                    keys, counts, held = [some], [n], len(some)
                    if held > 2 * WORDS:
                        yield rows(some, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield rows(*_merged(keys, counts))
        some = np.flatnonzero(accepted[1:]) + 1
        yield rows(some << bits, accepted[some])

    return tally


def _blocks(phrases: DataFrame, n: int, at_once: int) -> Iterator[list]:
    """The rows of a table in blocks of numbers, through the driver one at a time."""
    for low in range(0, n, at_once):
        yield phrases.where(F.col("num").between(low + 1, low + at_once)).collect()


def _composed(*steps):
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches

    return run


def count_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST, at_once: int = TRIE) -> tuple[DataFrame, list[DataFrame]]:
    """A table (lang, n) of all words, and a table of frequent phrases for each length from one to `longest`, if there are any.

    Their columns: num, from 1; parent and tail, the numbers of the phrases without the last and without the first
    word; lang; words; ids, their numbers; f; lefts, how often the first 1, 2, ... words are there; rights, the same for the words
    after these.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    words = texts.mapInArrow(_count_words, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    counted = written(words.where(f"word IS NULL OR n >= {least}"), "phrase-words")
    every, frequent = counted.where("word IS NULL").select("lang", "n"), counted.where("word IS NOT NULL")
    numbered = ranked(frequent.select("lang", "word", "hash"), [], ["hash"], "phrase-ranks").select((F.col("rank") + 1).alias("num"), "hash", "lang", "word")
    own = written(numbered, "phrase-numbers")
    n, different = own.agg(F.count("*"), F.count_distinct("hash")).first()
    if n != different:
        raise ValueError("two frequent words have the same hash")
    none = F.array().cast("array<long>")
    level = own.select("num", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("tail"), "lang", F.array("word").alias("words"), F.array("num").alias("ids"), none.alias("lefts"), none.alias("rights"))
    rows, columns = texts.mapInArrow(_encode, "ids binary, hashes binary"), "ids binary, hashes binary"
    for k, block in enumerate(_blocks(own.select("num", "hash"), n, at_once)):
        last = (k + 1) * at_once >= n
        found = np.array([(r["num"], r["hash"]) for r in block], np.int64).reshape(-1, 2)
        found = found[np.argsort(found[:, 1].view(np.uint64))]
        fill = _number(sc.broadcast((found[:, 1].copy().view(np.uint64), found[:, 0].copy())), not last)
        rows = written(texts.mapInArrow(_composed(_encode, fill), "ids binary" if last else columns) if k == 0 else rows.mapInArrow(fill, "ids binary" if last else columns), "phrase-texts")
    levels: list[DataFrame] = []
    for depth in range(1, longest + 1):
        if not n:
            break
        given, find = rows, _words_are_phrases
        if depth > 1:
            for k, block in enumerate(_blocks(level.select("num", "ids"), n, at_once)):
                find = _found(sc.broadcast(build_trie(np.array([r["ids"] for r in block], np.int64), np.array([r["num"] for r in block], np.int64))))
                if (k + 1) * at_once < n:
                    given = written(given.mapInArrow(_kept(find), "ids binary, found binary"), "phrase-found")
        sums = given.mapInArrow(_tally(find, n, depth < longest), "phrase long, following long, n long").groupBy("phrase", "following").agg(F.sum("n").alias("n"))
        met = written(sums.where(f"following = 0 OR n >= {least}"), "phrase-sums")
        level = written(level.join(met.where("following = 0").select(F.col("phrase").alias("num"), F.col("n").alias("f")), "num"), f"phrases-{depth}")
        levels.append(level)
        # what may be frequent with a word more
        first = level.select(F.col("num").alias("phrase"), "lang", "words", "ids", F.concat("lefts", F.array("f")).alias("lefts"))
        second = level.select(F.col("num").alias("following"), F.element_at("words", -1).alias("word"), F.element_at("ids", -1).alias("id"), F.concat(F.array("f"), "rights").alias("rights"))
        grown = met.where("following > 0").select("phrase", "following").join(first, "phrase").join(second, "following")
        longer = grown.select(F.col("phrase").alias("parent"), F.col("following").alias("tail"), "lang", F.concat("words", F.array("word")).alias("words"), F.concat("ids", F.array("id")).alias("ids"), "lefts", "rights")
        if depth < longest:
            placed = ranked(longer, [], ["parent", "tail"], "phrase-ranks")
            level = written(placed.select((F.col("rank") + 1).alias("num"), *longer.columns), "phrase-candidates")
            n = level.count()
    return every, levels


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), in decimals of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), (big(left) * big(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST, top: int = 2000, at_once: int = TRIE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best of each language, without phrases that are part of one as frequent.

    A longer phrase is never more frequent than its parts. So a phrase that is part of one as frequent is also
    part of one as frequent that has one word more, and only these are looked at.
    """
    every, levels = count_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, at_once=at_once)
    kept = docs.sparkSession.createDataFrame([], "lang string, words array<string>, f long, lefts array<long>, rights array<long>")
    for mine, longer in zip(levels[1:], [*levels[2:], None], strict=False):
        if longer is not None:
            within = longer.select(F.col("parent").alias("num"), F.col("f").alias("g")).union(longer.select("tail", "f")).groupBy("num").agg(F.max("g").alias("g"))
            mine = mine.join(within, "num", "left").where("g IS NULL OR 100 * g < 100 * f")
        kept = kept.union(mine.select("lang", "words", "f", "lefts", "rights"))
    scored = kept.join(F.broadcast(every) if every.count() <= 100_000 else every, "lang").withColumn(
        "cut",
        F.array_min(F.transform("lefts", lambda left, i: F.struct(_score(F.col("f"), F.col("n"), left, F.get("rights", i)).alias("score"), i.alias("k"), left.alias("l"), F.get("rights", i).alias("r")))),
    )
    found = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
