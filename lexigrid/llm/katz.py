"""Language-model scoring by Katz backoff over word bigrams.

Counts are discounted by Good-Turing: with r* = (r + 1) n(r+1) / n(r), a count r up to K is multiplied by
d(r) = (r* / r - A) / (1 - A), where A = (K + 1) n(K+1) / n(1). Where the counts of counts give no
value between 0 and 1 (small corpora), and above K, half a count is taken off instead: with whole counts above
K, as Katz has them, a context that is followed by frequent words only would leave nothing for any other, and
a text that has one there would score minus infinity. The probability of w
after h is

    d(r) r / c(h)                 if the pair was seen r times in training,
    alpha(h) P(w)                 if h was seen, but not the pair,
    P(w)                          if h wasn't seen,

and, one order below, P(w) = (1 - L) c(w) / N for words seen in training and L for any other word,
L = n(1) / N, at most 1/2. alpha(h) = (1 - sum of discounted) / (1 - sum of P(w)), both over the words
seen after h, so that the probabilities after each h sum to 1 exactly. A text's first word follows a
start that is no word; its end is a token.

How Spark runs it. Tasks cut documents into chunks, whose words become 64-bit hashes, and each chunk
counts its own words first:

1. chunks' word lists, in buckets by hash, are summed: the unigram table. Each chunk gets the ids and
   totals of its words back;
2. chunks meet their totals and send each distinct pair once, with counts and the documents it is in, to
   a bucket of its context. A context with more than its share of tokens is split by the pair;
3. a bucket has all counts of its pairs: the bigram table. It gives log-probability sums per document
   but for discounts, unseen pairs, and sums per context;
4. discounts follow from all counts of counts; alphas by context are joined to the unseen pairs, and all
   is summed by document.

So every shuffle is of rows that are aggregated per chunk, in compressed columns; buckets are as many as the
counted tokens ask for, and none holds more than its share; tables are written to the shared folder, by kind.

Defined cases. Null text: empty; its only token is the end. Null id: its text for the fold is empty.
Repeated rows are scored and counted each. Without training documents every token has P = 1, as the unknown
word is all there is. An empty table gives no rows. Other columns are ignored. Words are told apart
by 64-bit hashes: for 10^8 distinct words the odds that any two clash are 1 in 3,700.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm.common import scratch, written
from lexigrid.llm.hashing import NOT_SPACE, hash_words, mix

K = 5
#: Bytes of text in a chunk, but for a last document that goes beyond.
CHUNK_BYTES = 8 << 20
#: Tokens that a bucket of pairs should hold; their arrays are some 150 bytes a token.
BUCKET_TOKENS = 2 << 20
END = np.uint64(0x6C65786967726964)
START_ID = 0
_PLANES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(x: np.ndarray) -> bytes:
    """Compressed whole numbers or doubles: of the fewest bytes that hold them, bytes of equal weight together."""
    if x.dtype.kind == "f":
        kind, x = b"f", x.astype(np.float64)
    else:
        top = int(x.max()) if len(x) else 0
        width = next(w for w in _PLANES if top < 1 << (8 * w))
        kind, x = str(width).encode(), x.astype(_PLANES[width])
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else x
    return kind + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    kind = np.float64 if data[:1] == b"f" else _PLANES[int(data[:1])]
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).ravel() if len(raw) else raw
    return flat.view(kind) if kind == np.float64 else flat.view(kind).astype(np.int64)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk id, doc ids, which are held out, tokens of each, the chunk's words (hashes in order), place of each token there."""
    seq, ids, blobs, size = 0, [], [], 0
    base = TaskContext.get().partitionId() << 32

    def chunk():
        hashes, offsets = hash_words(blobs, NOT_SPACE)
        tokens = np.insert(hashes, offsets[1:], END)
        words_of_chunk, place = np.unique(tokens, return_inverse=True)
        return base + seq, ids, np.array([held_out(i) for i in ids], bool), np.diff(offsets) + 1, words_of_chunk, place

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            blobs.append((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
            size += len(blobs[-1])
            if size >= CHUNK_BYTES:
                yield chunk()
                seq, ids, blobs, size = seq + 1, [], [], 0
    if ids:
        yield chunk()


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _word_lists(buckets: int):
    """(bucket, chunk, hashes, counts): the chunk's words in the bucket, and how often training documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, held, sizes, words_of_chunk, place in _chunks(batches):
            counts = np.bincount(place, weights=np.repeat(~held, sizes), minlength=len(words_of_chunk)).astype(np.int64)
            cuts = np.searchsorted(_bucket_of(words_of_chunk, buckets), np.arange(buckets + 1))
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array([pack(words_of_chunk[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()), pa.array([pack(counts[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())],
                ["bucket", "chunk", "hashes", "counts"],
            )

    return run


LEXICON = "kind string, bucket long, chunk long, ids binary, counts binary, tokens long, types long, once long"


def _sum_bucket(buckets: int):
    """Totals of a bucket of words: the table itself, its sums, and each chunk's words' ids and totals."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        hashes = [unpack(x.as_py()).view(np.uint64) for x in group.column("hashes")]
        counts = [unpack(x.as_py()) for x in group.column("counts")]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(words)).astype(np.int64)
        rows = [("table", bucket, None, pack(words), pack(totals), int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()))]
        at = 0
        for chunk, h in zip(group.column("chunk").to_pylist(), hashes, strict=True):
            mine = place[at : at + len(h)]
            at += len(h)
            rows.append(("chunk", bucket, chunk, pack(1 + mine * buckets + bucket), pack(totals[mine]), None, None, None))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("kind", "bucket", "chunk", "ids", "counts", "tokens", "types", "once")
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its documents, and the places of their tokens among its words."""
    for chunk, ids, held, sizes, words_of_chunk, place in _chunks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(held.astype(np.uint8))], pa.binary()), pa.array([pack(sizes)], pa.binary()), pa.array([pack(place)], pa.binary()), pa.array([len(words_of_chunk)], pa.int64())],
            ["chunk", "docs", "held", "sizes", "places", "words"],
        )


TOKENS = "chunk long, docs array<bigint>, held binary, sizes binary, places binary, words long"
PAIRS = "bucket long, chunk long, docs array<bigint>, body binary, sizes array<bigint>"


def _join_blobs(parts: list[bytes]) -> tuple[bytes, list[int]]:
    return b"".join(parts), [len(p) for p in parts]


def _split_blobs(body: bytes, sizes: list[int]) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    return [unpack(body[e - n : e]) for n, e in zip(sizes, ends, strict=True)]


def _pairs(buckets: int, tokens: int, types: int, training_docs: int):
    """A row for each bucket that the chunk has pairs for, and one with what its documents have by themselves."""
    hot = max(4096, tokens // (2 * buckets))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lexicon = right.sort_by("bucket")
        ids = np.concatenate([unpack(x.as_py()) for x in lexicon.column("ids")])
        totals = np.concatenate([unpack(x.as_py()) for x in lexicon.column("counts")])
        row = left.slice(0, 1).to_pylist()[0]
        if left.num_rows != 1 or len(ids) != row["words"]:
            raise ValueError("a chunk differs between two scans of the documents")
        held, sizes, places = unpack(row["held"]).astype(bool), unpack(row["sizes"]), unpack(row["places"])
        n_docs, chunk, words = len(sizes), row["chunk"], len(ids)
        doc = np.repeat(np.arange(n_docs), sizes)
        c = totals[places]
        base = np.bincount(doc, weights=np.log10(c + 1), minlength=n_docs) - sizes * np.log10(tokens + types + 1)
        known = np.bincount(doc, weights=c > 0, minlength=n_docs).astype(np.int64)
        rows = [(chunk % buckets, chunk, row["docs"], *_join_blobs([pack(held.astype(np.uint8)), pack(sizes), pack(known), pack(base)]))]
        before = np.append(0, 1 + places[:-1])
        before[np.append(0, np.cumsum(sizes)[:-1])] = 0  # 0: the start; else a word's place + 1
        key = before * words + places
        del before, places, c
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        occurs = np.diff(np.append(first, len(key)))
        trained = np.add.reduceat((~held)[doc].astype(np.int64), first)
        del order
        context, follower = np.divmod(key[first], words)
        own_id, own_total = np.append(START_ID, ids), np.append(training_docs, totals)
        context_id, context_total = own_id[context], own_total[context]
        spread = np.where(context_total > hot, ids[follower], 0).astype(np.uint64)
        bucket = (mix(mix(context_id.astype(np.uint64)) + spread) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            at = by_bucket[cuts[b] : cuts[b + 1]]
            if len(at):
                n = occurs[at]
                docs_at = np.repeat(first[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                rows.append((b, chunk, None, *_join_blobs([pack(context_id[at]), pack(context_total[at]), pack(ids[follower[at]]), pack(totals[follower[at]]), pack(trained[at]), pack(n), pack(doc[docs_at])])))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
        return pa.table({n: pa.array(c, t) for n, t, c in zip(("bucket", "chunk", "docs", "body", "sizes"), kinds, zip(*rows, strict=True), strict=True)})

    return run


RESULTS = "kind string, chunk long, docs array<bigint>, body binary, sizes array<bigint>, context long, doc long, n long, mass double, lower double, low array<bigint>"
_RESULT_TYPES = (("kind", pa.string()), ("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("body", pa.binary()), ("sizes", pa.list_(pa.int64())), ("context", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("mass", pa.float64()), ("lower", pa.float64()), ("low", pa.list_(pa.int64())))


def _results(size: int, **columns) -> pa.Table:
    return pa.table({k: columns[k] if k in columns else pa.nulls(size, t) for k, t in _RESULT_TYPES})


def _score_bucket(tokens: int, once: int):
    """What a bucket of pairs says: counts of counts, its table, and sums by document and by context."""
    lost = lower_mass(tokens, once)

    def run(group: pa.Table) -> pa.Table:
        rows, own, out = [], [], []
        for r in group.to_pylist():
            (own if r["docs"] is not None else rows).append(r)
        if own:
            out.append(_results(len(own), kind=pa.array(["docs"] * len(own)), chunk=pa.array([r["chunk"] for r in own], pa.int64()), docs=pa.array([r["docs"] for r in own], pa.list_(pa.int64())), body=pa.array([r["body"] for r in own], pa.binary()), sizes=pa.array([r["sizes"] for r in own], pa.list_(pa.int64()))))
        if not rows:
            return pa.concat_tables(out)
        parts = [_split_blobs(r["body"], r["sizes"]) for r in rows]
        context, c1, follower, c2, trained = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort((follower, context))
        same = (context[order][1:] == context[order][:-1]) & (follower[order][1:] == follower[order][:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(np.append(False, ~same)) if len(order) else 0
        head = order[np.flatnonzero(np.append(True, ~same))]
        r_of_pair = np.bincount(pair, weights=trained).astype(np.int64)
        lower = np.where(c2[head] > 0, (1 - lost) * c2[head] / max(tokens, 1), lost)
        r, p1 = r_of_pair[pair], lower[pair]
        # the bigram table and its counts of counts
        seen = r_of_pair > 0
        out.append(_results(K + 1, kind=pa.array(["counts"] * (K + 1)), context=pa.array(np.arange(1, K + 2)), n=pa.array([int((r_of_pair == k).sum()) for k in range(1, K + 2)], pa.int64())))
        body, sizes = _join_blobs([pack(context[head][seen]), pack(follower[head][seen]), pack(r_of_pair[seen])])
        out.append(_results(1, kind=pa.array(["table"]), body=pa.array([body], pa.binary()), sizes=pa.array([sizes], pa.list_(pa.int64()))))
        # by context: heads are in order of contexts
        h = head[seen]
        if len(h):
            starts = np.flatnonzero(np.append(True, context[h][1:] != context[h][:-1]))
            rs, cs = r_of_pair[seen], c1[h]
            mass = np.add.reduceat(np.where(rs > K, (rs - 0.5) / cs, 0.0), starts)
            low = np.stack([np.add.reduceat((rs == k).astype(np.int64), starts) for k in range(1, K + 1)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * K), pa.array(low.ravel()))
            out.append(_results(len(starts), kind=pa.array(["contexts"] * len(starts)), context=pa.array(context[h][starts]), n=pa.array(cs[starts]), mass=pa.array(mass), lower=pa.array(np.add.reduceat(lower[seen], starts)), low=flat))
        # by document: what doesn't need the discounts, and how many tokens need which
        value = np.where(r > 0, np.log10(np.where(r > K, r - 0.5, np.maximum(r, 1)) / np.maximum(c1, 1)), np.log10(np.maximum(p1, 1e-300)))
        open_ = (r == 0) & (c1 > 0)
        at = 0
        for given, p in zip(rows, parts, strict=True):
            mine = slice(at, at + len(p[0]))
            at += len(p[0])
            docs, sized = p[6], p[5]
            top = int(docs.max()) + 1
            occ = lambda x: np.repeat(x[mine], sized)  # noqa: B023, E731
            sums = np.bincount(docs, weights=occ(value), minlength=top)
            ro = occ(r)
            lows = [np.bincount(docs, weights=ro == k, minlength=top).astype(np.int64) for k in range(1, K + 1)]
            some = np.flatnonzero(np.bincount(docs, minlength=top))
            body, sizes = _join_blobs([pack(some), pack(sums[some]), *(pack(x[some]) for x in lows)])
            out.append(_results(1, kind=pa.array(["sums"]), chunk=pa.array([given["chunk"]], pa.int64()), body=pa.array([body], pa.binary()), sizes=pa.array([sizes], pa.list_(pa.int64()))))
            if (oo := occ(open_)).any():
                both = np.stack([occ(context)[oo], docs[oo]])
                uniq, n = np.unique(both, axis=1, return_counts=True)
                out.append(_results(len(n), kind=pa.array(["unseen"] * len(n)), chunk=pa.array(np.full(len(n), given["chunk"])), context=pa.array(uniq[0]), doc=pa.array(uniq[1]), n=pa.array(n.astype(np.int64))))
        return pa.concat_tables(out)

    return run


def lower_mass(tokens: int, once: int) -> float:
    """The probability of an unknown word, one order below."""
    return min(0.5, max(once, 0.5) / tokens) if tokens else 1.0


def discounts(counts: dict[int, int]) -> list[float]:
    """d(1) to d(K) from the counts of counts 1 to K + 1."""
    n = [counts.get(r, 0) for r in range(K + 2)]
    out = []
    for r in range(1, K + 1):
        d = (r - 0.5) / r
        if n[1] and n[r] and n[r + 1]:
            a, star = (K + 1) * n[K + 1] / n[1], (r + 1) * n[r + 1] / n[r]
            if a < 1 and 0 < (found := (star / r - a) / (1 - a)) < 1:
                d = found
        out.append(d)
    return out


def _doc_rows(group: pa.Table) -> pa.Table:
    """A row per document of a chunk, from what all buckets said."""
    rows = group.to_pylist()
    own = next(r for r in rows if r["kind"] == "docs")
    held, sizes, known, base = _split_blobs(own["body"], own["sizes"])
    value, low = np.zeros(len(sizes)), np.zeros((len(sizes), K), np.int64)
    for r in rows:
        if r["kind"] == "sums":
            docs, sums, *lows = _split_blobs(r["body"], r["sizes"])
            value[docs] += sums
            low[docs] += np.stack(lows, axis=1)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * K), pa.array(low.ravel()))
    return pa.table({"chunk": pa.array(np.full(len(sizes), own["chunk"])), "doc": pa.array(np.arange(len(sizes))), "doc_id": pa.array(own["docs"], pa.int64()), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base), "value": pa.array(value), "low": flat})


DOCS = "chunk long, doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, value double, low array<bigint>"


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of each row."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # 1: unigrams
    word_lists = texts.mapInArrow(_word_lists(4 * parts), "bucket long, chunk long, hashes binary, counts binary")
    lexicon = written(word_lists.groupBy("bucket").applyInArrow(_sum_bucket(4 * parts), LEXICON), "katz-unigrams")
    sums = lexicon.where("kind = 'table'").agg(F.sum("tokens"), F.sum("types"), F.sum("once")).first()
    tokens, types, once = (int(x or 0) for x in sums)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7))
    training_docs = texts.where(fold != 2).count()
    # 2 and 3: bigrams
    buckets = max(2 * parts, -(-tokens // BUCKET_TOKENS))
    chunks = texts.mapInArrow(_token_rows, TOKENS)
    words = lexicon.where("kind = 'chunk'").select("chunk", "bucket", "ids", "counts")
    pairs = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_pairs(buckets, tokens, types, training_docs), PAIRS)
    path = scratch(spark, "katz-bigrams")
    pairs.groupBy("bucket").applyInArrow(_score_bucket(tokens, once), RESULTS).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(RESULTS).option("basePath", path).parquet(path)
    # 4: discounts and backoff weights
    counted = found.where("kind = 'counts'").groupBy("context").agg(F.sum("n").alias("n")).collect()  # K + 1 numbers
    d = discounts({r["context"]: r["n"] for r in counted})
    total = lambda of: F.aggregate(F.transform("low", lambda x, i: x * F.element_at(F.array(*(F.lit(float(v)) for v in of)), i + 1)), F.lit(0.0), lambda a, x: a + x)
    contexts = found.where("kind = 'contexts'").select("context", "lower", (F.col("mass") + total([v * (k + 1) for k, v in enumerate(d)]) / F.col("n")).alias("seen"))
    alphas = contexts.groupBy("context").agg(F.log10((1 - F.sum("seen")) / (1 - F.sum("lower"))).alias("alpha"))
    backed = found.where("kind = 'unseen'").select("context", "chunk", "doc", "n").join(alphas, "context").groupBy("chunk", "doc").agg(F.sum(F.col("n") * F.col("alpha")).alias("backed"))
    rows = found.where("kind IN ('docs', 'sums')").select("kind", "chunk", "docs", "body", "sizes").groupBy("chunk").applyInArrow(_doc_rows, DOCS)
    score = F.col("value") + total([float(np.log10(v)) for v in d]) + F.coalesce("backed", F.lit(0.0))
    return rows.join(backed, ["chunk", "doc"], "left").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", score.alias("score"))
