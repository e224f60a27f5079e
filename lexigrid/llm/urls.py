"""URL filters by a character language-model ratio.

Ordered host and path rules decide what they fit; the longest wins. URLs that a rule decides also
train two models, one of allowed and one of blocked URLs: variable-order Markov models over bytes
whose estimates of each order are smoothed with those of the order below. A URL without a rule is
allowed if the difference of its two log-likelihoods per byte reaches a threshold, which is
calibrated on a held-out fold of the training URLs.

Defined cases. Null URL or one without `://`: empty host and path, no rule; the models judge what text
there is, and a URL without bytes scores 0. With no trained pair of models (no allowed or no blocked
URLs) everything without a rule is allowed. Repeated rows are judged alike. A ratio that equals the
threshold allows. Very long URLs are scored whole, in parts of a batch. An empty table gives no rows. Other
columns pass through if named in `keep`, whatever their names; host, path, rule, verdict and ratio replace
columns so called.

Scale: no shuffle of pages. The models are fitted on a sample of decided URLs, distinct and picked by hash,
of an expected TRAIN_URLS and TRAIN_BYTES at most; longer URLs than LONGEST_TRAINED are judged, but not learnt from. Counts of
its n-grams are summed by Spark; all of them are kept, and the sample's bytes bound how many there are. Judging runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexigrid.llm.common import boxed, written

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Bound of the training sample, in URLs.
TRAIN_URLS = 50_000
#: Bound of the sample in bytes, which bounds the n-grams of the models, and of a URL in it.
TRAIN_BYTES, LONGEST_TRAINED = 4_000_000, 8_192
ORDER = 5
#: Bytes of URLs that are scored at once.
PART_BYTES = 1 << 20
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


def _grams(text: bytes, k: int) -> np.ndarray:
    """For each byte, its last k predecessors and itself as a number; a URL begins with k zeros."""
    b = np.frombuffer(b"\0" * k + text + b"\n", np.uint8).astype(np.uint64)
    n = len(text) + 1
    out = np.zeros(n, np.uint64)
    for j in range(k + 1):
        out = (out << np.uint64(8)) | b[j : j + n]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, order, gram, n) of each batch's URLs."""
    for batch in batches:
        sums: dict[int, list[np.ndarray]] = {}
        for url, allowed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k in range(ORDER + 1):
                sums.setdefault(2 * k + allowed, []).append(_grams((url or "").encode("utf-8", "surrogatepass"), k))
        for key, found in sums.items():
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), key % 2, np.int32)), pa.array(np.full(len(grams), key // 2, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["allowed", "k", "gram", "n"])


def fit(decided: DataFrame) -> list[list[tuple[np.ndarray, ...]]] | None:
    """For each class and order: sorted grams with counts, sorted contexts with totals and numbers of followers."""
    counts = decided.mapInArrow(_count, "allowed int, k int, gram long, n long").groupBy("allowed", "k", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "url-grams")
    found = counts.toPandas()  # at most as many as the sample has bytes, for each order
    if found["allowed"].nunique() < 2:
        return None
    models = []
    for allowed in (0, 1):
        orders = []
        for k in range(ORDER + 1):
            part = found[(found["allowed"] == allowed) & (found["k"] == k)]
            grams, n = part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy().astype(np.float64)
            at = np.argsort(grams)
            grams, n = grams[at], n[at]
            if not len(grams):
                continue
            contexts, first, kinds = np.unique(grams >> np.uint64(8), return_index=True, return_counts=True)
            orders.append((grams, n, contexts, np.add.reduceat(n, first), kinds.astype(np.float64)))
        models.append(orders)
    return models


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def _probabilities(orders: list[tuple[np.ndarray, ...]], grams: list[np.ndarray]) -> np.ndarray:
    """Witten-Bell: each order's counts share with the order below as many as it has kinds of followers."""
    p = np.full(len(grams[0]), 1 / 256)
    for (keys, n, contexts, totals, kinds), asked in zip(orders, grams, strict=False):
        before = asked >> np.uint64(8)
        c, total, share = _find(keys, n, asked), _find(contexts, totals, before), _find(contexts, kinds, before)
        p = np.where(total > 0, (c + share * p) / np.maximum(total + share, 1), p)
    return p


def log_likelihoods(orders: list[tuple[np.ndarray, ...]], texts: list[bytes]) -> np.ndarray:
    """Of each text and its end; all texts' bytes are looked up at once, by order."""
    if not texts:
        return np.zeros(0)
    grams = [np.concatenate([_grams(t, k) for t in texts]) for k in range(ORDER + 1)]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.add.reduceat(np.log(_probabilities(orders, grams)), starts)


def next_probabilities(orders: list[tuple[np.ndarray, ...]], text: bytes) -> np.ndarray:
    """Of each byte after a text; the end is a line feed."""
    byte = np.arange(256, dtype=np.uint64)
    return _probabilities(orders, [_grams(text, k)[-1] >> np.uint64(8) << np.uint64(8) | byte for k in range(ORDER + 1)])


def ratios(models: list, urls: list[str]) -> np.ndarray:
    """Log-likelihood of allowed less that of blocked, per byte; in parts of some PART_BYTES."""
    texts, out, begin, size = [u.encode("utf-8", "surrogatepass") for u in urls], [], 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= PART_BYTES or i == len(texts):
            part = texts[begin:i]
            sizes = np.array([len(x) for x in part])
            found = (log_likelihoods(models[1], part) - log_likelihoods(models[0], part)) / np.maximum(sizes, 1)
            out.append(np.where(sizes > 0, found, 0.0))
            begin, size = i, 0
    return np.concatenate(out) if out else np.zeros(0)


def _score(models):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("__ask")).to_pylist()
            distinct = list({a for a in asked if a is not None})
            known = dict(zip(distinct, ratios(models.value, distinct).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known.get(a) for a in asked], pa.float64())], [*batch.schema.names, "__ratio"])

    return score


def calibrate(scored: list[tuple[float, bool]]) -> float:
    """The threshold with the best mean of both classes' shares judged right; ties: the lowest in size."""
    if not scored:
        return 0.0
    good, bad = np.sort([s for s, y in scored if y]), np.sort([s for s, y in scored if not y])
    cuts = np.unique([0.0, *(s for s, _ in scored)])
    right = (1 - np.searchsorted(good, cuts) / max(len(good), 1)) + np.searchsorted(bad, cuts) / max(len(bad), 1)
    best = cuts[right == right.max()]
    return float(best[np.argmin(np.abs(best))])


def filter_urls(pages: DataFrame, *, url_col: str = "url", keep: list[str] | None = None, rules=RULES, train_urls: int = TRAIN_URLS, train_bytes: int = TRAIN_BYTES, seed: int = 42) -> DataFrame:
    """The columns in `keep` (all by default) with host, path, rule, verdict, ratio (of URLs without a rule)."""
    spark = pages.sparkSession
    keep = pages.columns if keep is None else keep
    own = ("host", "path", "rule", "verdict", "ratio")
    passed = [c for c in keep if c not in own]
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(boxed(pages, passed), url.alias("__url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__ruled": verdict})
    decided = rows.where("__ruled IS NOT NULL").select("__url", (F.col("__ruled") == "allow").cast("int").alias("allowed")).distinct()
    decided = decided.where(F.octet_length("__url") <= LONGEST_TRAINED)
    n, size = decided.agg(F.count("*"), F.sum(F.octet_length("__url"))).first()
    share = int((1 << 52) * min(1.0, train_urls / max(n, 1), train_bytes / max(size or 0, 1)))
    picked = decided.where(F.pmod(F.xxhash64(F.lit(seed), "__url"), F.lit(1 << 52)) < share)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "__url"), F.lit(5))
    models = fit(picked.where(fold != 0))
    if models is None:
        done = rows.withColumns({"verdict": F.coalesce("__ruled", F.lit("allow")), "ratio": F.lit(None).cast("double")})
        return done.select("__in.*", *own)
    shared = spark.sparkContext.broadcast(models)

    def scored(df: DataFrame, ask: Column) -> DataFrame:
        asked = df.withColumn("__ask", ask)
        schema = StructType([*asked.schema.fields, StructField("__ratio", DoubleType())])
        return asked.mapInArrow(_score(shared), schema).drop("__ask")

    held = scored(picked.where(fold == 0), F.col("__url")).select("__ratio", "allowed").toPandas()  # bounded as the sample is
    threshold = calibrate(list(zip(held["__ratio"], held["allowed"] == 1, strict=True)))
    judged = scored(rows, F.when(F.col("__ruled").isNull(), F.coalesce("__url", F.lit(""))))
    said = F.coalesce("__ruled", F.when(F.col("__ratio") >= threshold, "allow").otherwise("block"))
    return judged.withColumns({"verdict": said, "ratio": F.col("__ratio")}).select("__in.*", *own)
