"""Mixing sources to target weights, native: all in DataFrame operations.

Tokens are summed per source, targets follow from the weights, and each document is emitted
floor(rate) times, plus once more if a hash of it falls below the rate's fraction.

Defined cases. Null source: a source of its own, after all others. Null or empty text: size 0; it
takes nothing whatever its copies. Repeated rows share their coin, and so are all emitted equally
often. An empty table gives an empty mix. Very long texts are counted in place. Other columns pass
through, whatever their names; size, source_size, target and copies replace columns so called.

Scale: two scans, each with a map-side aggregation or none, and a join of the documents with one row
per source: broadcast if the sources are counted as MAX_BROADCAST or fewer, else left to Spark's
skew join. Documents aren't shuffled. The targets order the sources in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexigrid.llm.common import boxed, n_words, unit_hash, written

MAX_BROADCAST = 100_000


def source_targets(sized: DataFrame, *, source_col: str, size_col: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target for each source.

    The sources in order of code points take the weights in turn and share `share` of all sizes. No
    target is above `most` times its source's size: those that would be are set there, in order of
    cap to weight, and the rest go on sharing by weight. The k-th prefix of that order is the
    set of capped sources if the level after k lies below the next source's ratio.
    """
    sums = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("long").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sums.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (share * F.col("all_size") - most * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # the level of the first source that it doesn't cap holds for all after it
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size", "weight", F.least(most * F.col("source_size"), F.col("final") * F.col("weight")).alias("target")
    )


def mix_to_targets(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 42, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all by default) with size, source_size, target and copies of each document."""
    keep = docs.columns if keep is None else keep
    own = ("size", "source_size", "target", "copies")
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = docs.select(boxed(docs, [c for c in keep if c not in own]), source.alias("source"), n_words(text).alias("n"), unit_hash(F.lit(seed), F.col(f"`{id_col}`"), F.md5(F.coalesce(text, F.lit("")))).alias("coin"))
    targets = written(source_targets(sized, source_col="source", size_col="n", weights=weights, share=share, most=most), "mix-targets").drop("weight")
    if targets.count() <= MAX_BROADCAST:
        targets = F.broadcast(targets)
    met = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    copies = F.least(F.floor(rate) + F.when(F.col("coin") < rate - F.floor(rate), 1).otherwise(0), F.lit(int(most)))
    return met.select("__in.*", F.col("n").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("size", "source_size", "target", "copies")
