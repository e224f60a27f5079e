"""Putting texts into domains by keyword rules, and fusing rule scores with others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrid.functions.scores import rule_score

GENERAL = "General / Cross-Domain"


def rules_table(spark: SparkSession, rules: list[tuple[str, float, list[str], list[str]]]) -> DataFrame:
    """place, domain, base weight, keywords, negatives: a row per domain, a fixed list."""
    return spark.createDataFrame([(i, d, w, k, n) for i, (d, w, k, n) in enumerate(rules)], "place int, domain string, weight double, keywords array<string>, negatives array<string>")


def _hits(words: str):
    return F.size(F.filter(words, lambda k: F.contains(F.col("__text"), k)))


def domain_votes(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """id and domain with the most keywords in the text; ties: the first domain; none: the general one."""
    low = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("__text"))
    votes = low.crossJoin(F.broadcast(rules)).select("id", "place", "domain", _hits("keywords").alias("votes"))  # a fixed list of domains
    best = votes.groupBy("id").agg(F.max(F.struct("votes", -F.col("place"), "domain")).alias("best"))
    return best.select("id", F.when(F.col("best.votes") > 0, F.col("best.domain")).otherwise(GENERAL).alias("domain"))


def rule_scores(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """id, domain, raw, score: keywords weigh the domain's weight, negatives half of it, off."""
    clean = F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}\s\-]", " ")
    low = texts.select(F.col(id_col).alias("id"), clean.alias("__text"))
    raw = F.greatest(F.col("weight") * _hits("keywords") - F.col("weight") / 2 * _hits("negatives"), F.lit(0.0))
    return low.crossJoin(F.broadcast(rules)).select("id", "place", "domain", raw.alias("raw")).withColumn("score", rule_score(F.col("raw")))


def fuse(scores: DataFrame, alpha: float = 0.6, low: float = 0.45, margin: float = 0.03) -> DataFrame:
    """id, domain, fused, borderline, from (id, place, domain, score, other).

    The other score is brought to 0..1 within its id (all equal: one half) and mixed in by 1 - alpha. The
    best domain wins, ties: the first; below `low` it is the general one; borderline within `margin` of the next.
    """
    w = Window.partitionBy("id")
    lo, hi = F.min("other").over(w), F.max("other").over(w)
    scaled = F.when(hi > lo, (F.col("other") - lo) / (hi - lo)).otherwise(0.5)
    fused = scores.withColumn("fused", alpha * F.col("score") + (1 - alpha) * scaled)
    order = Window.partitionBy("id").orderBy(F.col("fused").desc(), F.col("place"))
    placed = fused.withColumns({"n": F.row_number().over(order), "next": F.lead("fused").over(order)}).where("n = 1")
    return placed.select("id", F.when(F.col("fused") < low, GENERAL).otherwise(F.col("domain")).alias("domain"), "fused", F.coalesce(F.col("fused") - F.col("next") < margin, F.lit(False)).alias("borderline"))


def cluster_domains(members: DataFrame, secondary: float = 0.3) -> DataFrame:
    """cluster, primary, secondary, from (cluster, domain): the commonest, and up to two with 30 % of its count."""
    counts = members.groupBy("cluster", "domain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.col("n").desc(), F.col("domain"))
    placed = counts.withColumns({"place": F.row_number().over(w), "top": F.max("n").over(Window.partitionBy("cluster"))})
    others = F.array_compact(F.array(*(F.max(F.when((F.col("place") == k) & (F.col("n") >= secondary * F.col("top")), F.col("domain"))) for k in (2, 3))))
    return placed.groupBy("cluster").agg(F.max(F.when(F.col("place") == 1, F.col("domain"))).alias("primary"), F.array_join(others, ",").alias("secondary"), F.sum("n").alias("size"))


def keyword_counts(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """id, place, domain, score: how many of each domain's keywords the text holds; domains without any are left out."""
    low = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("__text"))
    return low.crossJoin(F.broadcast(rules)).select("id", "place", "domain", _hits("keywords").cast("double").alias("score")).where("score > 0")  # a fixed list of domains


def word_overrides(items: DataFrame, scores: DataFrame, clusters: DataFrame, strong: float = 2.0, least: float = 1.0) -> DataFrame:
    """id, primary and domains: the cluster's domain, unless the item's own score speaks strongly for another one.

    items: id, cluster; scores: id, place, domain, score; clusters as `cluster_domains` gives them. Domains are the primary
    one, unless it is General, then those with the least score in the order of rules, then the cluster's secondary ones.
    Items of no known cluster are General; ties between scores go to the first domain.
    """
    best = scores.groupBy("id").agg(
        F.max(F.struct("score", -F.col("place"), "domain")).alias("best"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("score") >= least, F.struct("place", "domain")))), lambda x: x["domain"]).alias("own"),
    )
    met = items.join(clusters.select("cluster", "primary", F.filter(F.split("secondary", ","), lambda s: s != "").alias("others")), "cluster", "left").join(best, "id", "left")
    primary = F.when(F.col("best.score") >= strong, F.col("best.domain")).otherwise(F.coalesce("primary", F.lit("General")))
    none = F.array().cast("array<string>")
    said = met.withColumn("primary", primary)
    every = F.array_distinct(F.concat(F.when(F.col("primary") != "General", F.array("primary")).otherwise(none), F.coalesce("own", none), F.coalesce("others", none)))
    return said.select("id", "primary", F.array_join(every, ",").alias("domains"))
