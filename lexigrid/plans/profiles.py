"""Profiles of tables: lengths, groups with quantile counts, empty fields, bands in order, what is still to be looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.operators.rarity import ladder
from lexigrid.sources.tables import NOT_FOUND, lexicon, table, written


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    """Least, greatest and mean length of documents' texts by language, and how many are shorter than 20 characters."""
    size = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"), F.count_if(size < 20).alias("short"))


def group_profile(spark: SparkSession, d: str) -> DataFrame:
    """Totals of orders by priority and status: mean, median, deviation, range, and how many lie in the lowest and highest tenth of their group."""
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    keys = ["o_orderpriority", "o_orderstatus"]
    cuts = orders.groupBy(*keys).agg(F.percentile("o_totalprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))  # a row per group
    v = F.col("o_totalprice")
    out = orders.join(F.broadcast(cuts), keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.max(F.col("q")[1]).alias("median"), F.stddev_samp(v).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v <= F.col("q")[0]).alias("lowest"), F.count_if(v >= F.col("q")[2]).alias("highest")
    )
    return out.select(*keys, "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "deviation")), "least", "most", "lowest", "highest")


def blank_fields(spark: SparkSession, d: str) -> DataFrame:
    """Conversations without text, once what isn't a letter is blanked in every third turn: null, empty or white space only."""
    text = F.when(F.pmod("turn", F.lit(3)) == 0, F.regexp_replace("text", "[^ ]", " ")).when(F.pmod("turn", F.lit(3)) == 1, F.nullif(F.col("role"), F.lit("user"))).otherwise(F.col("text"))
    said = table(spark, d, "conversations").select("role", text.alias("text"))
    return said.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("unknown"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.trim("text") != "").alias("filled"))


#: Bands of totals, and the last one.
PRICE_BANDS = ((50_000.0, "low"), (100_000.0, "middle"), (200_000.0, "high"), (300_000.0, "very high"))


def bands_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders by bands of their totals, the band with the greatest least total first."""
    band = ladder(F.col("o_totalprice"), PRICE_BANDS, "top")
    found = table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"))
    return found.orderBy(F.col("least").desc()).limit(len(PRICE_BANDS))


def to_look_up(spark: SparkSession, d: str) -> DataFrame:
    """Terms with work left in the third corpus: unchecked ones, and, if forced, those that weren't found."""
    terms = written(lexicon(table(spark, d, "documents")), "lexicon")
    todo = lambda forced: terms.where(F.col("freq_c").isNull() | (F.lit(forced) & (F.col("freq_c") == NOT_FOUND))).select("term", F.lit(forced).alias("forced"))
    return todo(False).union(todo(True)).groupBy("forced").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max(F.length("term")).alias("longest"))


QUERIES = {f.__name__: f for f in (length_profile, group_profile, blank_fields, bands_in_order, to_look_up)}

_BANDS = " ".join(f"WHEN o_totalprice < {b} THEN '{n}'" for b, n in PRICE_BANDS)
_TERMS = r"SELECT term, count(*) FILTER (c = 2) AS n FROM (SELECT CAST(regexp_extract(source, '(\d+)', 1) AS INT) % 3 AS c, regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS term FROM documents) WHERE length(term) > 1 GROUP BY 1"

ORACLES = {
    "length_profile": "SELECT lang, count(*) AS n, CAST(min(length(text)) AS INT) AS least, CAST(max(length(text)) AS INT) AS most, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) < 20) AS short FROM documents GROUP BY 1",
    "group_profile": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(any_value(q[2]), 4) AS median, round(stddev_samp(o_totalprice), 4) AS deviation, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) FILTER (o_totalprice <= q[1]) AS lowest, count(*) FILTER (o_totalprice >= q[3]) AS highest FROM orders JOIN (SELECT o_orderpriority AS p, o_orderstatus AS s, quantile_cont(o_totalprice, [0.1, 0.5, 0.9]) AS q FROM orders GROUP BY 1, 2) ON p = o_orderpriority AND s = o_orderstatus GROUP BY 1, 2",
    "blank_fields": "SELECT role, count(*) AS n, count(*) FILTER (x IS NULL) AS unknown, count(*) FILTER (trim(x, ' ') = '') AS blank, count(*) FILTER (trim(x, ' ') <> '') AS filled FROM (SELECT role, CASE turn % 3 WHEN 0 THEN regexp_replace(text, '[^ ]', ' ', 'g') WHEN 1 THEN nullif(role, 'user') ELSE text END AS x FROM conversations) GROUP BY 1",
    "bands_in_order": f"SELECT CASE {_BANDS} ELSE 'top' END AS band, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1 ORDER BY least DESC LIMIT {len(PRICE_BANDS)}",
    "to_look_up": f"SELECT forced, count(*) AS n, min(term) AS first, CAST(max(length(term)) AS INT) AS longest FROM (SELECT term, false AS forced FROM ({_TERMS}) WHERE length(term) > 14 UNION ALL SELECT term, true FROM ({_TERMS}) WHERE length(term) > 14 OR n = 0) GROUP BY 1",
}
