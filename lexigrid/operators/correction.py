"""Definitions that use their own word, mended in one of three ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.functions import text

#: Lengths above which the parts that are left will do, a definition can stand for a word, and what is left of patterns is kept.
GOOD_REST, GOOD_SUBSTITUTE, GOOD_REPAIR = 10, 20, 5
_BEFORE, _AFTER = r"(?iu)(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def substitutes(known: DataFrame) -> DataFrame:
    """word, instead: for each term the least of its definitions that don't use it and are long enough."""
    fit = known.where((F.length("definition") > GOOD_SUBSTITUTE) & (F.size(text.circular(F.col("term"), F.col("definition"))) == 0))
    return fit.groupBy(F.lower("term").alias("word")).agg(F.min(F.trim("definition")).alias("instead"))


def _substituted(definition: Column, pairs: Column) -> Column:
    """Whole words replaced, one after the other; signs that mean something in a replacement are quoted."""
    quoted = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    return F.aggregate(F.array_sort(pairs), definition, lambda d, p: F.regexp_replace(d, F.concat(F.lit(_BEFORE), p["word"], F.lit(_AFTER)), quoted(p["instead"])))


def smart_corrections(entries: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """id, corrected and how: `none`, `parts`, `substituted`, `patterns` or `unchanged`.

    entries: id, term, definition; known: term, definition. Parts between ; and , that don't use the word are kept if they
    are long enough together; else the words are replaced by definitions of their own, if there are any; else parts that are left, however short;
    else phrases are removed by patterns. Null terms and definitions stay as they are.
    """
    c, nothing = F.col, F.lit("")
    found = entries.select(c(id_col).alias("id"), "term", "definition", F.coalesce(text.circular(c("term"), c("definition")), F.array().cast("array<string>")).alias("uses"))
    parts = F.transform(F.split("definition", r"[;,]"), lambda p: F.trim(p))
    rest = F.array_join(F.filter(parts, lambda p: (p != "") & (F.size(F.array_intersect("uses", text.words_in(p))) == 0)), "; ")
    asked = found.select("id", F.explode("uses").alias("word")).join(substitutes(known), "word").groupBy("id").agg(F.collect_list(F.struct("word", "instead")).alias("pairs"))
    met = found.join(asked, "id", "left").withColumn("rest", F.coalesce(rest, nothing)).withColumn("repaired", text.repaired(c("term"), c("definition")))
    how = (
        F.when(F.size("uses") == 0, "none")
        .when(F.length("rest") > GOOD_REST, "parts")
        .when(c("pairs").isNotNull(), "substituted")
        .when(c("rest") != "", "parts")
        .when(F.length("repaired") > GOOD_REPAIR, "patterns")
        .otherwise("unchanged")
    )
    capital = F.concat(F.upper(F.substring("rest", 1, 1)), F.substring("rest", F.lit(2), F.length("rest")))
    said = met.withColumn("how", how)
    out = F.when(c("how") == "parts", capital).when(c("how") == "substituted", _substituted(c("definition"), c("pairs"))).when(c("how") == "patterns", c("repaired")).otherwise(c("definition"))
    return said.select("id", out.alias("corrected"), "how")
