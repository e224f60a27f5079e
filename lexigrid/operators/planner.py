"""Which rows without a definition get which of those found, and which definitions become rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexigrid.sources.tables import written


def plan_fill(rows: DataFrame, found: DataFrame, filled: DataFrame) -> DataFrame:
    """action (update, insert, skip), id, term, pos, text and source.

    rows: id, term, pos of those that lack a definition; found: term, pos, text, source, reliability; filled: term, pos.
    A term has one definition for each part of speech, the most reliable. The first row of a term and part of speech gets
    that one. What is left goes to the term's rows without part of speech: the most reliable to the first row, and so on.
    What is still left becomes a row, unless one of its term and part of speech is filled. Rows that get none are skipped.

    Terms are compared in lower case. Ties: rows by id, definitions by source, then text, then part of speech. Definitions
    of terms without rows, or without part of speech, aren't used; null terms are skipped. Both sides are numbered and joined by
    number, so a term with very many rows meets as many definitions as there are parts of speech at most.
    """
    c = F.col
    asked = written(rows.select("id", F.lower("term").alias("term"), "pos"), "fill-rows")
    order = Window.partitionBy("term", "pos").orderBy(c("reliability").desc(), "source", "text")
    known = found.where("pos IS NOT NULL AND term IS NOT NULL").select(F.lower("term").alias("term"), "pos", "text", "source", "reliability")
    best = known.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    best = written(best.join(asked.select("term").where("term IS NOT NULL").distinct(), "term", "left_semi"), "fill-found")
    first = asked.where("pos IS NOT NULL").groupBy("term", "pos").agg(F.min("id").alias("id"))
    direct = written(first.join(best, ["term", "pos"]).select("id", "term", "pos", "text", "source"), "fill-direct")
    left = best.join(direct.select("term", "pos"), ["term", "pos"], "left_anti")
    numbered = left.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(c("reliability").desc(), "pos")))
    open_rows = asked.where("pos IS NULL AND term IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("id")))
    zipped = written(numbered.join(open_rows.select("term", "n", "id"), ["term", "n"], "left").select("id", "term", "pos", "text", "source"), "fill-zipped")
    held = filled.select(F.lower("term").alias("term"), "pos").distinct()
    updates = direct.union(zipped.where("id IS NOT NULL"))
    inserts = zipped.where("id IS NULL").join(held, ["term", "pos"], "left_anti").select("id", "term", "pos", "text", "source")
    skipped = asked.join(updates.select("id"), "id", "left_anti").select("id", "term", "pos", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    return updates.withColumn("action", F.lit("update")).union(inserts.withColumn("action", F.lit("insert"))).union(skipped.withColumn("action", F.lit("skip"))).select("action", "id", "term", "pos", "text", "source")
