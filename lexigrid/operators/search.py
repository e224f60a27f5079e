"""Searching, filtering, ranking and paging of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators.ranks import with_rank


def conditions(*, prefix: str | None = None, text: str | None = None, equals: dict[str, str] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, term: str = "term", definition: str | None = None) -> Column:
    """All given filters together. A text of one character is a prefix, a longer one a part of term or definition."""
    found: list[Column] = [F.lit(True)]
    if text and len(text) == 1:
        prefix, text = text, None
    if prefix:
        found.append(F.lower(term).startswith(prefix.lower()))
    if text:
        hit = F.contains(F.lower(term), F.lit(text.lower()))
        found.append(hit | F.contains(F.lower(definition), F.lit(text.lower())) if definition else hit)
    found += [F.col(c) == v for c, v in (equals or {}).items()]
    for c, (low, high) in (ranges or {}).items():
        found += [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
    return reduce(lambda a, b: a & b, found)


def ranked_search(terms: DataFrame, rank_by: str, where: Column) -> DataFrame:
    """Ranks among all terms, then the filter: a term's rank doesn't depend on what is searched."""
    return with_rank(terms, rank_by, "rank").where(where)


def filtered_ranks(terms: DataFrame, rank_by: str, where: Column) -> DataFrame:
    """The filter, then ranks among what is left."""
    return with_rank(terms.where(where), rank_by, "rank")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page in a total order: each task keeps its first rows only."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def next_letters(terms: DataFrame, prefix: str) -> DataFrame:
    """Beginnings one letter longer than the prefix that some term has."""
    n = len(prefix)
    low = F.lower("term")
    return terms.where(low.startswith(prefix.lower()) & (F.length("term") > n)).select(F.substring(low, 1, n + 1).alias("prefix")).distinct()


def letter_counts(terms: DataFrame) -> DataFrame:
    """Terms by first letter, in upper case where that is one letter."""
    first = F.substring("term", 1, 1)
    return terms.groupBy(F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first).alias("letter")).agg(F.countDistinct("term").alias("n"))


def seeded_order(df: DataFrame, id_col: str, seed: int) -> Column:
    """A shuffle that any engine repeats."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
