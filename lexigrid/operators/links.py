"""Linking texts to a dictionary: the longest match at each word, from left to right."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexigrid.functions.text import words_in

#: Terms in one automaton.
TERMS = 500_000


def term_keys(terms: DataFrame, id_col: str, term_col: str, least: int = 3) -> DataFrame:
    """key (the term's words), first, size, id: one row per word sequence, with the least id; some word has `least` letters."""
    words = terms.select(F.col(id_col).alias("id"), words_in(F.col(term_col)).alias("words")).where((F.size("words") > 0) & F.exists("words", lambda w: F.length(w) >= least))
    return words.groupBy(F.array_join("words", " ").alias("key")).agg(F.min("id").alias("id")).select("key", F.split("key", " ")[0].alias("first"), F.size(F.split("key", " ")).alias("size"), "id")


def _scan(block):
    """(text_id, at, size, id): the longest term of the block at each place, by an automaton over words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        terms = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, id_ in block.value:
            words = tuple(numbers.setdefault(w, len(numbers) + 1) for w in key.split(" "))
            terms.add_word(words, (len(words), id_))
        terms.make_automaton()
        for batch in batches:
            ids, places, sizes, found = [], [], [], []
            for text_id, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                longest: dict[int, tuple[int, int]] = {}
                for end, hit in terms.iter(tuple(numbers.get(w, 0) for w in words)) if words else ():
                    at = end + 1 - hit[0]
                    if at not in longest or hit > longest[at]:
                        longest[at] = hit
                ids += [text_id] * len(longest)
                places += longest
                sizes += [size for size, _ in longest.values()]
                found += [id_ for _, id_ in longest.values()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.int64())], ["text_id", "at", "size", "id"])

    return scan


def matches(texts: DataFrame, keys: DataFrame, id_col: str, text_col: str, *, at_once: int = TERMS) -> DataFrame:
    """text_id, at, size, id of all matches, longest per place: terms in an automaton with failure links, texts in one pass.

    Terms are broadcast at_once at a time, dealt by a hash, so that one common first word doesn't matter; with more than
    one block of them the texts are read again for each. Null texts have no words.
    """
    sc = texts.sparkSession.sparkContext
    words = texts.select(F.col(id_col).alias("text_id"), words_in(F.coalesce(text_col, F.lit(""))).alias("words"))
    blocks = max(1, -(-keys.count() // at_once))
    schema = StructType([words.schema["text_id"], StructField("at", IntegerType()), StructField("size", IntegerType()), StructField("id", LongType())])
    parts = []
    for k in range(blocks):
        block = keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).select("key", F.col("id").cast("long")).collect()
        parts.append(words.mapInArrow(_scan(sc.broadcast([tuple(r) for r in block])), schema))
    if blocks == 1:
        return parts[0]
    best = reduce(DataFrame.union, parts).groupBy("text_id", "at").agg(F.max(F.struct("size", "id")).alias("m"))
    return best.select("text_id", "at", "m.size", "m.id")


def greedy_links(found: DataFrame, most: int = 25) -> DataFrame:
    """text_id, at, size, id: matches that don't overlap one taken before, `most` per text at most."""
    ordered = found.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("at", "size", "id"))).alias("m"))
    begin = F.struct(F.lit(0).alias("free"), F.expr("CAST(array() AS array<struct<at:int,size:int,id:bigint>>)").alias("out"))

    def step(s, m):
        fits = (m["at"] >= s["free"]) & (F.size(s["out"]) < most)
        taken = F.struct(m["at"].cast("int").alias("at"), m["size"].cast("int").alias("size"), m["id"].cast("bigint").alias("id"))
        return F.struct(F.when(fits, m["at"] + m["size"]).otherwise(s["free"]).alias("free"), F.when(fits, F.array_append(s["out"], taken)).otherwise(s["out"]).alias("out"))

    return ordered.select("text_id", F.explode(F.aggregate("m", begin, step)["out"]).alias("l")).select("text_id", "l.*")


def group_alike(texts: DataFrame, key: str, place: str, text_col: str, above: float = 0.3) -> DataFrame:
    """key, place, group: each text of a key joins the first group with a text that it overlaps by more than `above`.

    The outcome depends on the order of texts, so it is a fold over those of a key, which are few.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[set]] = []
        out = []
        for _, row in pdf.sort_values(place).iterrows():
            words = set(row[text_col].lower().split())
            at = next((i for i, g in enumerate(groups) if any(len(words & o) > above * len(words | o) for o in g)), len(groups))
            if at == len(groups):
                groups.append([])
            groups[at].append(words)
            out.append((row[key], row[place], at))
        return pd.DataFrame(out, columns=[key, place, "group"])

    return texts.groupBy(key).applyInPandas(fold, f"{key} {dict(texts.dtypes)[key]}, {place} {dict(texts.dtypes)[place]}, group long")


def text_sections(lines: DataFrame, key: str, place: str, line: str) -> DataFrame:
    """key, term, definition: a short capitalised line of up to three words begins a section, the lines after it are its text."""
    is_term = F.col(line).rlike(r"^[A-Z][A-Za-z' -]{1,40}\.?$") & (F.size(F.split(F.trim(line), " +")) <= 3)
    w = Window.partitionBy(key).orderBy(place)
    marked = lines.where(F.trim(line) != "").withColumn("__t", is_term).withColumn("section", F.sum(F.col("__t").cast("int")).over(w))
    body = F.filter(F.sort_array(F.collect_list(F.struct(place, F.when(~F.col("__t"), F.trim(line)).alias("s")))), lambda x: x["s"].isNotNull())
    return marked.where("section > 0").groupBy(key, "section").agg(F.max(F.when(F.col("__t"), F.trim(line))).alias("term"), F.array_join(F.transform(body, lambda x: x["s"]), " ").alias("definition"))


