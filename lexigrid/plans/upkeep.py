"""Queries over tables that are kept: resumable blocks of pairs, ranks that follow changes, visits with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.operators import blocks, maintenance, planner, sessions
from lexigrid.sources import files
from lexigrid.sources.tables import scratch, table, tokens, written
from lexigrid.streaming import activity, refresh

THRESHOLD = 0.3
#: Blocks of vectors; a vector's block follows from its id.
BLOCKS = 6
GAP, DELAY = "6 hours", "1 day"
FILES = 4


def resumable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors: a run that stops after a round, and one that goes on from there."""
    items, folder = table(spark, d, "embeddings"), scratch(spark, "blocks")
    blocks.run_blocks(items, "vec_id", "embedding", THRESHOLD, folder, blocks=BLOCKS, at_once=8, rounds=1)
    return blocks.resumable_pairs(items, "vec_id", "embedding", THRESHOLD, folder, blocks=BLOCKS).withColumn("score", F.round("score", 6))


def pair_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The finished pairs of blocks after two stopped runs and a whole one, and how many pairs of vectors they have together."""
    items, folder = table(spark, d, "embeddings"), scratch(spark, "blocks")
    for rounds in (1, 1, None):
        blocks.run_blocks(items, "vec_id", "embedding", THRESHOLD, folder, blocks=BLOCKS, at_once=8, rounds=rounds)
    return blocks.manifest(spark, folder).agg(F.count("*").alias("finished"), F.count_distinct("i", "j").alias("different"), F.sum("pairs").alias("pairs"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Words, how often they are in half of the documents (null: not at all), and in all."""
    half = F.count_if(F.col("doc_id") % 2 == 0)
    return written(tokens(table(spark, d, "documents"), "doc_id").groupBy(F.col("word").alias("key")).agg(F.nullif(half, F.lit(0)).alias("half"), F.count("*").alias("whole")), "refresh-counts")


def _refreshed(spark: SparkSession, d: str) -> refresh.RankTable:
    """Ranks of the words of half of the documents, brought up to date by a stream of the counts of all."""
    counts, folder, changes = _counts(spark, d), scratch(spark, "ranks"), scratch(spark, "rank-changes")
    ranks = refresh.RankTable(spark, folder)
    ranks.create(counts.select("key", F.col("half").alias("value"), F.lit(0).alias("version")))
    moved = counts.where("NOT (half <=> whole)").select("key", F.col("whole").cast("double").alias("value"), F.lit(1).cast("long").alias("version"))
    moved.repartition(FILES, "key").write.parquet(changes)
    stream = spark.readStream.schema("key string, value double, version long").option("maxFilesPerTrigger", 1).parquet(changes)
    refresh.keep_ranked(stream, ranks, scratch(spark, "rank-checkpoint"))
    return ranks


def rarity_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Each word's count, rank and rarity once the stream has ended."""
    return _refreshed(spark, d).ranks().select(F.col("key").alias("term"), F.col("value").cast("long").alias("n"), "rank", F.round(1 - F.col("percent_rank"), 9).alias("rarity"))


def rarity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Words that half of the documents lack, with the rarity that the refreshed ranks give them, copied back to the table."""
    known = _counts(spark, d).select(F.col("key").alias("term"), F.col("half").cast("double").alias("rarity"))
    missing = known.where("rarity IS NULL")
    given = _refreshed(spark, d).ranks().select(F.col("key").alias("term"), F.round(1 - F.col("percent_rank"), 9).alias("rarity"))
    return maintenance.update_from(missing, given, "term", "rarity", only_missing=True)


def visits(spark: SparkSession, d: str) -> DataFrame:
    """A user's events without a gap of more than six hours."""
    return sessions.visits(table(spark, d, "events"), ["user_id"], GAP)


def _in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events by weeks, one in fifty of which comes with the last week."""
    week = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    return table(spark, d, "events").withColumn("batch", F.when(F.col("event_id") % 50 == 0, 3).otherwise(week))


def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits by a stream with a watermark, to its end: those that it has closed, without the events that came too late."""
    path, out, events = scratch(spark, "stream-in"), scratch(spark, "stream-out"), _in_batches(spark, d)
    for b in range(4):
        events.where(F.col("batch") == b).drop("batch").repartition(FILES).write.mode("append").parquet(path)
    stream = activity.sessions(activity.event_stream(spark, path, FILES), GAP, DELAY)
    checkpoint = scratch(spark, "stream-checkpoint")
    activity.run_to_end(stream, out, checkpoint)
    return activity.whole_sessions(spark.read.schema("user_id long, began timestamp, ended timestamp, n long").parquet(out), checkpoint)


def timely_visits(spark: SparkSession, d: str) -> DataFrame:
    """The same by a batch over the events that aren't late."""
    taken = written(sessions.on_time(_in_batches(spark, d), "batch", GAP, DELAY), "on-time")
    closed = taken.agg(F.max("closed").alias("closed"))  # one row
    return sessions.visits(taken, ["user_id"], GAP).join(F.broadcast(closed), F.col("ended") <= F.col("closed")).drop("closed")


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """How many events of each batch come too late."""
    every = _in_batches(spark, d)
    taken = sessions.on_time(every, "batch", GAP, DELAY).groupBy("batch").agg(F.count("*").alias("taken"))
    return every.groupBy("batch").agg(F.count("*").alias("n")).join(taken, "batch", "left").select("batch", "n", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("late"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents by year of use, written as an index."""
    path = scratch(spark, "ngram-index")
    counted = tokens(table(spark, d, "documents"), "doc_id").groupBy("word", (F.col("doc_id") % 5 + 2000).cast("long").alias("year"))
    files.write_ngrams(counted.agg(F.count("*").alias("matches"), F.count_distinct("doc_id").alias("volumes")), path)
    return files.read_index(spark, path)


def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Uses by year of the benchmark's words, by filters on folders and row groups."""
    return files.indexed_lookup(_index(spark, d), tokens(table(spark, d, "benchmark"), "item_id"))


def index_join(spark: SparkSession, d: str) -> DataFrame:
    """Uses by year of the words of assistants, by a join that prunes folders."""
    said = tokens(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id")
    return files.indexed_lookup(_index(spark, d), said, listed=0).groupBy("word").agg(F.count("*").alias("years"), F.sum("matches").alias("matches"))


POS = ("noun", "verb", "adjective", "adverb")


def fill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Assistants' last words as rows to fill, the documents' words by source as definitions, the benchmark's words as filled nouns."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    term = F.lower(F.regexp_extract("text", r"(\p{L}{2,})[^\p{L}]*$", 1))
    kind = F.get(F.array(*(F.lit(p) for p in (None, "noun", "verb"))), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).cast("int"))
    rows = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), term.alias("term"), kind.alias("pos")).where("term <> ''")
    used = tokens(table(spark, d, "documents"), "source").groupBy(F.col("word").alias("term"), "source").agg(F.count("*").alias("reliability"))
    place = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(4))
    found = used.select("term", F.get(F.array(*map(F.lit, POS)), place).alias("pos"), F.concat_ws(" in ", "term", "source").alias("text"), "source", "reliability")
    filled = tokens(table(spark, d, "benchmark"), "item_id").select(F.col("word").alias("term"), F.lit("noun").alias("pos"))
    return planner.plan_fill(rows, found, filled)


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines and back; a role that isn't the user's is left out of its line."""
    path = scratch(spark, "json")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("role")).alias("role"), "text")
    files.write_json(said, path)
    return files.read_json(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers by tabs and back."""
    path = scratch(spark, "tsv")
    files.write_tsv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_tsv(spark, path, "c_custkey long, c_name string, c_acctbal double")


def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's words with their counts among the assistants' words, or the mark of what wasn't found."""
    scores = tokens(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id").groupBy("word").agg(F.count("*").cast("double").alias("score"))
    terms = tokens(table(spark, d, "benchmark"), "item_id").select(F.col("word").alias("term")).distinct()
    return files.lookup(terms, scores)


def vector_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of words by their place in files of vectors: labels as words, so that most come more than once."""
    path = scratch(spark, "vectors")
    lines = F.concat_ws(" ", F.concat(F.lit("W"), F.pmod("vec_id", F.lit(97)).cast("string")), F.array_join(F.col("embedding").cast("array<string>"), " "))
    table(spark, d, "embeddings").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(lines.alias("value")).write.text(path)
    return files.read_vectors(spark, path, most=None)


QUERIES = {f.__name__: f for f in (resumable_pairs, pair_manifest, rarity_refresh, rarity_backfill, visits, stream_visits, timely_visits, late_events, index_lookup, index_join, fill_plan, json_round_trip, tsv_round_trip, term_lookup, vector_ranks)}

_PAIRS = f"SELECT a, b, round(s, 6) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE s >= {THRESHOLD}"
_WORDS = r"SELECT term, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS half FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS term FROM documents) WHERE length(term) > 1 GROUP BY 1"
_BATCHES = "SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, (day(ts) - 1) // 8) END AS batch FROM events"
_MARKS = f"SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL {DELAY} AS mark, max(m) OVER () - INTERVAL {DELAY} AS closed FROM (SELECT batch, max(ts) AS m FROM b GROUP BY 1)"
_TAKEN = f"WITH b AS ({_BATCHES}), marks AS ({_MARKS}), taken AS (SELECT b.*, closed FROM b JOIN marks USING (batch) WHERE mark IS NULL OR ts + INTERVAL {GAP} > mark)"


def _visits(rows: str) -> str:
    begins = f"SELECT user_id, ts, CAST(coalesce(ts > lag(ts) OVER w + INTERVAL {GAP}, true) AS INT) AS b FROM {rows} WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
    return f"SELECT user_id, min(ts) AS began, max(ts) + INTERVAL {GAP} AS ended, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM ({begins})) GROUP BY user_id, v"


_CLOSED = f"{_TAKEN} SELECT * FROM ({_visits('taken')}) WHERE ended <= (SELECT max(closed) FROM taken)"
_RANKED = f"SELECT term, n, half, rank() OVER (ORDER BY n) AS rank, round(1 - percent_rank() OVER (ORDER BY n), 9) AS rarity FROM ({_WORDS})"

_SPLIT = r"regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS word"
_YEARS = f"SELECT word, doc_id % 5 + 2000 AS year, count(*) AS matches FROM (SELECT doc_id, {_SPLIT} FROM documents) WHERE length(word) > 1 GROUP BY 1, 2"
_FILL = rf"""
WITH asked AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS id, lower(regexp_extract(text, '(\p{{L}}{{2,}})[^\p{{L}}]*$', 1)) AS term, [NULL, 'noun', 'verb'][(conv_id + turn) % 3 + 1] AS pos FROM conversations WHERE role = 'assistant') WHERE term <> ''),
used AS (SELECT word AS term, source, count(*) AS reliability FROM (SELECT source, {_SPLIT} FROM documents) WHERE length(word) > 1 GROUP BY 1, 2),
kinds AS (SELECT *, {list(POS)}[CAST(regexp_extract(source, '(\d+)', 1) AS INT) % 4 + 1] AS pos, concat(term, ' in ', source) AS text FROM used),
best AS (SELECT * FROM kinds WHERE term IN (SELECT term FROM asked) QUALIFY row_number() OVER (PARTITION BY term, pos ORDER BY reliability DESC, source, text) = 1),
direct AS (SELECT a.id, a.term, a.pos, text, source FROM (SELECT term, pos, min(id) AS id FROM asked WHERE pos IS NOT NULL GROUP BY 1, 2) a JOIN best b ON b.term = a.term AND b.pos = a.pos),
rest AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY reliability DESC, pos) AS n FROM best WHERE (term, pos) NOT IN (SELECT term, pos FROM direct)),
blank AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS n FROM asked WHERE pos IS NULL),
zipped AS (SELECT blank.id, rest.term, rest.pos, text, source FROM rest LEFT JOIN blank ON blank.term = rest.term AND blank.n = rest.n),
filled AS (SELECT DISTINCT word AS term FROM (SELECT {_SPLIT} FROM benchmark) WHERE length(word) > 1),
updates AS (SELECT * FROM direct UNION ALL SELECT * FROM zipped WHERE id IS NOT NULL)
SELECT 'update' AS action, * FROM updates UNION ALL SELECT 'insert', * FROM zipped WHERE id IS NULL AND NOT (pos = 'noun' AND term IN (SELECT term FROM filled))
UNION ALL SELECT 'skip', id, term, pos, NULL, NULL FROM asked WHERE id NOT IN (SELECT id FROM updates)
"""

ORACLES = {
    "index_lookup": f"SELECT * FROM ({_YEARS}) WHERE word IN (SELECT word FROM (SELECT {_SPLIT} FROM benchmark))",
    "index_join": f"SELECT word, count(*) AS years, CAST(sum(matches) AS BIGINT) AS matches FROM ({_YEARS}) WHERE word IN (SELECT word FROM (SELECT {_SPLIT} FROM conversations WHERE role = 'assistant')) GROUP BY 1",
    "fill_plan": _FILL,
    "json_round_trip": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN role END AS role, sha256(text) AS digest FROM conversations",
    "tsv_round_trip": "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer",
    "term_lookup": f"SELECT term, coalesce(n, -999)::DOUBLE AS score FROM (SELECT DISTINCT word AS term FROM (SELECT {_SPLIT} FROM benchmark) WHERE length(word) > 1) LEFT JOIN (SELECT word, count(*) AS n FROM (SELECT {_SPLIT} FROM conversations WHERE role = 'assistant') GROUP BY 1) ON word = term",
    "vector_ranks": "SELECT concat('w', vec_id % 97) AS word, min(r) AS rank FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) GROUP BY 1",
    "resumable_pairs": _PAIRS,
    "pair_manifest": f"SELECT {BLOCKS * (BLOCKS + 1) // 2} AS finished, {BLOCKS * (BLOCKS + 1) // 2} AS different, count(*) AS pairs FROM ({_PAIRS})",
    "rarity_refresh": f"SELECT term, n, rank, rarity FROM ({_RANKED})",
    "rarity_backfill": f"SELECT term, rarity FROM ({_RANKED}) WHERE half = 0",
    "visits": _visits("events"),
    "stream_visits": _CLOSED,
    "timely_visits": _CLOSED,
    "late_events": f"{_TAKEN} SELECT CAST(batch AS INT) AS batch, count(*) AS n, count(*) - (SELECT count(*) FROM taken t WHERE t.batch = b.batch) AS late FROM b GROUP BY batch",
}
