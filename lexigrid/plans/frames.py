"""Queries over tables of numbers and times: search views, statistics, activity, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrid.operators import analytics, maintenance, rarity, search, state
from lexigrid.operators.ranks import with_rank
from lexigrid.sources.tables import table


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers: the type is the word, values from 30 on are right, days are sessions."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("word"), (F.col("value") >= 30).alias("correct"), "value", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"))


def _as_of(spark, d):
    """The time of the latest event: what all relative times refer to."""
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])


def word_view(spark, d):
    """Parts with what was sold of them, the blend of a stored and a computed price, and a link."""
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.min("l_suppkey").alias("s_suppkey"))
    joined = _part(spark, d).join(sold, "p_partkey", "left").join(table(spark, d, "supplier"), "s_suppkey", "left")
    link = F.coalesce(F.when(F.col("p_size") > 40, F.col("p_name")), F.concat(F.lit("/part/"), F.col("s_name")))
    return joined.select("p_partkey", "p_name", F.col("n").alias("sold"), "s_name", link.alias("link"), F.coalesce(F.nullif(F.col("p_retailprice"), F.lit(900.0)), F.col("n").cast("double")).alias("price"))


def rank_then_filter(spark, d):
    where = search.conditions(equals={"p_brand": "Brand#2"}, ranges={"p_retailprice": (901.0, 1400.0)})
    return search.ranked_search(_part(spark, d), "p_retailprice", where).select("p_partkey", "p_retailprice", "rank")


def filter_then_rank(spark, d):
    where = search.conditions(equals={"p_brand": "Brand#2"}, ranges={"p_retailprice": (901.0, 1400.0)})
    return search.filtered_ranks(_part(spark, d), "p_retailprice", where).select("p_partkey", "p_retailprice", "rank")


def domain_rarity(spark, d):
    return rarity.quartiles(_part(spark, d), "p_brand", "p_retailprice").select("p_brand", "n", "low", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"), "high")


def consolidated_words(spark, d):
    """Per name and type: its brands in order, sizes' range and mean price."""
    return _part(spark, d).groupBy("p_name", "p_type").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), "; ").alias("brands"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.round(F.avg("p_retailprice"), 6).alias("price"))


def group_quantile_counts(spark, d):
    """Per brand: how many prices are in the lowest and highest tenth of that brand."""
    p = _part(spark, d)
    q = p.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return p.join(q, "p_brand").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.count_if(F.col("p_retailprice") <= F.col("q")[0]).alias("lowest"), F.count_if(F.col("p_retailprice") >= F.col("q")[1]).alias("highest"))


def correlation(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd_pop"), F.count("*").alias("n"))


def largest_differences(spark, d):
    """Ten orders whose price differs most from the sum of their lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("lines"))
    diff = F.abs(F.col("o_totalprice").cast("decimal(18,2)") - F.col("lines"))
    return _orders(spark, d).join(lines, "o_orderkey").select("o_orderkey", diff.cast("double").alias("difference")).orderBy(F.col("difference").desc(), F.col("o_orderkey").desc()).limit(10)


def harvest_stats(spark, d):
    return _orders(spark, d).groupBy("o_orderstatus").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))


def review_queue_view(spark, d):
    """Open orders by urgency and age, with days waited until a given day."""
    o = _orders(spark, d).where("o_orderstatus = 'O'")
    return o.select("o_orderkey", "o_orderpriority", F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))


def share_of_total(spark, d):
    return rarity.shares(_orders(spark, d), "o_orderpriority").select("o_orderpriority", "n", F.round("share", 6).alias("share"))


def mode_per_group(spark, d):
    return analytics.commonest(_orders(spark, d), "o_custkey", F.col("o_orderpriority"), "priority")


def having_accuracy(spark, d):
    """Customers with three orders at least, and the mean share of finished ones below 60 %."""
    g = _orders(spark, d).withColumn("correct", F.col("o_orderstatus") == "F")
    return analytics.weak(analytics.accuracy_by(g, "o_custkey"), 3, 60.0).select("o_custkey", "total", "correct", F.round("accuracy", 6).alias("accuracy"))


def quiz_overview(spark, d):
    a = _answers(spark, d)
    sessions = a.groupBy("session_id", "user_id").agg(F.max("correct").alias("completed"))
    return analytics.overview(sessions, a)


def question_types(spark, d):
    return analytics.accuracy_by(_answers(spark, d), "word").withColumn("accuracy", F.round("accuracy", 6))


def weak_question_types(spark, d):
    return analytics.weak(analytics.accuracy_by(_answers(spark, d), "user_id", "word"), 5, 50.0).withColumn("accuracy", F.round("accuracy", 6))


def struggling_words(spark, d):
    """Per user the three weakest words with three answers at least."""
    g = analytics.accuracy_by(_answers(spark, d), "user_id", "word").where("total >= 3")
    w = Window.partitionBy("user_id").orderBy(F.col("accuracy").asc(), F.col("total").desc(), F.col("word").asc())
    return g.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").withColumn("accuracy", F.round("accuracy", 6))


def daily_rollup(spark, d):
    return analytics.daily(_answers(spark, d))


def streak(spark, d):
    return analytics.streaks(analytics.daily(_answers(spark, d)), 0.5)


def trend(spark, d):
    """Slope of daily accuracy over the days of activity."""
    days = analytics.daily(_answers(spark, d))
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1
    points = days.select("user_id", x.cast("double").alias("x"), (F.col("correct") * 100.0 / F.col("total")).alias("y"))
    return analytics.trends(points).withColumn("slope", F.round("slope", 6))


def hour_mode(spark, d):
    return analytics.commonest(_answers(spark, d), "user_id", F.hour("ts").cast("long"), "hour")


def dow_mode(spark, d):
    return analytics.commonest(_answers(spark, d), "user_id", F.date_format("ts", "EEEE"), "day")


def consistency(spark, d):
    return analytics.consistency(_answers(spark, d), _as_of(spark, d)).withColumn("score", F.round("score", 6))


def deck_progress(spark, d):
    level = F.when(F.col("value") >= 80, "mastered").when(F.col("value") >= 40, "reviewing").otherwise("learning")
    return _answers(spark, d).groupBy("user_id").agg(F.count("*").alias("cards"), F.round(F.coalesce(F.avg(analytics.mastery_score(level)), F.lit(0.0)), 6).alias("progress"))


def item_status(spark, d):
    a = _answers(spark, d).groupBy("user_id", "word").agg(F.max("ts").alias("last"), F.max("value").alias("best"))
    level = F.when(F.col("best") >= 150, "mastered").otherwise("learning")
    due = F.when(F.col("best") >= 1, F.col("last") + F.make_interval(days=F.floor(F.col("best") / 40).cast("int")))
    return a.select("user_id", "word", analytics.item_status(level, due, _as_of(spark, d)).alias("status"))


def review_queue(spark, d):
    """The first 40 items to review, of everyone's latest state."""
    s = state.mastery(_answers(spark, d), ["user_id", "word"])
    due = F.date_add(F.to_date("last_seen"), F.col("days"))
    return s.withColumn("due", due).orderBy(*analytics.review_order(F.col("level"), F.col("due"), F.col("total") - F.col("correct"), F.struct("user_id", "word"))).limit(40).select("user_id", "word", "level", "due")


def mastery_fold(spark, d):
    return state.mastery(_answers(spark, d), ["user_id", "word"]).withColumn("ease", F.round("ease", 6))


def sm2_schedule(spark, d):
    return state.schedule(_answers(spark, d), ["user_id", "word"]).withColumn("ease", F.round("ease", 6))


def flashcard_fold(spark, d):
    return state.cards(_answers(spark, d), ["user_id", "word"])


def running_confidence(spark, d):
    return state.running_confidence(_answers(spark, d), ["user_id", "word"], "value").withColumn("confidence", F.round("confidence", 6))


def mistake_accumulate(spark, d):
    """Wrong answers by user and word: those of January's first half as the old table, the rest added to it."""
    wrong = _answers(spark, d).where("NOT correct").withColumn("mistakes", F.lit(1).cast("long"))
    count = lambda x: x.groupBy("user_id", "word").agg(F.sum("mistakes").alias("mistakes"))
    middle = F.lit("2024-01-15").cast("timestamp")
    return maintenance.accumulate(count(wrong.where(F.col("ts") < middle)), count(wrong.where(F.col("ts") >= middle)), ["user_id", "word"], ["mistakes"])


def latest_state(spark, d):
    """The latest event of each user."""
    return _answers(spark, d).groupBy("user_id").agg(F.max_by("word", F.struct("ts", "event_id")).alias("word"), F.max("ts").alias("ts"))


def source_score(spark, d):
    v = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(10)).cast("string")).alias("source"), (F.col("value") >= 20).alias("ok"), F.floor(F.col("value") / 10).alias("found"), (F.col("value") * 100).alias("ms"))
    return analytics.source_scores(v).withColumn("score", F.round("score", 6))


def reliability(spark, d):
    rows = _answers(spark, d).select("user_id", (F.least("value", F.lit(100.0)) / 100).alias("r"), (F.pmod("event_id", F.lit(4)) + 1).alias("tier"))
    return analytics.reliability(rows, "user_id").withColumn("reliability", F.round("reliability", 6))


def best_definition(spark, d):
    """Per user and word the event with the highest value; ties: the first."""
    return analytics.best_by(_answers(spark, d).select("user_id", "word", "event_id", "value"), ["user_id", "word"], "value", "event_id")


def _old_new(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("N"), "o_totalprice": F.col("o_totalprice") + 1, "o_orderdate": F.col("o_orderdate") + F.make_interval(days=F.lit(1))})
    return old, new


def upsert_latest(spark, d):
    return maintenance.upsert(*_old_new(spark, d), ["o_orderkey"], "o_orderdate")


def insert_ignore(spark, d):
    old, new = _old_new(spark, d)
    return maintenance.insert_ignore(old, new.union(new.withColumn("o_totalprice", F.col("o_totalprice") + 5)), ["o_orderkey"], [F.col("o_totalprice").asc()])


def update_from_join(spark, d):
    old, new = _old_new(spark, d)
    part = old.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    return maintenance.update_from(part, new, "o_orderkey", "o_totalprice", only_missing=True)


def move_rows(spark, d):
    """Finished orders moved, and what stays: both, marked."""
    moved, stays = maintenance.move(_orders(spark, d).select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")
    return moved.withColumn("place", F.lit("moved")).union(stays.withColumn("place", F.lit("stays")))


def table_diff(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 0.5).when(F.col("o_orderkey") % 5 == 0, 0.000001).otherwise(0.0))
    return maintenance.table_diff(o.where("o_orderkey % 13 <> 0"), changed, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def counter_mismatch(spark, d):
    stored = _orders(spark, d).withColumn("lines", F.pmod("o_orderkey", F.lit(7)))
    return maintenance.counter_mismatch(stored, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "lines").select("o_orderkey", "stored", "actual")


def unvisited_urls(spark, d):
    """Pages that weren't seen in the last 120 days before a given one; a page's id tells when it was."""
    p = table(spark, d, "pages").select("page_id", "url")
    when = F.lit("2024-06-30").cast("timestamp") - F.make_interval(days=F.pmod("page_id", F.lit(200)).cast("int"))
    visits = p.select(F.sha2("url", 256).alias("url_hash"), when.alias("last_visited"))
    return maintenance.unvisited(p, visits, F.lit("2024-06-30").cast("timestamp")).select("page_id", "url_hash")


def seeded_shuffle(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", search.seeded_order(p, "p_partkey", 7).alias("key")).orderBy("key", "p_partkey").limit(25)


def coverage_count_filter(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.expr("count(*) FILTER (WHERE quality = 1 AND toxic = 0)").alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def missing_definitions(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where("quality IS NULL").select("doc_id", "source")


def price_bands(spark, d):
    band = F.when(F.col("p_retailprice") < 950, "low").when(F.col("p_retailprice") < 1000, "middle").when(F.col("p_retailprice") < 1050, "high").otherwise("top")
    return _part(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least"))


def excluded_anti(spark, d):
    """Parts without a line of 49 pieces or more: an anti join."""
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _part(spark, d).select("p_partkey", "p_name").join(big, "p_partkey", "left_anti")


def induced_lines(spark, d):
    """Lines whose part and supplier are both in given sets: two semi joins."""
    parts = _part(spark, d).where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(parts, "l_partkey", "left_semi").join(suppliers, "l_suppkey", "left_semi")


def top_ranked_parts(spark, d):
    return with_rank(_part(spark, d), "p_size", "rank", descending=True).where("rank <= 50").select("p_partkey", "p_size", "rank")


QUERIES = {f.__name__: f for f in (word_view, rank_then_filter, filter_then_rank, domain_rarity, consolidated_words, group_quantile_counts, correlation, largest_differences, harvest_stats, review_queue_view, share_of_total, mode_per_group, having_accuracy, quiz_overview, question_types, weak_question_types, struggling_words, daily_rollup, streak, trend, hour_mode, dow_mode, consistency, deck_progress, item_status, review_queue, mastery_fold, sm2_schedule, flashcard_fold, running_confidence, mistake_accumulate, latest_state, source_score, reliability, best_definition, upsert_latest, insert_ignore, update_from_join, move_rows, table_diff, counter_mismatch, unvisited_urls, seeded_shuffle, coverage_count_filter, missing_definitions, price_bands, excluded_anti, induced_lines, top_ranked_parts)}

ANSWERS = "SELECT event_id, ts, user_id, event_type AS word, value >= 30 AS correct, value, concat(user_id, '/', strftime(ts, '%Y-%m-%d')) AS session_id FROM events"
DAILY = f"SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (correct) AS correct FROM ({ANSWERS}) GROUP BY 1, 2"
_ACC = "round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 6) AS accuracy"
_MODE = "SELECT {k}, {v}, n FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {v}) AS r FROM (SELECT {k}, {e} AS {v}, count(*) AS n FROM ({t}) GROUP BY 1, 2)) WHERE r = 1"
OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate FROM orders WHERE o_orderkey % 2 = 0"
#: The ordered log of each key, and a fold over it as a recursive query.
LOG = f"SELECT user_id, word, ts, correct, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id, word ORDER BY ts, event_id) AS k, max(ts) OVER (PARTITION BY user_id, word) AS last_seen, count(*) OVER (PARTITION BY user_id, word) AS m FROM ({ANSWERS})"
MASTERY = f"""
WITH RECURSIVE log AS ({LOG}), f AS (
  SELECT user_id, word, 1::BIGINT AS k, 1 AS total, CAST(correct AS INT) AS correct, CAST(correct AS INT) AS streak, 2.5::DOUBLE AS ease, m, last_seen FROM log WHERE k = 1
  UNION ALL
  SELECT f.user_id, f.word, log.k, total + 1, f.correct + CAST(log.correct AS INT), CASE WHEN log.correct THEN streak + 1 ELSE 0 END, CASE WHEN log.correct THEN least(2.5, round(ease + 0.1::DOUBLE, 1)) ELSE greatest(1.3, round(ease - 0.2::DOUBLE, 1)) END::DOUBLE, f.m, f.last_seen
  FROM f JOIN log ON log.user_id = f.user_id AND log.word = f.word AND log.k = f.k + 1
), done AS (
  SELECT *, CASE WHEN total > 1 AND correct / total >= 0.9 AND total >= 5 AND streak >= 3 THEN 'mastered' WHEN total > 1 AND correct / total >= 0.7 AND total >= 3 THEN 'reviewing' ELSE 'learning' END AS level FROM f WHERE k = m
)
SELECT user_id, word, level, total, correct, streak, ease, CAST(CASE level WHEN 'mastered' THEN floor(7 * ease) WHEN 'reviewing' THEN floor(3 * ease) ELSE 1 END AS INT) AS days, last_seen FROM done
"""

ORACLES = {
    "word_view": "SELECT p_partkey, p_name, n AS sold, s_name, coalesce(CASE WHEN p_size > 40 THEN p_name END, '/part/' || s_name) AS link, coalesce(nullif(p_retailprice, 900.0), CAST(n AS DOUBLE)) AS price FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = k",
    "rank_then_filter": "SELECT p_partkey, p_retailprice, rank FROM (SELECT *, rank() OVER (ORDER BY p_retailprice) AS rank FROM part) WHERE p_brand = 'Brand#2' AND p_retailprice BETWEEN 901 AND 1400",
    "filter_then_rank": "SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice) AS rank FROM part WHERE p_brand = 'Brand#2' AND p_retailprice BETWEEN 901 AND 1400",
    "domain_rarity": "SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS low, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS high FROM part GROUP BY 1",
    "consolidated_words": "SELECT p_name, p_type, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands, min(p_size) AS low, max(p_size) AS high, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2",
    "group_quantile_counts": "SELECT p_brand, count(*) AS n, round(stddev_samp(p_retailprice), 6) AS sd, count(*) FILTER (p_retailprice <= q[1]) AS lowest, count(*) FILTER (p_retailprice >= q[2]) AS highest FROM part JOIN (SELECT p_brand AS b, quantile_cont(p_retailprice, [0.1, 0.9]) AS q FROM part GROUP BY 1) ON b = p_brand GROUP BY 1",
    "correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(stddev_pop(l_quantity), 6) AS sd_pop, count(*) AS n FROM lineitem GROUP BY 1",
    "largest_differences": "SELECT o_orderkey, CAST(abs(CAST(o_totalprice AS DECIMAL(18,2)) - s) AS DOUBLE) AS difference FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY difference DESC, o_orderkey DESC LIMIT 10",
    "harvest_stats": "SELECT o_orderstatus, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, round(avg(o_totalprice), 4) AS mean_price, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1",
    "review_queue_view": "SELECT o_orderkey, o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS days FROM orders WHERE o_orderstatus = 'O'",
    "share_of_total": "SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
    "mode_per_group": _MODE.format(k="o_custkey", v="priority", e="o_orderpriority", t="SELECT * FROM orders"),
    "having_accuracy": f"SELECT o_custkey, count(*) AS total, count(*) FILTER (correct) AS correct, {_ACC} FROM (SELECT o_custkey, o_orderstatus = 'F' AS correct FROM orders) GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (correct) * 100.0 / count(*) < 60",
    "quiz_overview": f"SELECT user_id, count(*) AS sessions, count(*) FILTER (done) AS completed, CAST(sum(q) AS BIGINT) AS questions, CAST(sum(c) AS BIGINT) AS correct FROM (SELECT session_id, user_id, bool_or(correct) AS done, count(*) AS q, count(*) FILTER (correct) AS c FROM ({ANSWERS}) GROUP BY 1, 2) GROUP BY 1",
    "question_types": f"SELECT word, count(*) AS total, count(*) FILTER (correct) AS correct, {_ACC} FROM ({ANSWERS}) GROUP BY 1",
    "weak_question_types": f"SELECT user_id, word, count(*) AS total, count(*) FILTER (correct) AS correct, {_ACC} FROM ({ANSWERS}) GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (correct) * 100.0 / count(*) < 50",
    "struggling_words": f"SELECT user_id, word, total, correct, accuracy, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY correct * 100.0::DOUBLE / total, total DESC, word) AS place FROM (SELECT user_id, word, count(*) AS total, count(*) FILTER (correct) AS correct, {_ACC} FROM ({ANSWERS}) GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE place <= 3",
    "daily_rollup": DAILY,
    "streak": f"SELECT user_id, count(*) FILTER (missed = 0 AND r <= 30) AS streak FROM (SELECT user_id, row_number() OVER w AS r, sum(CAST(correct / total < 0.5 AS INT)) OVER w AS missed FROM ({DAILY}) WINDOW w AS (PARTITION BY user_id ORDER BY day DESC)) GROUP BY 1",
    "trend": f"SELECT user_id, round(s, 6) AS slope, CASE WHEN n >= 3 AND s > 2 THEN 'improving' WHEN n >= 3 AND s < -2 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT user_id, count(*) AS n, regr_slope(y, x) AS s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS x, correct * 100.0::DOUBLE / total AS y FROM ({DAILY})) GROUP BY 1)",
    "hour_mode": _MODE.format(k="user_id", v="hour", e="hour(ts)", t=ANSWERS),
    "dow_mode": _MODE.format(k="user_id", v="day", e="dayname(ts)", t=ANSWERS),
    "consistency": f"SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS active_days, round(count(DISTINCT CAST(ts AS DATE)) * 100.0::DOUBLE / 7, 6) AS score FROM ({ANSWERS}), (SELECT max(ts) AS t FROM events) WHERE ts > t - INTERVAL 7 DAY GROUP BY 1",
    "deck_progress": f"SELECT user_id, count(*) AS cards, round(avg(CASE WHEN value >= 80 THEN 100.0 WHEN value >= 40 THEN 60.0 ELSE 20.0 END), 6) AS progress FROM ({ANSWERS}) GROUP BY 1",
    "item_status": f"SELECT user_id, word, CASE WHEN best < 1 THEN 'unknown' WHEN due <= t THEN 'due' WHEN due <= t + INTERVAL 1 DAY THEN 'due_soon' WHEN best >= 150 THEN 'mastered' ELSE 'learning' END AS status FROM (SELECT user_id, word, max(value) AS best, max(ts) + to_days(CAST(floor(max(value) / 40) AS INT)) AS due FROM ({ANSWERS}) GROUP BY 1, 2), (SELECT max(ts) AS t FROM events)",
    "review_queue": f"SELECT user_id, word, level, CAST(CAST(last_seen AS DATE) + days AS DATE) AS due FROM ({MASTERY}) ORDER BY CASE level WHEN 'learning' THEN 1 WHEN 'reviewing' THEN 2 ELSE 3 END, due, total - correct DESC, user_id, word LIMIT 40",
    "mastery_fold": f"SELECT * REPLACE (round(ease, 6) AS ease) FROM ({MASTERY})",
    "running_confidence": f"WITH RECURSIVE log AS ({LOG}), f AS (SELECT user_id, word, k, value AS c, m FROM log WHERE k = 1 UNION ALL SELECT f.user_id, f.word, log.k, (c + value) / 2, f.m FROM f JOIN log ON log.user_id = f.user_id AND log.word = f.word AND log.k = f.k + 1) SELECT user_id, word, round(c, 6) AS confidence, CAST(m AS INT) AS n FROM f WHERE k = m",
    "flashcard_fold": f"""WITH RECURSIVE log AS ({LOG}), f AS (
        SELECT user_id, word, k, 1 AS studied, CAST(correct AS INT) AS correct, 1 AS days, 'learning' AS level, m, last_seen FROM log WHERE k = 1
        UNION ALL SELECT f.user_id, f.word, log.k, studied + 1, f.correct + CAST(log.correct AS INT), CAST(CASE WHEN log.correct THEN least(days * 2, 30) ELSE greatest(days // 2, 1) END AS INT),
          CASE WHEN f.correct + CAST(log.correct AS INT) >= (studied + 1) * 0.9 AND studied + 1 >= 5 THEN 'mastered' WHEN f.correct + CAST(log.correct AS INT) >= (studied + 1) * 0.8 AND studied + 1 >= 3 THEN 'reviewing' ELSE level END, f.m, f.last_seen
        FROM f JOIN log ON log.user_id = f.user_id AND log.word = f.word AND log.k = f.k + 1)
        SELECT user_id, word, studied, correct, days, level, last_seen FROM f WHERE k = m""",
    "sm2_schedule": f"""WITH RECURSIVE log AS ({LOG}), f AS (
        SELECT user_id, word, 0::BIGINT AS k, 0 AS total, 0 AS correct, 0 AS run, 1::BIGINT AS days, 250::BIGINT AS ease, m, last_seen FROM log WHERE k = 1
        UNION ALL SELECT user_id, word, k, total + 1, CAST(correct + ok AS INT), CAST(run * ok + ok AS INT),
          least(36500, CASE WHEN ok = 0 THEN 1 WHEN days = 1 THEN 6 WHEN days = 6 THEN 14 ELSE days * ease // 100 END),
          greatest(130, ease + CASE WHEN ok = 0 THEN -20 ELSE CASE least(5, 3 + (run + 1) // 2) WHEN 3 THEN -14 WHEN 4 THEN 0 ELSE 10 END END), m, last_seen
        FROM (SELECT f.* REPLACE (log.k AS k), CAST(log.correct AS INT) AS ok FROM f JOIN log ON log.user_id = f.user_id AND log.word = f.word AND log.k = f.k + 1))
        SELECT user_id, word, total, correct, run, CAST(days AS INT) AS days, round(ease / 100::DOUBLE, 6) AS ease,
          CASE WHEN run >= 5 AND correct / total >= 0.8 THEN 'mastered' WHEN run >= 2 AND correct / total >= 0.6 THEN 'reviewing' ELSE 'learning' END AS level, last_seen FROM f WHERE k = m""",
    "mistake_accumulate": f"SELECT user_id, word, count(*) AS mistakes FROM ({ANSWERS}) WHERE NOT correct GROUP BY 1, 2",
    "latest_state": f"SELECT user_id, word, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({ANSWERS})) WHERE r = 1",
    "source_score": "SELECT source, count(*) AS visits, round(CASE WHEN count(*) < 3 THEN 0.5 ELSE 0.4 * count(*) FILTER (ok) / count(*) + 0.4 * least(1.0, coalesce(sum(found) / nullif(count(*) FILTER (ok), 0), 0) / 10) + 0.2 * greatest(0.0, 1 - avg(ms) / 5000) END, 6) AS score FROM (SELECT concat(event_type, '-', user_id % 10) AS source, value >= 20 AS ok, floor(value / 10) AS found, value * 100 AS ms FROM events) GROUP BY 1",
    "reliability": f"SELECT user_id, round(coalesce(sum(r * (5 - tier) * r) / nullif(sum((5 - tier) * r), 0), 0), 6) AS reliability FROM (SELECT user_id, least(value, 100.0) / 100 AS r, event_id % 4 + 1 AS tier FROM ({ANSWERS})) GROUP BY 1",
    "best_definition": f"SELECT user_id, word, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, word ORDER BY value DESC, event_id) AS r FROM ({ANSWERS})) WHERE r = 1",
    "upsert_latest": f"SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) AS r FROM ({OLD} UNION ALL {NEW})) WHERE r = 1",
    "insert_ignore": f"{OLD} UNION ALL SELECT * FROM ({NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({OLD}))",
    "update_from_join": f"SELECT o.o_orderkey, o.o_orderstatus, coalesce(CASE WHEN o.o_orderkey % 4 <> 0 THEN o.o_totalprice END, n.o_totalprice) AS o_totalprice, o.o_orderdate FROM ({OLD}) o LEFT JOIN ({NEW}) n ON n.o_orderkey = o.o_orderkey",
    "move_rows": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'moved' ELSE 'stays' END AS place FROM orders",
    "table_diff": "WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0), b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 0.5 WHEN o_orderkey % 5 = 0 THEN 0.000001 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR abs(a.o_totalprice - b.o_totalprice) > 0.00001",
    "counter_mismatch": "SELECT o_orderkey, o_orderkey % 7 AS stored, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> coalesce(n, 0)",
    "unvisited_urls": "SELECT page_id, sha256(url) AS url_hash FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 200 < 120)",
    "seeded_shuffle": "SELECT p_partkey, md5(concat(p_partkey, '7')) AS key FROM part ORDER BY key, p_partkey LIMIT 25",
    "coverage_count_filter": "SELECT lang, count(*) AS docs, count(quality) AS labelled, count(*) FILTER (quality = 1 AND toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "missing_definitions": "SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
    "price_bands": "SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1000 THEN 'middle' WHEN p_retailprice < 1050 THEN 'high' ELSE 'top' END AS band, count(*) AS n, min(p_retailprice) AS least FROM part GROUP BY 1",
    "excluded_anti": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "induced_lines": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "top_ranked_parts": "SELECT p_partkey, p_size, rank FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS rank FROM part) WHERE rank <= 50",
}
