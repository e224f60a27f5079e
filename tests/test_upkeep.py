"""Resumable blocks of pairs, a ranked table kept by a stream, visits with late events, clusters by density."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import blocks, graphs, pairs, sessions
from lexigrid.plans import texts
from lexigrid.sources import files
from lexigrid.sources.tables import tokens
from lexigrid.streaming import activity, refresh

BEGAN = datetime(2024, 1, 1)


def vectors(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)] + [(n, [0.0] * 4), (n + 1, None), (None, [1.0] * 4)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def triples(df):
    return sorted((r["a"], r["b"], round(r["score"], 9)) for r in df.collect())


def test_a_stopped_run_goes_on(spark, tmp_path):
    items, folder = vectors(spark), f"file://{tmp_path}/blocks"
    expected = triples(pairs.cosine_pairs(items.where("id IS NOT NULL AND v IS NOT NULL"), "id", "v", 0.8))
    assert blocks.run_blocks(items, "id", "v", 0.8, folder, blocks=4, at_once=3, rounds=1) == 3
    assert blocks.pending(spark, folder, 4).count() == 7
    part = triples(blocks.pairs_of(spark, folder))
    assert set(part) < set(expected)
    # a round that was stopped after it had written pairs: they are overwritten, and not seen before
    spark.createDataFrame([(1, 2, 0.9, 2, 3), (5, 6, 0.9, 3, 3)], "a long, b long, score double, i int, j int").write.mode("append").partitionBy("i", "j").parquet(f"{folder}/pairs")
    assert triples(blocks.pairs_of(spark, folder)) == part
    assert triples(blocks.resumable_pairs(items, "id", "v", 0.8, folder, blocks=4, at_once=3)) == expected
    assert blocks.run_blocks(items, "id", "v", 0.8, folder, blocks=4) == 0
    noted = blocks.manifest(spark, folder).collect()
    assert len(noted) == len({(r["i"], r["j"]) for r in noted}) == 10 and sum(r["pairs"] for r in noted) == len(expected)


def test_other_items_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/blocks"
    blocks.run_blocks(vectors(spark, 20), "id", "v", 0.8, folder, blocks=2)
    for items, threshold in ((vectors(spark, 21), 0.8), (vectors(spark, 20), 0.7)):
        with pytest.raises(ValueError, match="other items"):
            blocks.run_blocks(items, "id", "v", threshold, folder, blocks=2)


def test_no_items(spark, tmp_path):
    assert blocks.resumable_pairs(vectors(spark).where("false"), "id", "v", 0.8, f"file://{tmp_path}/none", blocks=3).count() == 0


def ranked(values):
    """key -> (value, rank), nulls last."""
    order = sorted(values.values(), key=lambda v: (v is None, v or 0))
    return {k: (v, order.index(v) + 1) for k, v in values.items()}


def seen(table):
    return {r["key"]: (r["value"], r["rank"]) for r in table.ranks().collect()}


CHANGE = "key string, value double, version long"


def test_ranks_follow_changes(spark, tmp_path):
    rng = random.Random(4)
    now = {f"t{i}": rng.choice([None, float(rng.randrange(40)), 7.0]) for i in range(200)}
    table = refresh.RankTable(spark, f"file://{tmp_path}/ranks", buckets=5)
    table.create(spark.createDataFrame([(k, v, 0) for k, v in now.items()], CHANGE), ranges=6)
    assert seen(table) == ranked(now)
    for batch in range(1, 4):
        changes = [(f"t{rng.randrange(230)}", rng.choice([None, rng.random() * 50, 7.0]), batch) for _ in range(15)] + [(None, 1.0, batch), ("t1", 5.0, -1)]
        latest = {}
        for k, v, version in changes:
            if k and version > 0:
                latest[k] = v if k not in latest else max(v, latest[k], key=lambda x: (x is not None, x or 0))
        now |= latest
        given = spark.createDataFrame(changes, CHANGE)
        assert table.apply(given, batch) and seen(table) == ranked(now)
        assert not table.apply(given, batch) and table.apply(given, batch + 10) is True and seen(table) == ranked(now)
        table = refresh.RankTable(spark, f"file://{tmp_path}/ranks", buckets=5)
        for k in (batch + 10,):
            path = table._path(f"commits/batch={k}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    shares = {r["key"]: r["percent_rank"] for r in table.ranks().collect()}
    assert shares == {k: pytest.approx((r - 1) / (len(now) - 1)) for k, (_, r) in ranked(now).items()}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    table = refresh.RankTable(spark, f"file://{tmp_path}/ranks", buckets=8)
    table.create(spark.createDataFrame([(f"t{i}", float(i), 0) for i in range(100)], CHANGE), ranges=10)
    table.apply(spark.createDataFrame([("t3", 4.0, 1)], CHANGE), 1)
    written = Counter((part, at) for (part, _), (at, _) in table._held().items())
    assert written["rows", 1] == 1 and written["counts", 1] == 1 and written["counts", 0] >= 8
    # a batch that failed before its commit isn't seen
    table.spark.createDataFrame([("t3", 99.0, 2, 0)], refresh.ROWS).write.partitionBy("bucket").parquet(f"{table.folder}/rows/batch=2")
    assert seen(table)["t3"] == (4.0, 4) and table.committed() == 1
    assert table.apply(spark.createDataFrame([("t3", 98.5, 2)], CHANGE), 2) and seen(table)["t3"] == (98.5, 99)
    before = seen(table)
    assert table.vacuum() > 0 and seen(table) == before


def test_stream_to_its_end(spark, tmp_path):
    table = refresh.RankTable(spark, f"file://{tmp_path}/ranks", buckets=4)
    table.create(spark.createDataFrame([(f"t{i}", None, 0) for i in range(50)], CHANGE), ranges=4)
    final = {f"t{i}": float(i % 9) for i in range(60)}
    rows = [(k, v + 100, 1) for k, v in final.items()] + [(k, v, 2) for k, v in final.items()]
    spark.createDataFrame(rows, CHANGE).repartition(3).write.parquet(f"file://{tmp_path}/changes")
    stream = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/changes")
    refresh.keep_ranked(stream(), table, f"file://{tmp_path}/checkpoint")
    last = table.committed()
    assert last == 3 and seen(table) == ranked(final)
    refresh.keep_ranked(stream(), table, f"file://{tmp_path}/other")  # all batches once more
    assert table.committed() == last and seen(table) == ranked(final)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arrivals():
    """(batch, user, minutes): a hot user, gaps of just 30 minutes and just more, ties, late ones."""
    rng, out = random.Random(6), []
    for k in range(400):
        out.append((k * 4 // 400, 1, k * 12 + rng.choice([0, 0, 20])))
    out += [(0, 2, 0), (0, 2, 30), (0, 2, 61), (1, 2, 92), (0, 3, 5), (0, 3, 5), (1, None, 1500), (3, 4, 4500), (3, 4, 10), (2, 5, 0), (3, 1, 100)]
    return out


def visits_of(rows):
    """(user, began, ended, n) in minutes."""
    out = []
    for user in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == user)
        current = []
        for t in [*times, None]:
            if current and (t is None or t > current[-1] + 30):
                out.append((user, current[0], current[-1] + 30, len(current)))
                current = []
            current.append(t)
    return Counter(out)


def in_minutes(df):
    return Counter((r["user_id"], (r["began"] - BEGAN).total_seconds() / 60, (r["ended"] - BEGAN).total_seconds() / 60, r["n"]) for r in df.collect())


def as_events(spark, rows):
    return spark.createDataFrame([(k, BEGAN + timedelta(minutes=t) if t is not None else None, user, "x", 1.0, "", b) for k, (b, user, t) in enumerate(rows)], EVENTS + ", batch int")


def test_visits(spark):
    rows = arrivals()
    events = as_events(spark, [*rows, (0, 9, None)]).repartition(4)
    assert in_minutes(sessions.visits(events, ["user_id"], "30 minutes")) == visits_of(rows)
    native = events.where("ts IS NOT NULL").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
    assert in_minutes(native.toDF("user_id", "began", "ended", "n")) == visits_of(rows)
    assert sessions.visits(events.where("false"), ["user_id"], "30 minutes").count() == 0


def test_late_events_are_those_that_the_watermark_says(spark, tmp_path):
    events = as_events(spark, arrivals())
    for b in range(4):
        events.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = activity.sessions(activity.event_stream(spark, f"file://{tmp_path}/in", 1), "30 minutes", "10 minutes")
    activity.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    got = in_minutes(spark.read.schema("user_id long, began timestamp, ended timestamp, n long").parquet(f"file://{tmp_path}/out"))
    taken = sessions.on_time(events, "batch", "30 minutes", "10 minutes")
    assert 0 < taken.count() < events.count()
    closed = taken.select("closed").first()[0]
    expected = in_minutes(sessions.visits(taken, ["user_id"], "30 minutes").where(F.col("ended") <= F.lit(closed)))
    assert got == expected and len(got) > 3


def test_events_in_time_join_visits_that_were_closed_before(spark, tmp_path):
    rows = [(0, 1, 50), (0, 2, 55), (0, 3, 100), (1, 3, 101), (2, 3, 102), (3, 1, 75), (3, 2, 80), (3, 2, 105), (3, 2, 130), (3, 9, 150)]
    events = as_events(spark, rows)
    for b in range(4):
        events.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = activity.sessions(activity.event_stream(spark, f"file://{tmp_path}/in", 1), "30 minutes", "10 minutes")
    activity.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    emitted = spark.read.schema("user_id long, began timestamp, ended timestamp, n long").parquet(f"file://{tmp_path}/out")
    assert in_minutes(emitted)[(2, 55, 85, 1)] == 1  # closed, and gone on with
    assert in_minutes(activity.whole_sessions(emitted, f"file://{tmp_path}/checkpoint")) == Counter({(1, 50, 105, 2): 1, (3, 100, 132, 3): 1})


def test_ranks_of_vectors_go_by_the_names_of_files(spark, tmp_path):
    """Spark reads the largest file first."""
    for name, lines in (("a", 2), ("b", 50), ("c", 7)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k} 1 2\n" for k in range(lines)))
    found = {r["word"]: r["rank"] for r in files.read_vectors(spark, f"file://{tmp_path}").collect()}
    assert (found["a0"], found["b0"], found["b49"], found["c0"], found["c6"], len(found)) == (1, 3, 52, 53, 59, 59)
    assert len(files.read_vectors(spark, f"file://{tmp_path}", 5).collect()) == 5


def test_every_word_meets_all_others_by_syllables(spark, tmp_path):
    spark.createDataFrame([(1, "cat dog banana"), (2, "potato cat")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = texts.syllable_similarity(spark, str(tmp_path)).collect()
    total = {w: sum(r["words"] for r in rows if r["word"] == w) for w in ("cat", "dog", "banana", "potato")}
    assert total == dict.fromkeys(total, 3) and {(r["other"], r["words"], r["similarity"]) for r in rows if r["word"] == "cat"} == {(1, 1, 1.0), (3, 2, round(1 / 3, 9))}


def test_mastery_goes_on_over_triggers_for_each_word(spark, tmp_path):
    """Three triggers, of which not every one has each word; a user's words are one state, so it isn't grouped by word."""
    rows = [(b, 1, w, k * 10 + b, ok) for b in range(3) for k, (w, ok) in enumerate([("a", True), ("b", b != 1), (None, True), ("a", None)]) if (b, w) != (1, "a")]
    schema = "user_id long, word string, ts timestamp, event_id long, correct boolean"
    for b in range(3):
        mine = [(u, w, BEGAN + timedelta(minutes=100 * b + e), e, ok) for x, u, w, e, ok in rows if x == b]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = activity.mastery_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
    activity.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "update")
    found = {(r["epoch"], r["word"]): (r["level"], r["total"], r["correct"], r["streak"], r["ease"], r["days"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    state, expected = {}, {}
    for b, _, w, _, ok in sorted(rows, key=lambda r: (r[0], r[3])):
        state[w] = expected[(b, w)] = activity.mastery_step(state.get(w, ("learning", 0, 0, 0, 2.5, 1)), bool(ok))
    assert found == expected and (1, "a") not in found


def test_words_are_taken_from_whole_texts(spark):
    text = "It's  a-b\t\u00c4pfel\n--- x1y \u00a0no\u00a0gap 12 \u0130s \x0bz"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    old = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[ \t\n\r\f]+")).alias("word")).withColumn("word", F.regexp_replace("word", r"[^\p{L}]", "")).where(F.length("word") > 1)
    assert [r["word"] for r in tokens(docs, "doc_id").collect()] == [r["word"] for r in old.collect()] and old.count() > 4


def clusters_of(n, scores, least):
    near = {i: {} for i in range(n)}
    for (a, b), s in scores.items():
        near[a][b] = near[b][a] = max(s, near[a].get(b, -9))
    cores = {i for i in near if len(near[i]) + 1 >= least}
    label = {i: i for i in cores}
    for _ in range(n):
        for i in cores:
            for j in near[i]:
                if j in cores:
                    label[i] = label[j] = min(label[i], label[j])
    out = {}
    for i in near:
        best = max(((s, -j) for j, s in near[i].items() if j in cores), default=None)
        out[i] = (len(near[i]) + 1, *(("core", label[i]) if i in cores else ("border", label[-best[1]]) if best else ("noise", None)))
    return out


def test_density_clusters(spark):
    rng = random.Random(8)
    scores = {(a, b): rng.randrange(1, 6) / 5 for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75)) if a != b}
    scores |= {(60 + k, 61 + k): 0.5 for k in range(30)}  # a chain
    given = [(a, b, s) for (a, b), s in scores.items()] + [(b, a, s - 0.1) for (a, b), s in list(scores.items())[:20]] + [(5, 5, 1.0)]
    items = spark.range(100).withColumnRenamed("id", "item")
    for least in (1, 3, 4):
        found = graphs.density_clusters(spark.createDataFrame(given, "a long, b long, score double"), items, "item", least)
        assert {r["id"]: (r["neighbours"], r["kind"], r["cluster"]) for r in found.collect()} == clusters_of(100, scores, least)
