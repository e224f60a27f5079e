"""A ranked table that is kept up to date by batches of changes, of which only what they touch is written again.

Rows (key, value, version) are kept in buckets of their keys. The number of rows of each value, with how many come
before it in its range, is kept in ranges of values, by cut points that are fixed when the table is made. A batch reads the
buckets of its keys, takes those changes that are newer than what is there, and writes these buckets, and the ranges that
a value has left or entered, in folders of its own. Then it writes a commit: which folder holds each bucket and
range. So readers see a batch as a whole or not at all, and one that failed is simply repeated.
A batch that was committed is skipped, so a repeated one changes nothing; nor do changes that aren't newer.

A row's rank is the number of rows in the ranges before, plus that before its value in its own, plus one; ranges that a batch
doesn't touch keep theirs and are only offset. Null values come last, as one.

Keys are expected not to be null; such changes are left out. Of several changes to a key the latest version counts, of
equal versions the greatest value. A table may be made of no rows.

Scale: a batch costs its buckets and ranges, not the table, if it is small; a value of most rows is one row of its range.
The driver holds a row per bucket and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexigrid.sources.tables import written

ROWS, COUNTS = "key string, value double, version long, bucket int", "value double, n long, before long, range int"
COMMIT = "part string, number int, batch long, n long"


class RankTable:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # what is there

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def committed(self) -> int:
        """The last batch whose commit was written to its end; -1 if there is none."""
        numbers = [int(n.split("=")[1]) for n in self._names("commits") if n.startswith("batch=")]
        return max((k for k in numbers if "_SUCCESS" in self._names(f"commits/batch={k}")), default=-1)

    def _held(self) -> dict[tuple[str, int], tuple[int, int]]:
        """(part, number) -> (batch, rows) of the last commit."""
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits/batch={self.committed()}").collect()
        return {(r["part"], r["number"]): (r["batch"], r["n"]) for r in rows}

    def _read(self, part: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        column = "bucket" if part == "rows" else "range"
        paths = [f"{self.folder}/{part}/batch={batch}/{column}={k}" for (p, k), (batch, n) in self._held().items() if p == part and n and (numbers is None or k in numbers)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.folder}/{part}").schema(schema).parquet(*paths)

    def _cuts(self) -> list[float]:
        return [r["cut"] for r in self.spark.read.schema("cut double").parquet(f"{self.folder}/cuts").orderBy("cut").collect()]

    def _range(self, value: Column) -> Column:
        cuts = self._cuts()
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)
        return F.when(value.isNull(), len(cuts) + 1).otherwise(at).cast("int")

    # changes

    def create(self, rows: DataFrame, ranges: int = 64) -> None:
        """Make the table of rows (key, value, version) as batch 0, with cut points at quantiles of their values."""
        given = written(rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"), F.col("version").cast("long").alias("version")), "ranks-given")
        cuts = sorted(set(given.where("value IS NOT NULL").approxQuantile("value", [k / ranges for k in range(1, ranges)], 0.001)))
        self.spark.createDataFrame([(c,) for c in cuts], "cut double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cuts")
        self._apply(given, 0, {})

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Take a batch of changes (key, value, version); False if it was committed before."""
        if batch <= self.committed():
            return False
        self._apply(changes, batch, self._held())
        return True

    def _apply(self, changes: DataFrame, batch: int, held: dict[tuple[str, int], tuple[int, int]]) -> None:
        latest = changes.where("key IS NOT NULL").groupBy(F.col("key").cast("string").alias("key")).agg(F.max(F.struct(F.col("version").cast("long").alias("version"), F.col("value").cast("double").alias("value"))).alias("new"))
        new = written(latest.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")), "ranks-changes")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
        old = self._read("rows", ROWS, touched) if held else self.spark.createDataFrame([], ROWS)
        met = old.select("key", "bucket", F.struct("version", "value").alias("old")).join(new.select("key", F.col("bucket").alias("b"), "new"), "key", "full_outer")
        newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.version") > F.col("old.version")))
        state = written(met.select("key", F.coalesce("bucket", "b").alias("bucket"), "old", F.when(newer, F.col("new")).otherwise(F.col("old")).alias("now"), F.coalesce(newer, F.lit(False)).alias("newer")), "ranks-merged")
        state.select("key", "now.value", "now.version", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/batch={batch}")
        moved = state.where("newer").where("old IS NULL OR NOT (old.value <=> now.value)")
        gone = moved.where("old IS NOT NULL").select("old.value", F.lit(-1).alias("n"))
        delta = written(gone.union(moved.select("now.value", F.lit(1).alias("n"))).groupBy("value").agg(F.sum("n").alias("n")).withColumn("range", self._range(F.col("value"))), "ranks-delta")
        changed = [r[0] for r in delta.select("range").distinct().collect()]  # as many as there are ranges
        before = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        kept = self._read("counts", COUNTS, changed) if held else self.spark.createDataFrame([], COUNTS)
        counts = kept.select("value", "n", "range").union(delta.select("value", "n", "range")).groupBy("range", "value").agg(F.sum("n").alias("n")).where("n > 0")
        counts.select("value", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "range").write.mode("overwrite").partitionBy("range").parquet(f"{self.folder}/counts/batch={batch}")
        self._commit(batch, held, touched, changed)

    def _commit(self, batch: int, held: dict, buckets: list[int], ranges: list[int]) -> None:
        read = lambda part, schema: self.spark.read.option("basePath", f"{self.folder}/{part}").schema(schema).parquet(f"{self.folder}/{part}/batch={batch}")
        now = dict(held)
        now.update({("rows", k): (batch, 0) for k in buckets} | {("counts", k): (batch, 0) for k in ranges})
        if buckets:
            now.update({("rows", r["bucket"]): (batch, r["n"]) for r in read("rows", ROWS).groupBy("bucket").agg(F.count("*").alias("n")).collect()})
        if ranges:
            now.update({("counts", r["range"]): (batch, r["n"]) for r in read("counts", COUNTS).groupBy("range").agg(F.sum("n").alias("n")).collect()})
        rows = [(part, number, at, n) for (part, number), (at, n) in sorted(now.items())]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")

    # readers

    def ranks(self) -> DataFrame:
        """key, value, version, rank and percent_rank, in ascending order of values."""
        held = self._held()
        sizes = sorted((k, n) for (part, k), (_, n) in held.items() if part == "counts")
        offsets, total = [], 0
        for k, n in sizes:
            offsets.append((k, total))
            total += n
        start = F.broadcast(self.spark.createDataFrame(offsets, "range int, start long"))  # a row per range
        places = self._read("counts", COUNTS).join(start, "range").select(F.col("value").alias("v"), (F.col("start") + F.col("before") + 1).alias("rank"))
        found = self._read("rows", ROWS).join(places, F.col("value").eqNullSafe(F.col("v"))).drop("v", "bucket")
        return found.withColumn("percent_rank", (F.col("rank") - 1) / F.lit(total - 1) if total > 1 else F.lit(0.0))

    def vacuum(self) -> int:
        """Delete the folders that the last commit doesn't name, and older commits; gives how many went."""
        last, held, gone = self.committed(), self._held(), 0
        used = {f"{part}/batch={at}" for (part, _), (at, _) in held.items()} | {f"commits/batch={last}"}
        for part in ("rows", "counts", "commits"):
            for name in self._names(part):
                if name.startswith("batch=") and f"{part}/{name}" not in used:
                    path = self._path(f"{part}/{name}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                    gone += 1
        return gone


def keep_ranked(changes: DataFrame, table: RankTable, checkpoint: str) -> None:
    """Take a stream of changes (key, value, version) into the table, to its end. The stream's batch k is the table's k + 1."""
    query = changes.writeStream.foreachBatch(lambda df, k: (table.apply(df, k + 1), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
