"""Index maintenance: changes, upserts, deletes, orphans, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_CONFIDENCE = 0.8


def changed(current: DataFrame, stored: DataFrame, key: str = "path", digest: str = "file_hash") -> DataFrame:
    """Rows that are new or whose digest differs."""
    s = stored.select(F.col(key), F.col(digest).alias("__old"))
    return current.join(s, key, "left").where(~F.col(digest).eqNullSafe(F.col("__old"))).drop("__old")


def missing(stored: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Stored rows that the current ones lack: stale chunks, deleted files, orphans."""
    return stored.join(current.select(*keys).distinct(), list(keys), "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``, the batch after what is stored; map-side combined, nothing is sorted."""
    both = stored.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    last = F.max_by(F.struct(*stored.columns), F.struct("__b", order))
    return both.groupBy(key).agg(last.alias("__row")).select("__row.*")


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def live_blobs(blobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blobs that a chunk still refers to, so that shared ones outlive one of their chunks."""
    return blobs.join(chunks.select("sha").distinct(), "sha", "left_semi")


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a new version under ``path`` and then points readers to it, so that they see the old table or the new
    one, whole, whenever the writer stops; a plan may read ``path`` while it is replaced.  The version before stays
    for plans that still read it; older ones go."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    for unfinished in (x for x in fs.listStatus(p(path)) if x.getPath().getName() == f"v{number}") if fs.exists(p(path)) else ():
        fs.delete(unfinished.getPath(), True)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v{number}")
    fs.create(p(f"{path}/_v{number}.ready"), False).close()
    for old in known[:-1]:
        fs.delete(p(f"{path}/_v{old}.ready"), False)
        fs.delete(p(f"{path}/v{old}"), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p(path))] if fs.exists(p(path)) else []
    return sorted(int(n[2:-6]) for n in names if n.startswith("_v") and n.endswith(".ready"))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version; an empty table of ``schema``, if given, where there is none."""
    known = versions(spark, path)
    if not known and schema:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/v{known[-1]}" if known else path)


def intentions(log: DataFrame) -> DataFrame:
    """``log(query, target, confidence, ts, seq)`` → usage, latest confidence and time of each pair."""
    last = F.struct("ts", "seq")
    return log.groupBy("query", "target").agg(F.count(F.lit(1)).alias("usage"), F.max_by("confidence", last).alias("confidence"), F.max("ts").alias("last_used"))


def best_intention(pairs: DataFrame) -> DataFrame:
    """Per query the target of highest confidence, then usage."""
    best = F.min_by(F.struct(*pairs.columns), F.struct((-F.col("confidence")).alias("a"), (-F.col("usage")).alias("b"), "target"))
    return pairs.groupBy("query").agg(best.alias("__row")).select("__row.*")


def coalesced(events: DataFrame) -> DataFrame:
    """``events(path, op, ts, seq)`` → the last operation of each path (add and change count alike)."""
    op = F.when(F.col("op") == "unlink", "delete").otherwise("upsert")
    return events.groupBy("path").agg(F.max_by(op, F.struct("ts", "seq")).alias("op"))


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Bursts of events with pauses under ``gap_seconds``: key, begin, end, n."""
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return events.groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end")).drop("session_window")


def rate_window(log: DataFrame, key: str, seconds: int = 60, tokens: str | None = None) -> DataFrame:
    """Requests (and sums of ``tokens``) of the same key in the ``seconds`` up to each row, those exactly that old left out.

    A key's log is cut into stretches of time; each also gets the rows of one window before it, so keys of any size spread.
    """
    window_us = seconds * 1_000_000
    stretch = 60 * window_us
    rows = log.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__own", F.floor(F.col("__us") / stretch))
    ahead = F.floor((F.col("__us") + window_us) / stretch)
    rows = rows.withColumn("__part", F.explode(F.when(ahead == F.col("__own"), F.array("__own")).otherwise(F.array("__own", ahead))))
    w = Window.partitionBy(key, "__part").orderBy(F.col("__us")).rangeBetween(-(window_us - 1), 0)
    out = rows.withColumn("in_window", F.count(F.lit(1)).over(w))
    if tokens:
        out = out.withColumn("tokens_in_window", F.sum(tokens).over(w))
    return out.where(F.col("__part") == F.col("__own")).drop("__us", "__own", "__part")


def stable(sizes: DataFrame, threshold_ms: int = 100) -> DataFrame:
    """``sizes(path, ts, size)``, a poll each → paths whose last size has stood for ``threshold_ms``, with it and since when."""
    last = sizes.groupBy("path").agg(F.max_by("size", "ts").alias("size"), F.max("ts").alias("seen"))
    other = sizes.join(last.select("path", F.col("size").alias("__size")), "path").where(~F.col("size").eqNullSafe(F.col("__size")))
    changed_ = other.groupBy("path").agg(F.max("ts").alias("__other"))
    same = sizes.join(last, ["path", "size"]).join(changed_, "path", "left").where(F.col("__other").isNull() | (F.col("ts") > F.col("__other")))
    since = same.groupBy("path").agg(F.min("ts").alias("since"), F.max("size").alias("size"), F.max("seen").alias("seen"))
    held = F.unix_millis(F.col("seen").cast("timestamp")) - F.unix_millis(F.col("since").cast("timestamp"))
    return since.where(held >= threshold_ms).select("path", "size", "since")


def cached(accesses: DataFrame, capacity: int, ttl_ms: int | None = None, now: object = None) -> DataFrame:
    """``accesses(key, op, ts, seq)`` (set, get or peek) → key, last: what a least-recently-used cache holds afterwards.

    Sets and gets refresh, peeks do not; a key is held if it is among the last ``capacity`` refreshed ones and, with
    ``ttl_ms``, was set less than that before ``now``.  Gets of keys that were never set hold nothing.
    """
    place = F.struct("ts", "seq")
    keys = accesses.where("op <> 'peek'").groupBy("key").agg(F.max(place).alias("last"), F.max(F.when(F.col("op") == "set", F.col("ts"))).alias("set_at")).where("set_at IS NOT NULL")
    if ttl_ms is not None:
        age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("set_at").cast("timestamp"))
        keys = keys.where(age < ttl_ms)
    return keys.orderBy(F.desc("last")).limit(capacity).select("key", F.col("last.ts").alias("last"))


def progress(done: DataFrame, total: int) -> DataFrame:
    """``done(file, begin, end)`` → one row: files done and left, their share, mean seconds of a file, seconds left."""
    taken = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1e6
    row = done.agg(F.count(F.lit(1)).alias("done"), F.coalesce(F.avg(taken), F.lit(0.0)).alias("mean"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return row.select("done", left.alias("left"), F.round(100.0 * F.col("done") / F.greatest(F.lit(total), F.lit(1)), 1).alias("percent"), "mean", (left * F.col("mean")).alias("seconds_left"))
