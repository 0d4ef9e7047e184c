"""Event streams: windows with watermarks, deduplication, incremental graph upkeep, session state.

Every stream runs to the end of what is there (``availableNow``) in tests and batch use, or on a trigger; state and offsets
live in the checkpoint folder, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.cuts import cut, discard, exists, new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of the Parquet files at ``path``, with ``at`` as a zoned time. A path that names one file is read by its folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    many = not name.endswith(".parquet") or _is_folder(spark, path)
    stream = spark.readStream.schema(schema).format("parquet")
    stream = stream.load(path) if many else stream.option("pathGlobFilter", name).load(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by person over event-time windows; later than ``late`` is dropped."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return stream.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events of a person no further than ``gap`` apart."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run to the end of the input into Parquet of the shared folder; read back. Files are committed exactly once. ``update``: rows
    that change are merged by ``keys``, so that a watermark may drop what is done with; ``complete``: every result is whole, and
    nothing is dropped (sessions, which have no updates)."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    if mode == "update":
        upsert(stream, out, keys).trigger(availableNow=True).start().awaitTermination()
        return upserted(spark, out)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append")
    else:
        # complete results replace each other; the last one is whole
        q = stream.writeStream.outputMode("complete").option("checkpointLocation", out + "-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


BUCKETS = 64


def upsert(stream: DataFrame, path: str, keys: list[str], order: str | None = None):
    """Keep at ``path`` one row for each of ``keys``: a micro-batch's, or, with ``order``, the newest by it. The table is dealt over
    buckets of the keys' hash; a batch reads and replaces only those buckets that it touches. A batch that is run again leaves
    the same rows, so the table is right exactly once."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int):
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).withColumn("is_new", F.lit(1))
        rows = cut(rows, "batch")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        both = rows
        if exists(spark, f"{path}/rows"):
            old = spark.read.parquet(f"{path}/rows").filter(F.col("bucket").isin(touched)).withColumn("is_new", F.lit(0))
            both = rows.unionByName(old.select(*rows.columns))
        first = [order, "is_new"] if order else ["is_new"]
        rest = [c for c in rows.columns if c not in (*keys, *first)]
        best = both.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("b")).select(*keys, "b.*").select(*[c for c in rows.columns if c != "is_new"])
        merged = cut(best, "merged")  # whole before any bucket is replaced
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        discard(rows, merged)

    return stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{path}/state")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def session_state(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Running state of each person, as a hook would keep it: events, errors, and the value since the last purchase.
    ``applyInPandasWithState`` keeps one small record a person and is fed a person's rows in pieces; rows later than ``late`` are
    dropped, and a person unseen for that long is forgotten (what was last said of them stays where it was written)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pieces, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, errors, since = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(pieces)).sort_values(["at", "event_id"])  # one person's rows of one batch
        for kind, value in rows[["event_type", "value"]].itertuples(index=False):
            n, errors = n + 1, errors + (kind == "error")
            since = 0.0 if kind == "purchase" else since + (0.0 if pd.isna(value) else value)
        state.update((n, errors, since))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "errors": [errors], "since_purchase": [since]})

    own = stream.withWatermark("at", late).groupBy("user_id")
    return own.applyInPandasWithState(step, "user_id long, events long, errors long, since_purchase double", "events long, errors long, since double", "update", GroupStateTimeout.EventTimeTimeout)


def handled(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], kind: str = "event_type"):
    """Give each micro-batch's rows of a kind to that kind's handler, with the batch's number; kinds without one are passed over. A
    batch may be given again after a failure, under the same number."""

    def dispatch(batch: DataFrame, number: int):
        own = cut(batch.filter(F.col(kind).isin(*handlers)), "handled")
        present = {r[0] for r in own.select(kind).distinct().collect()}  # at most one a handler
        for name in sorted(present):
            handlers[name](own.filter(F.col(kind) == name), number)
        discard(own)

    return stream.writeStream.foreachBatch(dispatch)
