"""Small state beside a graph: a ledger of savings, sessions, a build's options, and oracles of expected facts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.cuts import delete, exists

ORACLE_VERSION = 1


def _rename(spark: SparkSession, a: str, b: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(a)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, path(b))


def record(spark: SparkSession, path: str, tokens: int) -> None:
    """Append tokens saved to the ledger at ``path``."""
    if tokens > 0:
        spark.createDataFrame([(tokens,)], "tokens long").coalesce(1).write.mode("append").parquet(path)


def drain(spark: SparkSession, path: str) -> int:
    """What the ledger holds, which is emptied: it is moved away first, so that what is recorded meanwhile is kept."""
    away = f"{path}.draining-{uuid.uuid4().hex}"
    if not exists(spark, path) or not _rename(spark, path, away):
        return 0
    total = spark.read.schema("tokens long").parquet(away).agg(F.sum("tokens")).first()[0] or 0
    delete(spark, [away])
    return total


def latest_session(spark: SparkSession, folder: str) -> tuple[str, dict] | None:
    """(id, content) of the session file ``<id>.json`` that was written last."""
    if not exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    one = files.orderBy(F.desc("modificationTime"), F.desc("path")).select("path", F.col("content").cast("string").alias("text")).first()
    return (one["path"].rsplit("/", 1)[-1].removesuffix(".json"), json.loads(one["text"])) if one else None


def tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the JSON lines below ``folder``; its checkpoint keeps what was read, so each file is read once."""
    return spark.readStream.schema(schema).json(folder)


def save_options(spark: SparkSession, path: str, options: dict) -> None:
    spark.createDataFrame([(json.dumps(options, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_options(spark: SparkSession, path: str) -> dict:
    """What a build was told; nothing where it was told nothing."""
    return json.loads(spark.read.text(path).first()[0]) if exists(spark, path) else {}


def oracle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(pinned sources ``path, hash``; facts ``partition, source, relation, target``; build options) of a manifest, one JSON document."""
    manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if manifest.get("version") != ORACLE_VERSION:
        raise ValueError(f"an oracle of version {manifest.get('version')}")
    for name in (s["path"] for s in manifest["sources"]):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not a path below the sources: {name}")
    sources = spark.createDataFrame([(s["path"], s["sha256"]) for s in manifest["sources"]], "path string, hash string")
    facts = [(p["name"], f["source"], f["relation"], f["target"]) for p in manifest["partitions"] for f in p["expected"]]
    return sources, spark.createDataFrame(facts, "partition string, source string, relation string, target string"), manifest.get("build", {})


def unpinned(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Pinned sources that ``files (path, hash)`` lack or hold otherwise: an oracle's facts hold for its own sources only."""
    return sources.join(files.select(F.col("path").alias("f_path"), F.col("hash").alias("f_hash")), (F.col("path") == F.col("f_path")) & (F.col("hash") == F.col("f_hash")), "left_anti")
