"""Written cuts of a plan. Loops and stages write what they have to the cluster's shared folder and go on from there, so
that plans stay short and a lost executor costs one step at most."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_WRITTEN: dict[int, list[str]] = {}
#: The paths of the scope that this thread is in, if any.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named a local run gets a temporary one; a cluster's executors couldn't see that."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(path)
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    out.cut_path = path
    return out


def exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, paths: list[str]) -> int:
    gone = 0
    written = _WRITTEN.get(id(spark.sparkContext), [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
        if path in written:
            written.remove(path)
    return gone


def discard(*cuts: DataFrame) -> None:
    """Delete cuts that nothing reads any more."""
    for df in cuts:
        if path := getattr(df, "cut_path", None):
            delete(df.sparkSession, [path])


@contextlib.contextmanager
def scope(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Delete what is cut inside once it is left, but for what was put into ``keep``. Results that still read one of these must
    be in ``keep``, or have been saved."""
    outer, own = _SCOPE.get(), []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        held = {getattr(df, "cut_path", None) for df in keep}
        delete(spark, [p for p in own if p not in held])
        if outer is not None:
            outer.extend(p for p in own if p in held)


def release(spark: SparkSession) -> int:
    """Delete all that this application cut; results that still read it must have been saved before."""
    return delete(spark, list(_WRITTEN.get(id(spark.sparkContext), [])))
