"""What several operators share: written cuts of the plan, sizes, shuffled order, global prefix sums."""

from __future__ import annotations

import ctypes
import gc
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.plans.cuts import cut, discard, new_path, release, scope  # noqa: F401  part of what operators share

#: Bytes up to which a side is broadcast, as rows (counted by the caller) times what a row takes in a hash table.
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 256
#: Bits of the filter that stands in for a set of hashes too large to be broadcast: 16 MB of them.
FILTER_BITS = 1 << 27


def ship(name: str) -> None:
    """Send the functions of module ``name`` to executors by value, so that they needn't have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def give_back() -> None:
    """Return freed memory to the system. What a fit on the driver used would else stay with the process while later stages run."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """``docs`` with each row in one column ``row``, beside the columns ``own``: no name of theirs can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


def unpacked(rows: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``docs`` again, then ``more``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *more)


def small(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` for broadcast if its ``rows`` (counted by the caller) take no more than the bound; a plain side of a shuffled join
    beyond it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def among(rows: DataFrame, hashed: str, keys: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` whose long ``hashed`` is one of the ``n`` (counted by the caller) of ``keys``. A set too large for broadcast is
    stood in for by a bitmap of bounded size, which leaves few others to the shuffled join."""
    narrow = keys.select(F.col(key).alias("among_key")).distinct()
    if n * 40 > BROADCAST_BYTES:
        place = F.pmod(F.col("among_key"), F.lit(FILTER_BITS))
        marks = narrow.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        marks = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))  # FILTER_BITS / 2**15 rows of 4 KB
        own = F.pmod(F.col(hashed), F.lit(FILTER_BITS))
        byte = F.conv(F.hex(F.expr(f"substring(marks, cast(bitmap_bit_position(pmod({hashed}, {FILTER_BITS}L)) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(pmod({hashed}, {FILTER_BITS}L)) % 8 as int))"))
        rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number(own) == F.col("bucket")).filter(bit != 0).drop("bucket", "marks")
    return rows.join(small(narrow, n, 40), F.col(hashed) == F.col("among_key"), "left_semi")


#: A key with more rows than the greater of these (a count, a share of all rows) is met by broadcast, so that it isn't one
#: task's work; there are at most HOT_SHARE such keys.
HOT_ROWS, HOT_SHARE = 256, 100_000


def meet(rows: DataFrame, key: str, facts: DataFrame, fact_key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, one for each key, of which ``count`` says how many rows it has, out of ``total``."""
    least = max(HOT_ROWS, total // HOT_SHARE)
    if total <= least:  # no key can be hot
        return rows.join(facts, F.col(key) == F.col(fact_key))
    hot = facts.filter(F.col(count) > least)
    hot_keys = hot.select(F.col(fact_key).alias("hot_key"))
    cold = rows.join(F.broadcast(hot_keys), F.col(key) == F.col("hot_key"), "left_anti").join(facts.filter(F.col(count) <= least), F.col(key) == F.col(fact_key))
    return rows.join(F.broadcast(hot), F.col(key) == F.col(fact_key)).unionByName(cold)


def text_hash(text: Column) -> Column:
    """With a document's id this names a row; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long (any SQL engine can repeat it)."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: str, value: str | None, name: str) -> DataFrame:
    """``df`` with ``rank0`` (position by ``order``, nulls last) and, if ``value`` is given, ``before`` (its sum over the
    rows ahead). Rows are dealt by range and numbered range by range, so no task sees them all. ``order`` must be unique."""
    dealt = cut(df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn("range_no", F.spark_partition_id()), name)
    add = F.sum(value) if value else F.lit(None).cast("long")
    ranges = dealt.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"), add.alias("v") if value else F.max(F.lit(0)).alias("v"))
    # one row a range: at most as many as shuffle partitions
    ahead = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("range_no").alias("r_no"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("r_n"),
        F.coalesce(F.sum("v").over(ahead), F.lit(0)).alias("r_v"),
    )
    within = Window.partitionBy("range_no").orderBy(F.col(order).asc_nulls_last())
    out = dealt.join(F.broadcast(ranges), F.col("range_no") == F.col("r_no"))
    out = out.withColumn("rank0", (F.row_number().over(within) - 1 + F.col("r_n")).cast("long"))
    if value:
        prior = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", prior + F.col("r_v"))
    return out.drop("range_no", "r_no", "r_n", "r_v")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``no`` (0, 1, ... within rows of equal ``keys``) and ``same`` (how many these are). Numbers are given within
    a written partition and then lifted by those ahead, so equal rows in any number aren't one task's work."""
    rows = cut(rows.withColumn("file_no", F.spark_partition_id()), name)
    tally = rows.groupBy(*keys, "file_no").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)  # a row for each partition at most
    tally = tally.select(
        *[F.col(k).alias(f"n_{k}") for k in keys],
        F.col("file_no").alias("n_file"),
        F.coalesce(F.sum("n").over(own.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"),
        F.sum("n").over(own).alias("same"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "file_no").orderBy("file_no")) - 1
    match = F.col("file_no") == F.col("n_file")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    out = rows.withColumn("within", within).join(tally, match)
    return out.select(*[F.col(c) for c in rows.columns if c != "file_no"], (F.col("within") + F.col("skip")).cast("long").alias("no"), "same")
