"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a 60-bit row hash. It starts as one bucket; a bucket over the byte limit,
and only such a bucket, splits on its next bit, until every shard fits. The directory is built from byte sums of hash
cells (at most 2**STEP rows a round), never from the rows themselves; cells that are still too heavy are opened by the
next STEP bits, for their own rows only. Rows meet the directory once: by its entries while these can be broadcast, by their
keys, which were placed without the rows, beyond that.

Rows with one hash can't be told apart by bits: those of one id and text. They are numbered by partition and dealt over
as many shards as their bytes need, so a group of copies of any size fits too. A single row over the limit has a shard
to itself.

Nulls: a null text has 0 bytes; a null id is hashed as the empty string. Rows that repeat are kept, each with its shard.
Empty tables give no rows. Other columns pass through ``shard_rows`` untouched; its four columns are put after them, and
where such a name is taken ours gets an underscore more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, hash60, numbered, packed, small, unpacked

BITS = 60
STEP = 20
ENTRY_BYTES = 96
LIMIT = 16 * 1024 * 1024


def bits_of(prefix: Column, depth: Column) -> Column:
    """The shard's name: its prefix as a string of 0 and 1, empty for the only shard of a small corpus."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth.cast("int"), "0"))


def leaves_of(rows: DataFrame, base: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows (key, bytes)``: the leaves (``prefix, depth, shard_bytes``) that bits ``base`` to ``base + STEP`` make, and
    the cells of ``base + STEP`` bits that are over the limit still."""
    width = base + STEP
    cells = rows.groupBy(F.shiftright("key", BITS - width).alias("cell")).agg(F.sum("bytes").alias("b"))
    cells = cut(cells, "cells")
    depths = cells.select("b", "cell", F.explode(F.sequence(F.lit(base), F.lit(width))).alias("depth"))
    sums = depths.withColumn("prefix", F.expr(f"shiftright(cell, {width} - depth)"))
    sums = cut(sums.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes")), "buckets")
    heavy = sums.filter(F.col("shard_bytes") > limit)
    parents = heavy.select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
    # a bucket is there if its parent had to split; it is a leaf if it need not, or cannot, split itself
    born = sums.join(parents, (F.col("depth") == F.col("d")) & (F.shiftright("prefix", 1) == F.col("p")), "left_semi")
    if not base:
        born = born.unionByName(sums.filter("depth = 0"))
    leaves = born.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
    return leaves, heavy.filter(F.col("depth") == width).select(F.col("prefix").alias("c"))


def directory(keys: DataFrame, limit: int) -> tuple[DataFrame | None, int, DataFrame | None, DataFrame | None, bool]:
    """Of ``keys (key, bytes)``: (the directory's entries ``entry, prefix, depth, shard_bytes`` of the first STEP bits if they are
    few enough to be broadcast, its bits, the leaf ``prefix, depth, shard_bytes`` of each distinct key ``leaf_key`` without an
    entry, the cells ``c`` of STEP bits that hold these, or None for all cells, whether a bucket over the limit is left that no
    bit can split)."""
    rest, entries, top, placed, opened = keys, None, 0, None, None
    for base in range(0, BITS, STEP):
        width = base + STEP
        leaves, heavy = leaves_of(rest, base, limit)
        depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most STEP + 1 of them
        if depths and not base and (ENTRY_BYTES << depths[-1]) <= BROADCAST_BYTES:
            top = depths[-1]
            entries = leaves.withColumn("entry", F.expr(f"explode(sequence(shiftleft(prefix, {top} - depth), shiftleft(prefix + 1L, {top} - depth) - 1L))"))
        elif depths:
            tried = rest.select("key").distinct().withColumn("d", F.explode(F.array(*map(F.lit, depths)))).withColumn("p", F.expr(f"shiftright(key, {BITS} - d)"))
            found = tried.join(leaves, (F.col("d") == F.col("depth")) & (F.col("p") == F.col("prefix"))).select(F.col("key").alias("leaf_key"), "prefix", "depth", "shard_bytes")
            placed = found if placed is None else placed.unionByName(found)
        n = heavy.count()
        if width == BITS or not n:
            return entries, top, placed, opened, bool(n)
        if not base and (entries is not None or not depths):
            opened = small(heavy, n)
        rest = rest.join(small(heavy, n), F.shiftright("key", BITS - width) == F.col("c"), "left_semi")


def shard_rows(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``bytes, shard, shard_depth, shard_bytes``: each row's shard, none over ``limit`` bytes of text."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    identity = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    keyed = packed(docs, key=hash60(identity), bytes=size)
    entries, top, placed, opened, stuck = directory(cut(keyed.select("key", "bytes"), "keys"), limit)
    out = keyed.filter("false").withColumns({c: F.lit(0).cast("long") for c in ("prefix", "depth", "shard_bytes")})
    if entries is not None:
        out = keyed.join(F.broadcast(entries), F.shiftright("key", BITS - top) == F.col("entry")).select(*out.columns)
    if placed is not None:
        rest = keyed if opened is None else keyed.join(opened, F.shiftright("key", BITS - STEP) == F.col("c"), "left_semi")
        rest = rest.join(placed, F.col("key") == F.col("leaf_key")).select(*out.columns)
        out = rest if entries is None else out.unionByName(rest)
    name = bits_of(F.col("prefix"), F.col("depth"))
    if stuck:
        out = number_copies(out, limit)
        name = F.when(F.col("part_no").isNull(), name).otherwise(F.concat(name, F.lit("-"), F.col("part_no").cast("string")))
    taken = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in taken else free(c + "_")
    return unpacked(out, docs, F.col("bytes").alias(free("bytes")), name.alias(free("shard")), F.col("depth").cast("long").alias(free("shard_depth")), F.col("shard_bytes").cast("long").alias(free("shard_bytes")))


def number_copies(placed: DataFrame, limit: int) -> DataFrame:
    """Deal the rows of a bucket that no bit can split, all of one id and text, over parts of at most ``limit`` bytes."""
    stuck = F.col("shard_bytes") > limit
    rows = numbered(placed.filter(stuck), ["key", "bytes"], "copies")
    rows = rows.withColumn("each", F.expr(f"greatest(1, {limit} div greatest(bytes, 1))")).withColumn("part_no", F.expr("no div each"))
    fill = F.least(F.col("each"), F.col("same") - F.col("part_no") * F.col("each")) * F.col("bytes")
    rows = rows.withColumn("shard_bytes", fill.cast("long")).select(*placed.columns, "part_no")
    return placed.filter(~stuck).withColumn("part_no", F.lit(None).cast("long")).unionByName(rows)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, **names: str) -> DataFrame:
    """Write each shard to its own folder ``shard=<bits>`` below ``path``; returns a row per shard with its size."""
    sharded = shard_rows(docs, limit, **names)
    sharded = sharded.withColumn("shard", F.concat(F.lit("s"), F.col("shard")))
    # a shard is at most ``limit`` bytes, or one row, and is moved to one task once
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
