"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Targets. Sources weigh 5, 2, 1, repeating, in code point order, null last. They share ``share`` times the words of the
   corpus; a target stops at ``cap`` times its source's size and what is over is shared again by weight, until none is.
2. Schedule. The mix has N = 2**m slots. Slot t holds the van der Corput point of t (the reversed bits of t over N), and
   belongs to the source whose interval of cumulated targets holds that point. As the N points are just the grid 0..N-1,
   a source gets its share of the slots to within one, evenly spread; a source too small for a grid point gets one slot
   of its own behind the others. Slots are ranked within their source.
3. Blocks. Each source's documents, in shuffled order (by MD5 of a seed and the id), form a line of words; the line is
   repeated up to ``cap`` times and cut where the target is reached, and the stretch is cut into as many equal blocks as
   the source has slots. Slot of rank r takes block r. So each source gives its target to within half a word.

Sums and ranks along a line or the slots are built in two levels (buckets of the shuffled order, then inside a bucket), so
that a source with a third of all rows is never one task's work.

Nulls: a null text has size 0, a null source is a source of its own. Documents without words take no slot (``taken`` 0)
and ``mixed_rows`` passes them once. Rows that repeat hold their own places in the line. Empty tables give no rows.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hash60, numbered, packed, ranked, small, unpacked, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 8192
BUCKET_ROWS = 4096
SEED = "mix-1"


def targets_of(sizes: DataFrame) -> tuple[DataFrame, int, int]:
    """``sizes (source, source_size)`` -> with ``source_no, target, goal`` (rounded target) and ``goal_before``; all words; sources."""
    order = ranked(sizes, "source", None, "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank0") % len(WEIGHTS) + 1).cast("int")).cast("double")
    order = cut(order.select("source", "source_size", F.col("rank0").alias("source_no"), weight.alias("w")), "weights")
    limit = F.col("source_size") * float(CAP)
    n, words = order.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level, fixed = None, -1
    while True:  # each round stops at least one more source, so rounds are few
        over = F.lit(False) if level is None else limit <= F.col("w") * level
        held, weights, now = order.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if now == fixed or not weights:
            break
        level, fixed = (words * SHARE - (held or 0.0)) / weights, now
    target = F.lit(0.0) if level is None else F.least(limit, F.col("w") * level)
    found = order.select("source", "source_size", "source_no", target.alias("target"))
    found = found.withColumn("goal", F.round("target").cast("long")).drop("rank0", "before")
    return ranked(found, "source_no", "goal", "targets").drop("rank0").withColumnRenamed("before", "goal_before"), words, n


def slots_of(spark, targets: DataFrame, n_sources: int, block_words: int) -> DataFrame:
    """The schedule: ``slot, s_no, rank, slots`` (of its source)."""
    total = targets.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], "slot long, s_no long, rank long, slots long")
    bits = max(4, ceil(log2(max(1, total / block_words))))
    n = 1 << bits
    chunk = 12
    at = lambda c: F.ceil(c.cast("double") * (n / total)).cast("long")  # noqa: E731  one function for both ends: no gap, no overlap
    spans = targets.filter("goal > 0").select(F.col("source_no").alias("s_no"), at(F.col("goal_before")).alias("lo"), at(F.col("goal_before") + F.col("goal")).alias("hi"))
    spans = cut(spans.withColumn("slots", F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), "spans")
    pieces = spans.filter("hi > lo").withColumn("piece", F.explode(F.expr(f"sequence(shiftright(lo, {chunk}), shiftright(hi - 1, {chunk}))")))
    grid = spark.range(n).withColumn("piece", F.shiftright("id", chunk))
    held = grid.join(small(pieces, n_sources + (n >> chunk) + 1), "piece").filter("id >= lo AND id < hi")
    turned = F.expr(f"conv(rpad(reverse(lpad(bin(id), {bits}, '0')), {bits}, '0'), 2, 10)").cast("long")
    held = held.select(turned.alias("slot"), "s_no", "slots").unionByName(spans.filter("hi <= lo").select((F.col("s_no") + n).alias("slot"), "s_no", "slots"))
    held = cut(held.withColumn("part", F.shiftright("slot", chunk)), "slots")
    ahead = Window.partitionBy("s_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("s_no", "part").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.select(F.col("s_no").alias("p_no"), F.col("part").alias("p_part"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy("s_no", "part").orderBy("slot")) - 1
    both = held.withColumn("inside", inside).join(parts, (F.col("s_no") == F.col("p_no")) & (F.col("part") == F.col("p_part")))
    return both.select("slot", "s_no", (F.col("inside") + F.col("skip")).cast("long").alias("rank"), "slots")


def lines_of(docs: DataFrame, targets: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """``docs (doc_id, source, size)`` with ``start``, the words ahead of it in its source's shuffled line."""
    bits = max(0, min(24, ceil(log2(max(1, n_rows / BUCKET_ROWS)))))
    key = hash60(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")))
    names = small(targets.select(F.col("source").alias("t_source"), "source_no", "source_size", "target", "goal"), n_sources)
    rows = docs.join(names, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("key", key)
    rows = cut(rows.withColumn("bucket", F.shiftright("key", 60 - bits) if bits else F.lit(0).cast("long")), "lines")
    ahead = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("v"))
    sums = sums.select(F.col("source_no").alias("b_no"), F.col("bucket").alias("b"), F.coalesce(F.sum("v").over(ahead(["source_no"], ["bucket"])), F.lit(0)).alias("skip"))
    inside = F.coalesce(F.sum("size").over(ahead(["source_no", "bucket"], ["key", "doc_id", "size"])), F.lit(0))
    both = rows.withColumn("inside", inside).join(sums, (F.col("source_no") == F.col("b_no")) & (F.col("bucket") == F.col("b")))
    return both.select("doc_id", "source", "size", "source_no", "source_size", "target", "goal", (F.col("inside") + F.col("skip")).alias("start"))


def schedule(docs: DataFrame, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines, pieces). A piece is a stretch of one document in one slot of the mix: ``slot, s_no, start, from_word, words``,
    where (s_no, start) names the document's place in its line; in order of ``slot, line_word`` pieces are the mix."""
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    targets, _, n_sources = targets_of(sizes)
    targets = cut(targets, "goals")
    lines = cut(lines_of(rows, targets, n_sources, rows.count()), "places")
    slots = slots_of(spark, targets, n_sources, block_words)
    counts = slots.groupBy("s_no").agg(F.max("slots").alias("slots"))
    placed = lines.filter("size > 0 AND goal > 0").join(small(counts, n_sources), F.col("source_no") == F.col("s_no"))
    # epoch e of the line starts at word e * source_size of the stretch
    turns = placed.withColumn("epoch", F.explode(F.expr("sequence(0L, greatest(0L, (goal - 1) div source_size))")))
    turns = turns.withColumn("a", F.expr("epoch * source_size + start")).withColumn("b", F.expr("least(a + size, goal)")).filter("a < b")
    # equal blocks: the first `odd` of them hold one word more
    turns = turns.withColumn("wide", F.expr("goal div slots")).withColumn("odd", F.expr("goal % slots"))
    number = "IF({0} < odd * (wide + 1), {0} div (wide + 1), odd + ({0} - odd * (wide + 1)) div greatest(wide, 1L))"
    pieces = turns.withColumn("block", F.explode(F.sequence(F.expr(number.format("a")), F.expr(number.format("(b - 1)")))))
    pieces = pieces.withColumn("lo", F.expr("greatest(a, block * wide + least(block, odd))")).withColumn("hi", F.expr("least(b, (block + 1) * wide + least(block + 1, odd))"))
    pieces = pieces.filter("hi > lo").select("source_no", "start", "block", F.col("lo").alias("line_word"), (F.col("lo") - F.col("a")).alias("from_word"), (F.col("hi") - F.col("lo")).alias("words"))
    taken = slots.select("slot", F.col("s_no").alias("slot_s"), "rank")
    pieces = pieces.join(taken, (F.col("source_no") == F.col("slot_s")) & (F.col("block") == F.col("rank")))
    return lines, pieces.select("slot", F.col("source_no").alias("s_no"), "start", "line_word", "from_word", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, **names: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``, from the pieces of the schedule."""
    lines, pieces = schedule(docs, block_words, **names)
    taken = pieces.groupBy("s_no", F.col("start").alias("p_start")).agg(F.sum("words").alias("words"))
    mine = (F.col("source_no") == F.col("s_no")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("p_start"))
    out = lines.join(taken, mine, "left")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix holds them, for stages that need whole documents: a row as often as the mix takes it, a partly
    taken one if at least half of that turn is taken; columns unchanged."""
    size = word_count(F.col(text))
    got = mix(docs, block_words, doc_id=doc_id, text=text, source=source)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    got = got.groupBy(F.col("doc_id").alias("m_id"), F.col("size").alias("m_size")).agg(F.sum(times).alias("copies"), F.count(F.lit(1)).alias("rows"))
    got = cut(got.filter("copies > 0"), "copies")
    rows = packed(docs, own_id=F.col(doc_id), own_words=size)
    both = rows.join(got, F.col("own_id").eqNullSafe(F.col("m_id")) & (F.col("own_words") == F.col("m_size")))
    out = both.filter("rows = 1").withColumn("times", F.col("copies").cast("int"))
    if not got.filter("rows > 1").isEmpty():
        # rows equal in id and size: each gets its share of the turns, the first ones what is over
        equal = numbered(both.filter("rows > 1"), ["own_id", "own_words"], "equal_rows")
        equal = equal.withColumn("times", F.expr("copies div same + if(no < copies % same, 1, 0)").cast("int")).select(*out.columns)
        out = out.unionByName(equal.filter("times > 0"))
    return unpacked(out.withColumn("turn", F.explode(F.array_repeat(F.lit(1), F.col("times")))), docs)
