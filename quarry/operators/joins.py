"""Joins that SQL has no word for: intervals, prefixes, suffixes, first candidates, unique names, division.

Each is composed of equi-joins and pre-aggregations, so that Catalyst can shuffle, broadcast and split skew as it sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.plans.cuts import cut


#: Spans lie in cells of as many widths, each so many times the one before.
LEVELS, TIMES = 7, 8


def cells(start: Column, end: Column, width: int) -> Column:
    """Rows of (level, cell) that a span lies in: of the first level whose cells are at least as wide as it is long, so in two at most;
    spans longer than the widest cell, ``width * TIMES ** (LEVELS - 1)``, lie in as many of these as they cross."""
    level, wide = F.lit(LEVELS - 1), F.lit(width * TIMES ** (LEVELS - 1))
    for k in reversed(range(LEVELS - 1)):
        fits = end - start <= width * TIMES**k
        level, wide = F.when(fits, k).otherwise(level), F.when(fits, width * TIMES**k).otherwise(wide)
    return F.explode(F.transform(F.sequence(F.floor(start / wide), F.floor(end / wide)), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell"))))


def cells_at(at: Column, width: int) -> Column:
    """The cells around a point, one of each level."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(at / (width * TIMES**k)).alias("cell")) for k in range(LEVELS)]))


def around(points: DataFrame, spans: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """``points`` with ``s_start, s_end, span_id`` of each span ``(key, start, end, span_id)`` that holds them: an equi-join on cells. Spans
    become two rows, points one for each level, however long the spans are. Neither side is sent to the driver: sizes of files don't
    tell how many cells there are."""
    s = spans.select(F.col(key).alias("s_key"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "span_id", cells(F.col("start"), F.col("end"), width).alias("s_cell"))
    p = points.withColumn("p_cell", cells_at(F.col(at), width))
    same = (F.col(key) == F.col("s_key")) & (F.col("p_cell.level") == F.col("s_cell.level")) & (F.col("p_cell.cell") == F.col("s_cell.cell"))
    return p.join(s.hint("merge"), same & F.col(at).between(F.col("s_start"), F.col("s_end"))).drop("p_cell", "s_cell", "s_key")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, width: int = 64) -> DataFrame:
    """Each point ``(key, at, ...)`` with ``span_id`` of the innermost span ``(key, start, end, span_id)`` around it: the one
    that starts last, then ends first, then comes first by id; null if there is none."""
    hit = around(points.select(key, at).distinct(), spans, key, at, width)
    best = hit.groupBy(F.col(key).alias("b_key"), F.col(at).alias("b_at")).agg(F.min(F.struct((-F.col("s_start")).alias("late"), "s_end", "span_id")).alias("best"))
    return points.join(best.hint("merge"), (F.col(key) == F.col("b_key")) & (F.col(at) == F.col("b_at")), "left").select(*points.columns, F.col("best.span_id").alias("span_id"))


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """``range_id, span_id, start, end`` (the span's) of every range and span of a key that share a point. Either the range begins in the
    span, or the span begins in the range, later than it: two looks for the spans around points."""
    first = around(ranges.select(key, "range_id", F.col("start").alias("at")), spans, key, "at", width).select("range_id", "span_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    held = ranges.select(key, "start", "end", F.col("range_id").alias("span_id"))
    then = around(spans.select(key, F.col("span_id").alias("own"), F.col("start").alias("at"), F.col("end").alias("own_end")), held, key, "at", width).filter("at > s_start AND own_end >= at")
    return first.unionByName(then.select(F.col("span_id").alias("range_id"), F.col("own").alias("span_id"), F.col("at").alias("start"), F.col("own_end").alias("end")))


def innermost(pairs: DataFrame) -> DataFrame:
    """Of ``pairs (range_id, span_id, start, end)`` those whose span holds no other span of the same range; of equal ones the last by id.
    In order of start, the widest first, a span holds another if one after it ends no later: a range's spans are sorted, not paired."""
    after = Window.partitionBy("range_id").orderBy("start", F.desc("end"), "span_id").rowsBetween(1, Window.unboundedFollowing)
    least = F.min("end").over(after)
    return pairs.withColumn("least", least).filter(F.col("least").isNull() | (F.col("least") > F.col("end"))).select("range_id", "span_id")


def residual(lines: DataFrame, spans: DataFrame, key: str, at: str = "line", width: int = 64) -> DataFrame:
    """The lines that no span covers."""
    named = spans.select(key, "start", "end", F.lit(0).alias("span_id"))
    covered = around(lines.select(key, at).distinct(), named, key, at, width).select(F.col(key).alias("c_key"), F.col(at).alias("c_at")).distinct()
    return lines.join(covered.hint("merge"), (F.col(key) == F.col("c_key")) & (F.col(at) == F.col("c_at")), "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, width: int) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its key at or before it. The last of each bucket of ``width``
    is carried forward over buckets by a window of one row a bucket, so no key's rows ever meet in one task."""
    r = right.select(F.col(key).alias("k"), F.floor(F.col(at) / width).alias("b"), F.col(at).alias("r_at"), F.col(value).alias("r_value"))
    last = r.groupBy("k", "b").agg(F.max(F.struct("r_at", "r_value")).alias("last"))
    buckets = last.select("k", "b").unionByName(left.select(F.col(key).alias("k"), F.floor(F.col(at) / width).alias("b"))).distinct().join(last, ["k", "b"], "left")
    before = buckets.withColumn("prior", F.last("last", True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("k").alias("p_k"), F.col("b").alias("p_b"), "prior")
    rows = left.withColumn("l_b", F.floor(F.col(at) / width))
    near = rows.select(key, at, "l_b").distinct().join(r, (F.col(key) == F.col("k")) & (F.col("l_b") == F.col("b")) & (F.col("r_at") <= F.col(at)), "left")
    near = near.groupBy(F.col(key).alias("n_k"), F.col(at).alias("n_at"), "l_b").agg(F.max(F.struct("r_at", "r_value")).alias("own")).withColumnRenamed("l_b", "n_b")
    near = near.join(before, (F.col("n_k") == F.col("p_k")) & (F.col("n_b") == F.col("p_b")), "left").select("n_k", "n_at", F.when(F.col("own.r_at").isNotNull(), F.col("own.r_value")).otherwise(F.col("prior.r_value")).alias(value + "_as_of"))
    return left.join(near, (F.col(key) == F.col("n_k")) & (F.col(at) == F.col("n_at")), "left").drop("n_k", "n_at")


def path_prefixes(path: Column) -> Column:
    """The path and each folder above it, longest first, then the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def path_suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with the longest of ``prefixes`` that is its path or a folder above it: an equi-join on exploded prefixes."""
    steps = rows.select(F.col(path).alias("p_path")).distinct().select("p_path", F.posexplode(path_prefixes(F.col("p_path"))).alias("up", "p_prefix"))
    hit = steps.join(prefixes.select(F.col(prefix).alias("known")).distinct(), F.col("p_prefix") == F.col("known"))
    best = hit.groupBy("p_path").agg(F.min(F.struct("up", "known")).alias("b")).select("p_path", F.col("b.known").alias("owner"))
    return rows.join(best, F.col(path) == F.col("p_path"), "left").drop("p_path")


def unique_suffix(wanted: DataFrame, suffix: str, files: DataFrame, path: str) -> DataFrame:
    """Each wanted suffix with the one file that ends in it; null if none or several do."""
    ends = files.select(F.col(path).alias("f_path"), F.explode(path_suffixes(F.col(path))).alias("end"))
    one = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("f_path").alias("file")).filter("n = 1")
    return wanted.join(one.select("end", "file"), F.col(suffix) == F.col("end"), "left").drop("end")


def first_candidate(wanted: DataFrame, key: str, candidates: str, files: DataFrame, path: str) -> DataFrame:
    """``key, file``: the first of an array of candidates that exists."""
    tries = wanted.select(key, F.posexplode(candidates).alias("pos", "cand"))
    hit = tries.join(files.select(F.col(path).alias("f")).distinct(), F.col("cand") == F.col("f"))
    return hit.groupBy(key).agg(F.min(F.struct("pos", "f")).alias("b")).select(key, F.col("b.f").alias("file"))


def resolve_names(intents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bind each intent ``(intent, name, file, family)`` to a node ``(id, name, file, family)``: the only one of that name in the
    file (``extracted``), else the only reachable one anywhere (``inferred``), else ``ambiguous`` or ``missing``. Families that are
    both known and differ don't reach each other; an unknown one reaches all.

    Counts of names are joined, not nodes: a name that half the corpus defines is one row for each file and family."""
    by_file = nodes.groupBy(F.col("name").alias("f_name"), F.col("file").alias("f_file")).agg(F.count(F.lit(1)).alias("in_file"), F.min("id").alias("file_id"))
    by_family = nodes.groupBy(F.col("name").alias("g_name"), F.col("family").alias("g_family")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("g_id"))
    by_name = by_family.groupBy("g_name").agg(F.sum("n").alias("all_n"), F.min("g_id").alias("all_id"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("g_family", F.lit("")).alias("k"), F.struct("n", "g_id").alias("v")))).alias("fam"))
    # counts of a written table take many times its files' bytes: not broadcast
    rows = intents.join(by_file.hint("merge"), (F.col("name") == F.col("f_name")) & (F.col("file") == F.col("f_file")), "left").join(by_name.hint("merge"), F.col("name") == F.col("g_name"), "left")
    own, free = F.try_element_at(F.col("fam"), F.coalesce("family", F.lit("-"))), F.try_element_at(F.col("fam"), F.lit(""))
    known = F.col("family").isNotNull()
    n = F.when(known, F.coalesce(own["n"], F.lit(0)) + F.coalesce(free["n"], F.lit(0))).otherwise(F.coalesce("all_n", F.lit(0)))
    found = F.when(known, F.coalesce(own["g_id"], free["g_id"])).otherwise(F.col("all_id"))
    how = F.when(F.col("in_file") == 1, "extracted").when(n == 1, "inferred").when(n > 1, "ambiguous").otherwise("missing")
    target = F.when(F.col("in_file") == 1, F.col("file_id")).when(n == 1, found)
    return rows.select(*[F.col(c) for c in intents.columns], how.alias("outcome"), target.alias("target"))


def typed_members(intents: DataFrame, members: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """Bind ``(intent, type, method, args)`` to ``members (id, type, method, arity)`` of the type or the nearest of its supertypes
    ``parents (type, parent)``, up to ``depth`` levels. Members whose arity fits are preferred; if none fits all stay. One left
    binds, several of one level are ``ambiguous``: ``intent, target, level, outcome``. Each question (type, method, args) is answered
    once for all its intents, from counts of members, so neither side's rows meet the other's."""
    asks = intents.select("type", "method", "args").distinct()
    level = asks.select("type", "method", "args", F.col("type").alias("at"), F.lit(0).cast("long").alias("level"))
    tries = level
    up = parents.select(F.col("type").alias("p_type"), "parent")
    for d in range(1, depth + 1):
        level = level.join(up, F.col("at") == F.col("p_type")).select("type", "method", "args", F.col("parent").alias("at"), F.lit(d).cast("long").alias("level")).distinct()
        tries = tries.unionByName(level)
    # a row for each type's method, with what each arity has: members are counted before they are joined
    by_arity = members.groupBy(F.col("type").alias("m_type"), F.col("method").alias("m_method"), "arity").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m_id"))
    free = F.col("arity").isNull()
    held = F.map_from_entries(F.collect_list(F.when(~free, F.struct(F.col("arity").alias("k"), F.struct("n", "m_id").alias("v")))))
    m = by_arity.groupBy("m_type", "m_method").agg(F.sum("n").alias("all_n"), F.min("m_id").alias("all_id"), F.sum(F.when(free, F.col("n"))).alias("free_n"), F.min(F.when(free, F.col("m_id"))).alias("free_id"), held.alias("held"))
    hit = tries.join(m, (F.col("at") == F.col("m_type")) & (F.col("method") == F.col("m_method"))).withColumn("own", F.try_element_at("held", "args"))
    fit_n, fit_id = F.coalesce("free_n", F.lit(0)) + F.coalesce("own.n", F.lit(0)), F.least("free_id", "own.m_id")
    best = hit.groupBy("type", "method", "args", "level").agg(F.sum(fit_n).alias("n_fit"), F.min(fit_id).alias("fit"), F.sum("all_n").alias("n"), F.min("all_id").alias("any_id"))
    best = best.select("type", "method", "args", "level", F.when(F.col("n_fit") > 0, F.col("n_fit")).otherwise(F.col("n")).alias("n"), F.when(F.col("n_fit") > 0, F.col("fit")).otherwise(F.col("any_id")).alias("one"))
    near = best.groupBy(F.col("type").alias("b_type"), F.col("method").alias("b_method"), F.col("args").alias("b_args")).agg(F.min(F.struct("level", "n", "one")).alias("b"))
    # both sides may be many, and orders of magnitude more than their files' sizes tell: never sent to the driver
    bound = intents.join(near.hint("merge"), (F.col("type") == F.col("b_type")) & (F.col("method") == F.col("b_method")) & F.col("args").eqNullSafe(F.col("b_args")))
    return bound.select("intent", F.when(F.col("b.n") == 1, F.col("b.one")).alias("target"), F.col("b.level").alias("level"), F.when(F.col("b.n") == 1, "bound").otherwise("ambiguous").alias("outcome"))


def division(have: DataFrame, owner: str, need: DataFrame, group: str, on: list[str]) -> DataFrame:
    """``owner, group``: the owners that have every row a group needs, and groups that need something at all."""
    wanted = need.select(group, *on).distinct()
    total = wanted.groupBy(F.col(group).alias("t_group")).agg(F.count(F.lit(1)).alias("all_n"))
    own = have.select(owner, *on).distinct().join(wanted, on).groupBy(owner, group).agg(F.count(F.lit(1)).alias("n"))
    return own.join(total, F.col(group) == F.col("t_group")).filter("n = all_n").select(owner, group)


def type_methods(nodes: DataFrame) -> DataFrame:
    """``type, path, methods, first``: how many methods each type has in a file, and the first of them by id."""
    own = nodes.filter("owner IS NOT NULL")
    return own.groupBy(F.col("owner").alias("type"), "path").agg(F.count(F.lit(1)).alias("methods"), F.min("id").alias("first"))


def hit_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Search hits ``(title, pointer)`` with the node ``(id, name, path)`` that each shows; a hit that none matches keeps a null id."""
    own = nodes.select("id", F.col("name").alias("n_name"), F.col("path").alias("n_path"))
    return hits.join(own, (F.col("title") == F.col("n_name")) & (F.col("pointer") == F.col("n_path")), "left").drop("n_name", "n_path")


def chained_members(intents: DataFrame, fields: DataFrame, members: DataFrame, embeds: DataFrame, longest: int = 4, depth: int = 3) -> DataFrame:
    """Bind ``(intent, type, chain, method, args)``, a call through a chain of fields, to ``members (id, type, method, arity)``: each field
    of ``fields (type, field, to)`` leads to its type, also where it is promoted from an embedded one (``embeds (type, parent)``, up to
    ``depth`` levels, the shallowest wins); then the method is looked for likewise. ``intent, target, outcome``; a chain with an
    unknown or ambiguous step, or of more than ``longest``, binds nothing and gives no row."""
    steps = fields.select(F.col("to").alias("id"), "type", F.col("field").alias("method"), F.lit(None).cast("long").alias("arity"))
    at = intents.filter(F.size("chain") <= longest).select("intent", "type", "chain", "method", "args")
    for k in range(longest):
        asked = at.filter(F.size("chain") > k).select("intent", "type", F.col("chain")[k].alias("method"), F.lit(None).cast("long").alias("args"))
        led = typed_members(asked, steps, embeds, depth).filter("outcome = 'bound'").select(F.col("intent").alias("l_intent"), F.col("target").alias("next"))
        at = at.join(led, F.col("intent") == F.col("l_intent"), "left").filter((F.size("chain") <= k) | F.col("next").isNotNull())
        at = cut(at.select("intent", F.coalesce("next", "type").alias("type"), "chain", "method", "args"), "chained")
    return typed_members(at.select("intent", "type", "method", "args"), members, embeds, depth).select("intent", "target", "outcome")


def package_members(intents: DataFrame, declared: DataFrame) -> DataFrame:
    """Bind ``(intent, dir, name, by_test)``, a name of a package's folder, to ``declared (id, dir, name, in_test)``: the only one there;
    what a test file declares is seen by test files only. ``intent, target, outcome``."""
    own = declared.select("id", F.col("dir").alias("d_dir"), F.col("name").alias("d_name"), "in_test")
    counts = own.groupBy("d_dir", "d_name").agg(*[x for tests, n in ((False, "a"), (True, "b")) for x in (F.count(F.when(F.lit(tests) | ~F.col("in_test"), 1)).alias(f"n_{n}"), F.min(F.when(F.lit(tests) | ~F.col("in_test"), F.col("id"))).alias(f"id_{n}"))])
    rows = intents.join(counts, (F.col("dir") == F.col("d_dir")) & (F.col("name") == F.col("d_name")), "left")
    n, one = F.coalesce(F.when(F.col("by_test"), F.col("n_b")).otherwise(F.col("n_a")), F.lit(0)), F.when(F.col("by_test"), F.col("id_b")).otherwise(F.col("id_a"))
    return rows.select("intent", F.when(n == 1, one).alias("target"), F.when(n == 1, "bound").when(n > 1, "ambiguous").otherwise("missing").alias("outcome"))
