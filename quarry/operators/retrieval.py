"""What stands around ranked search: pooled file scores, dispatch tables, edit context, budgets, batches of reads, baselines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import graph as G
from quarry.operators.search import COPY_PENALTY, GRAPH_WEIGHT
from quarry.plans.cuts import cut

#: Weak matches, small scopes, groups of a report, budgets in tokens, and the least overlap of a relevant prompt.
WEAK_STRONG, WEAK_BROAD, LEAST_SCOPE, GROUPS = 0.1, 0.5, 5, 5
BUDGET, LEAST_BUDGET, MOST_BUDGET, DISPATCH = 2_000, 128, 64_000, 3
#: Bytes up to which what interfaces ask for is broadcast, and what one method of one takes.
BROADCAST_BYTES, ASKED_BYTES = 32 << 20, 512
#: Neighbours of seeds that a task holds, at most about.
ROWS = 1 << 19


def limit_of(value: float | None, default: int = 8) -> int | None:
    """How many rows a limit asks for, by the rules of a loosely typed number: NaN is 0, a fraction is cut off, infinity is no
    limit (None), less than 0 counts from the end (a negative number)."""
    if value is None:
        return default
    if math.isnan(value):
        return 0
    return None if math.isinf(value) and value > 0 else 0 if math.isinf(value) else math.trunc(value)


def limited(rows: list, value: float | None, default: int = 8) -> list:
    n = limit_of(value, default)
    return rows if n is None else rows[:n]


def pooled_files(hits: DataFrame, matched: DataFrame, idf: DataFrame) -> DataFrame:
    """``file, id, pooled``: each file's hits taken together. ``hits (id, file, lex, coverage, rank, copy)`` with lex over the
    largest, ``matched (id, term)``, ``idf (term, idf)`` of the whole query. The anchor is the hit of the largest lex; the idf
    share of all the file's terms beyond the anchor's lifts it: residual = cov * (union - cov) / union, within 0 and 1."""
    total = idf.agg(F.sum("idf").alias("total"))
    file_of = hits.select(F.col("id").alias("h_id"), "file")
    terms = matched.join(file_of, F.col("id") == F.col("h_id")).select("file", "term").distinct().join(idf, "term")
    union = terms.groupBy(F.col("file").alias("u_file")).agg(F.sum("idf").alias("have"))
    order = F.struct((-F.col("lex")).alias("l"), (-F.col("coverage")).alias("c"), "id", "rank", "copy")
    anchor = hits.groupBy("file").agg(F.min(order).alias("a")).select("file", F.col("a.id").alias("id"), (-F.col("a.l")).alias("lex"), (-F.col("a.c")).alias("cov"), F.col("a.rank").alias("rank"), F.col("a.copy").alias("copy"))
    rows = anchor.join(union, F.col("file") == F.col("u_file")).join(F.broadcast(total)).withColumn("union", F.col("have") / F.col("total"))
    residual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cov") * (F.col("union") - F.col("cov")) / F.col("union")))
    pooled = (F.col("lex") + (1 - F.col("lex")) * residual + GRAPH_WEIGHT * F.coalesce("rank", F.lit(0.0))) * F.when(F.col("copy"), COPY_PENALTY).otherwise(1.0)
    return rows.select("file", "id", pooled.alias("pooled"))


def weak(hits: DataFrame) -> DataFrame:
    """``hits (id, strong, coverage)`` with ``weak``: the name holds less than a tenth of the query, the whole less than half."""
    return hits.withColumn("weak", (F.col("strong") < WEAK_STRONG) & (F.col("coverage") < WEAK_BROAD))


def dispatch_table(edges: DataFrame) -> DataFrame:
    """``interface, implementations``: those of three or more are shown by their signature only."""
    own = edges.filter("relation = 'implements'").select("source", "target").distinct()
    return own.groupBy(F.col("target").alias("interface")).agg(F.count(F.lit(1)).alias("implementations")).filter(F.col("implementations") >= DISPATCH)


def edit_context(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, each: int = 2) -> DataFrame:
    """``seed, group, other, place``: each seed's direct neighbours, as tests, callers and dependencies, the first ``each`` of every
    group in stored order. ``nodes (id, is_test)``."""
    walk = G.walkable(edges)
    n = seeds.count()
    parts = max(1, math.ceil(2 * walk.count() / ROWS))  # an edge is near both its ends
    ends = lambda here, there, into: walk.select(F.col(here).alias("here"), F.col(there).alias("other"), "ord", F.lit(into).alias("into"))
    near = ends("target", "source", True).unionByName(ends("source", "target", False))
    near = G.met(near, seeds, n) if n <= G.FEW else G.marked(near, seeds)
    # a hub's rows pass by the nodes unsorted, and are dealt by both ends before any is held
    tests = nodes.select(F.col("id").alias("n_id"), "is_test").hint("shuffle_hash")
    rows = near.join(tests, F.col("other") == F.col("n_id"), "left")
    group = F.when(F.col("is_test"), "test").when(F.col("into"), "caller").otherwise("dependency")
    rows = rows.select(F.col("here").alias("seed"), group.alias("group"), "other", "ord").repartition(parts, "seed", "other")
    rows = rows.groupBy("seed", "group", "other").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("seed", "group").orderBy("ord", "other")
    first = rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= each).drop("ord")
    return first if n <= G.FEW else first.join(seeds.select(F.col("id").alias("s_id")).hint("shuffle_hash"), F.col("seed") == F.col("s_id"), "left_semi")


def suppressed(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """``hits (ref, code)`` with the code of references in ``seen (ref)`` blanked; rows stay."""
    known = seen.select(F.col("ref").alias("s_ref"), F.lit(True).alias("known")).distinct()
    return hits.join(known, F.col("ref") == F.col("s_ref"), "left").withColumn("code", F.when(F.col("known"), F.lit(None)).otherwise(F.col("code"))).drop("s_ref", "known")


def baseline(hits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: what reading the hits' files whole would cost, against the hits. ``hits (file, chars)``, ``files (file, chars)``."""
    own = hits.groupBy("file").agg(F.sum("chars").alias("shown"))
    both = own.join(files.select(F.col("file").alias("f"), F.col("chars").alias("whole")), F.col("file") == F.col("f"))
    return both.agg(F.count(F.lit(1)).alias("files"), F.sum("shown").alias("shown"), F.sum("whole").alias("whole"), F.sum(F.greatest(F.lit(0), F.col("whole") - F.col("shown"))).alias("saved"))


def folded_scopes(members: DataFrame, least: int = LEAST_SCOPE) -> DataFrame:
    """``scope, n``: scopes of fewer than ``least`` members are counted with the root, the empty scope."""
    n = members.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.when(F.col("n") >= least, F.col("scope")).otherwise("").alias("scope")).agg(F.sum("n").alias("n"))


def split_folders(files: DataFrame) -> DataFrame:
    """``dir, files``: files by first folder, the root's as ``(root)``; a folder with more than 60 % of all is split a level deeper."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    first = F.when(depth > 1, F.concat(parts[0], F.lit("/"))).otherwise("(root)")
    second = F.when(depth > 2, F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))).otherwise(first)
    rows = files.select("path").distinct().select(first.alias("first"), second.alias("second"))
    n = rows.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    by_first = n.groupBy(F.col("first").alias("f")).agg(F.sum("n").alias("own"))
    total = n.agg(F.sum("n").alias("total"))
    both = n.join(by_first, F.col("first") == F.col("f")).join(F.broadcast(total))
    key = F.when(F.col("own") * 10 > F.col("total") * 6, F.col("second")).otherwise(F.col("first"))
    return both.groupBy(key.alias("dir")).agg(F.sum("n").alias("files"))


def symbol_search(nodes: DataFrame, degree: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The ``n`` symbols a text finds: equal names, then names that begin with it, then names that hold it; copies behind, then by
    degree, name and id. ``nodes (id, name, copy)``, ``degree (id, in_degree)``."""
    low, t = F.lower("name"), text.lower()
    cls = F.when(low == t, 0).when(low.startswith(t), 1).when(low.contains(t), 2)
    rows = nodes.withColumn("match", cls.cast("long")).filter("match IS NOT NULL").join(degree.withColumnRenamed("id", "d_id"), F.col("id") == F.col("d_id"), "left")
    rows = rows.withColumn("degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    return rows.orderBy("match", "copy", F.desc("degree"), "name", "id").limit(n).select("id", "name", "match", "degree")


def freshness(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """One row: files, and how many of them the index lacks."""
    have = indexed.select(F.col("path").alias("i_path")).distinct().withColumn("i", F.lit(1))
    return present.join(have, F.col("path") == F.col("i_path"), "left").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("i").isNull(), 1)).alias("missing"))


def batch_status(selected: DataFrame) -> DataFrame:
    """``selected (batch, pick, path, start, end)`` with ``status``: ``covered`` where an earlier pick of the batch, or an equal or
    wider one, holds the span, ``ok`` otherwise. In order of start, the widest and earliest first, a span is held by another if
    one before it ends no earlier: picks are sorted, not paired."""
    before = Window.partitionBy("batch", "path").orderBy("start", F.desc("end"), "pick").rowsBetween(Window.unboundedPreceding, -1)
    return selected.withColumn("status", F.when(F.max("end").over(before) >= F.col("end"), "covered").otherwise("ok"))


def satisfied(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``type, interface``: types that have every method the interface asks for, alike in arity and in being variadic, and in the
    number of results where both are known; methods that aren't exported count within one folder only. Both sides are
    ``(owner, dir, method, arity, variadic, results, exported)``; an interface with a method of unknown arity is skipped."""
    need = interfaces.select(F.col("owner").alias("interface"), F.col("dir").alias("i_dir"), "method", "arity", "variadic", F.col("results").alias("i_results"), F.col("exported").alias("i_exported")).distinct()
    vague = need.filter("arity IS NULL").select(F.col("interface").alias("v")).distinct()
    need = need.join(vague, F.col("interface") == F.col("v"), "left_anti")
    total = need.groupBy(F.col("interface").alias("t")).agg(F.count(F.lit(1)).alias("all_n"))
    shape = ["method", "arity", "variadic"]
    asked = cut(need.groupBy("interface", *shape).agg(F.collect_set(F.struct("i_results", "i_exported", "i_dir")).alias("asked")), "asked")
    if asked.count() * ASKED_BYTES <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    # a type's methods lie together from here on, each manner once, so that what is held for a type is a count an interface
    have = types.repartition("owner").groupBy("owner", *shape).agg(F.collect_set(F.struct("results", "dir")).alias("have"))
    fits = lambda h, a: (h["results"].isNull() | a["i_results"].isNull() | (h["results"] == a["i_results"])) & (a["i_exported"] | (h["dir"] == a["i_dir"]))
    hit = have.join(asked, shape).filter(F.exists("have", lambda h: F.exists("asked", lambda a: fits(h, a))))
    got = hit.groupBy("owner", "interface").agg(F.count(F.lit(1)).alias("n"))
    return got.join(total, F.col("interface") == F.col("t")).filter("n = all_n").select(F.col("owner").alias("type"), "interface")


def coarsened(groups: dict[str, int], most: int = GROUPS) -> dict[str, int]:
    """A report's folders folded into their parents, deepest first, until no more than ``most`` are left."""
    out = dict(groups)
    while len(out) > most:
        deepest = max(out, key=lambda p: (p.count("/"), p))
        parent = deepest.rpartition("/")[0] or "."
        if parent == deepest:
            break
        n = out.pop(deepest)
        out[parent] = out.get(parent, 0) + n
    return out


def cut_to_budget(hits: list[dict], budget: int = BUDGET) -> list[dict]:
    """A ranked list whose ``code`` and ``doc`` fit a budget in tokens (four characters each): from the last hit on, code is
    halved, then dropped, then the doc, then the hit; the first hit keeps its place."""
    budget = max(LEAST_BUDGET, min(MOST_BUDGET, budget))
    out = [dict(h) for h in hits]
    cost = lambda: sum((len(h.get("code") or "") + len(h.get("doc") or "") + len(h["id"]) + 2) // 4 for h in out)
    k = len(out) - 1
    while cost() > budget and k >= 0:
        h = out[k]
        if len(h.get("code") or "") > 80:
            h["code"] = h["code"][: len(h["code"]) // 2]
        elif h.get("code"):
            h["code"] = None
        elif h.get("doc"):
            h["doc"] = None
        else:
            if k:
                out.pop(k)
            k -= 1
    return out


def relevant(prompt: list[str], top_name: list[str], is_weak: bool) -> bool:
    """Whether a prompt is worth an answer: not weak, and it shares a term of three letters or more with the top hit's name."""
    return not is_weak and bool({t for t in prompt if len(t) >= 3} & set(top_name))
