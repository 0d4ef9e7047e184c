"""Analyses of a graph and its history: hotspots, dead code, owners, blast radius, drift, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import joins as J

#: Half-life and shares of ownership, reports' lengths, and names that runtimes call by themselves.
HALF_LIFE_MS, LEAST_SHARE, PER_AREA, REVIEWERS, AFFECTED = 120 * 86_400_000, 0.15, 2, 3, 0.6
HOTSPOTS, COMPLEX = 15, 20
RUNTIME_NAMES = (
    "String Error GoString Format Unwrap Is As MarshalJSON UnmarshalJSON MarshalText UnmarshalText MarshalBinary UnmarshalBinary "
    "MarshalYAML UnmarshalYAML ServeHTTP Read Write Close Seek ReadFrom WriteTo Len Less Swap Scan Value Lock Unlock toString equals "
    "hashCode compareTo run call close iterator apply accept toJSON render componentDidMount componentDidUpdate componentWillUnmount "
    "ngOnInit ngOnDestroy setUp tearDown setUpClass tearDownClass fmt drop from deref eq cmp partial_cmp hash clone default next poll"
).split()
#: How bots are named (fixed values).
BOT_NAME, BOT_MAIL, BOT_KNOWN = r"(?i)\[bot\]", r"(?i)\[bot\]@", r"(?i)^(github-actions|dependabot|renovate)(\[bot\])?$"


def churn(commits: DataFrame) -> DataFrame:
    """``path, commits``: how many commits touched each path."""
    return commits.groupBy("path").agg(F.count_distinct("hash").alias("commits"))


def hotspots(churned: DataFrame, complexity: DataFrame) -> DataFrame:
    """``path, commits, complexity, score``: round(100 * commits / most * complexity / most) of paths that have both."""
    both = churned.join(complexity, "path")
    top = both.agg(F.max("commits").alias("mc"), F.max("complexity").alias("mx"))
    score = F.round(100.0 * (F.col("commits") / F.col("mc")) * (F.col("complexity") / F.col("mx")))
    return both.join(F.broadcast(top)).select("path", "commits", "complexity", score.cast("long").alias("score"))


def top_hotspots(spots: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    return spots.orderBy(F.desc("score"), F.desc("commits"), "path").limit(n)


def is_bot(name: Column, mail: Column) -> Column:
    return name.rlike(BOT_NAME) | mail.rlike(BOT_MAIL) | F.trim(name).rlike(BOT_KNOWN)


def ownership(commits: DataFrame, now_ms: int | Column) -> DataFrame:
    """``area, person, score, commits, last_ms`` of ``commits (area, person, hash, at_ms)``: a commit weighs half as much every 120
    days and counts once for a person and area however many files it touched."""
    once = commits.groupBy("area", "person", "hash").agg(F.max("at_ms").alias("at_ms"))
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    weight = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (now - F.col("at_ms")) / F.lit(float(HALF_LIFE_MS))))
    return once.groupBy("area", "person").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("commits"), F.max("at_ms").alias("last_ms"))


def owners(scores: DataFrame, n: int = PER_AREA) -> DataFrame:
    """Each area's first ``n`` owners with a share of LEAST_SHARE or more: ``area, person, share, place``."""
    from pyspark.sql.window import Window

    total = scores.groupBy(F.col("area").alias("t_area")).agg(F.sum("score").alias("total"))
    own = scores.join(total, F.col("area") == F.col("t_area")).withColumn("share", F.col("score") / F.col("total")).filter(F.col("share") >= LEAST_SHARE)
    w = Window.partitionBy("area").orderBy(F.desc("score"), F.desc("commits"), "person")  # at most 1 / LEAST_SHARE rows each
    return own.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n).select("area", "person", "share", "place")


def reviewers(scores: DataFrame, changed: DataFrame, affected: DataFrame, n: int = REVIEWERS) -> DataFrame:
    """The ``n`` people with the most weight in changed areas (1) and affected ones (0.6): ``person, weight``."""
    areas = changed.select("area", F.lit(1.0).alias("w")).unionByName(affected.select("area", F.lit(AFFECTED).alias("w"))).groupBy("area").agg(F.max("w").alias("w"))
    own = scores.join(areas, "area").groupBy("person").agg(F.sum(F.col("score") * F.col("w")).alias("weight"))
    return own.orderBy(F.desc("weight"), "person").limit(n)


def used_ids(edges: DataFrame) -> DataFrame:
    """What something uses: targets of calls and references, and sources of implements."""
    a = edges.filter(F.col("relation").isin("calls", "references", "writes", "imports")).select(F.col("target").alias("u_id"))
    return a.unionByName(edges.filter("relation = 'implements'").select(F.col("source").alias("u_id"))).distinct()


def excluded(nodes: DataFrame) -> Column:
    """Why a symbol is never listed as dead; tested in this order, null if it may be."""
    name = F.col("name")
    entry = name.isin("main", "constructor") | ((name == "init") & F.col("path").endswith(".go")) | (name.startswith("__") & name.endswith("__"))
    return F.when(F.col("generated"), "generated").when(F.col("copy"), "copy").when(entry, "entry point").when(name.isin(*RUNTIME_NAMES), "runtime").when(F.col("kind") == "interface", "interface")


def dead_symbols(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, mentions: DataFrame) -> DataFrame:
    """``id, confidence, rule`` of symbols ``nodes (id, name, kind, path, generated, copy, exported, decorated)`` nothing uses.
    Low confidence while something suggests an unseen caller, by the first rule that holds: a use of the name that couldn't be
    bound (``unresolved (name)``), a twin of the name that is used, a decorator, ``overriding`` (if ``nodes`` tells), the name written elsewhere
    (``mentions (name, n)`` beyond its own definition); medium for what other code may reach; high otherwise."""
    used = used_ids(edges)
    may = nodes.withColumn("why", excluded(nodes)).filter("why IS NULL")
    dead = may.join(used, F.col("id") == F.col("u_id"), "left_anti")
    twins = nodes.join(used, F.col("id") == F.col("u_id"), "left_semi").select(F.col("name").alias("t_name"), F.lit(True).alias("twin")).distinct()
    loose = unresolved.select(F.col("name").alias("x_name"), F.lit(True).alias("loose")).distinct()
    rows = dead.join(twins, F.col("name") == F.col("t_name"), "left").join(loose, F.col("name") == F.col("x_name"), "left").join(mentions.select(F.col("name").alias("m_name"), F.col("n").alias("times")), F.col("name") == F.col("m_name"), "left")
    rule = F.when(F.col("loose"), "unresolved").when(F.col("twin"), "twin").when(F.col("decorated"), "decorated").when(F.col("overriding") if "overriding" in nodes.columns else F.lit(False), "overriding").when(F.coalesce("times", F.lit(0)) > 1, "mentioned").when(F.col("exported"), "exported").otherwise("unused")
    level = F.when(rule == "unused", "high").when(rule == "exported", "medium").otherwise("low")
    return rows.select("id", "name", level.alias("confidence"), rule.alias("rule"))


def dead_exclusions(nodes: DataFrame) -> DataFrame:
    """``reason, n``: how many symbols are left out, by the first reason that holds."""
    return nodes.select(excluded(nodes).alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def mention_counts(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``name, n, n_lines``: how often each of ``names (name)`` is written as an identifier, and on how many lines."""
    words = lines.select("id", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_$\x{80}-\x{10FFFF}]+"), F.lit(0))).alias("w"))
    own = words.join(names.select(F.col("name").alias("n_name")).distinct(), F.col("w") == F.col("n_name"), "left_semi")
    each = own.groupBy("w", "id", "line").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy(F.col("w").alias("name")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_lines"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, status``: added, removed or changed between two states ``(path, size, body_hash)``; equal ones are left out."""
    b = before.select(F.col("path").alias("b_path"), F.col("size").alias("b_size"), F.col("body_hash").alias("b_hash"))
    a = after.select(F.col("path").alias("a_path"), F.col("size").alias("a_size"), F.col("body_hash").alias("a_hash"))
    same = (F.col("b_size") == F.col("a_size")) & F.col("b_hash").eqNullSafe(F.col("a_hash"))
    status = F.when(F.col("b_path").isNull(), "added").when(F.col("a_path").isNull(), "removed").when(~same, "changed")
    return b.join(a, F.col("b_path") == F.col("a_path"), "full_outer").select(F.coalesce("b_path", "a_path").alias("path"), status.alias("status")).filter("status IS NOT NULL")


def check_summary(changes: DataFrame, failed: int = 0) -> DataFrame:
    """One row: counts by status, and whether nothing changed and nothing failed."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(n("added"), n("removed"), n("changed")).withColumn("ok", (F.col("added") + F.col("removed") + F.col("changed") + failed) == 0)


def carry_over(edges: DataFrame, before: DataFrame, after: DataFrame, file_of: DataFrame) -> DataFrame:
    """Edges of an earlier state that still hold: both ends' files ``file_of (id, path)`` are there and unchanged."""
    kept = before.join(after, ["path", "body_hash"], "left_semi").select("path")
    own = file_of.join(kept, "path", "left_semi").select(F.col("id").alias("k_id"))
    return edges.join(own, F.col("source") == F.col("k_id"), "left_semi").join(own, F.col("target") == F.col("k_id"), "left_semi")


def blast_seeds(changes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``range_id, span_id``: the symbols a changed range touches, but for those that hold another touched one; a range that
    touches none has its file as the seed (``span_id`` null)."""
    hit = J.innermost(J.overlapping(changes, spans, key))
    return changes.select("range_id").join(hit, "range_id", "left")


def blast_modules(reach: DataFrame, nodes: DataFrame, dir_of: Column) -> DataFrame:
    """Dependents by directory: ``dir, dependents, nearest``. ``reach (id, depth)``."""
    at = nodes.select(F.col("id").alias("n_id"), dir_of.alias("dir"))
    return reach.join(at, F.col("id") == F.col("n_id")).groupBy("dir").agg(F.count(F.lit(1)).alias("dependents"), F.min("depth").alias("nearest"))


def area_signal(changed: DataFrame, edges: DataFrame, is_test: DataFrame) -> DataFrame:
    """Per area of ``changed (id, area, callable, changed_test)``: how its changed symbols are tested: ``na`` (nothing callable
    changed), ``changed`` (a test changed too), ``stale`` (a test reaches it) or ``none``. ``is_test (id)``."""
    tested = edges.join(is_test.select(F.col("id").alias("t_id")), F.col("source") == F.col("t_id"), "left_semi").select(F.col("target").alias("r_id"), F.lit(True).alias("reached")).distinct()
    rows = changed.join(tested, F.col("id") == F.col("r_id"), "left")
    agg = rows.groupBy("area").agg(F.count(F.lit(1)).alias("symbols"), F.max("callable").alias("c"), F.max("changed_test").alias("t"), F.count("reached").alias("reached"))
    return agg.select("area", "symbols", "reached", F.when(~F.col("c"), "na").when(F.col("t"), "changed").when(F.col("reached") > 0, "stale").otherwise("none").alias("signal"))


def score_facts(actual: DataFrame, expected: DataFrame, by: str = "relation") -> DataFrame:
    """``relation, tp, fp, fn, duplicates, precision, recall`` of facts (source, relation, target); null over nothing."""
    keys = ["source", "relation", "target"]
    a = actual.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).withColumn("a", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    both = a.join(e, keys, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    ins, exp = F.col("a").isNotNull(), F.col("e").isNotNull()
    out = both.groupBy(by).agg(n(ins & exp).alias("tp"), n(ins & ~exp).alias("fp"), n(exp & ~ins).alias("fn"), F.coalesce(F.sum("extra"), F.lit(0)).cast("long").alias("duplicates"))
    part = lambda x, y: F.when(x + y > 0, x / (x + y))
    return out.withColumn("precision", part(F.col("tp"), F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("fn")))


def quality_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, n, orphans, percent``: symbols no edge but ``contains`` touches, in whole percent, half up."""
    touched = G.walkable(edges).select(F.explode(F.array("source", "target")).alias("t_id")).distinct().withColumn("t", F.lit(1))
    rows = nodes.join(touched, F.col("id") == F.col("t_id"), "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("t").isNull(), 1)).alias("orphans"))
    return rows.withColumn("percent", F.expr("(100 * orphans + n div 2) div n"))


def violations(nodes: DataFrame, edges: DataFrame, kinds: list[str], relations: list[str], external: list[str]) -> DataFrame:
    """``rule, id``: what a sound graph has none of. Ends of ``external`` relations may lie outside the graph."""
    rule = lambda df, name, c: df.select(F.lit(name).alias("rule"), F.col(c).cast("string").alias("id"))
    ids = nodes.select(F.col("id").alias("n_id"))
    return (
        rule(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate id", "id")
        .unionByName(rule(nodes.filter("coalesce(name, '') = ''"), "empty name", "id"))
        .unionByName(rule(nodes.filter(~F.col("kind").isin(*kinds)), "bad kind", "id"))
        .unionByName(rule(edges.filter(~F.col("relation").isin(*relations)), "bad relation", "source"))
        .unionByName(rule(edges.filter("source = target AND relation <> 'calls'"), "self loop", "source"))
        .unionByName(rule(edges.join(ids, F.col("source") == F.col("n_id"), "left_anti"), "dangling source", "source"))
        .unionByName(rule(edges.filter(~F.col("relation").isin(*external)).join(ids, F.col("target") == F.col("n_id"), "left_anti"), "dangling target", "target"))
    )


def budget_prefix(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """Of each group the longest prefix in ``order`` whose sizes sum to the budget at most, with ``used``."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def session_mix(events: DataFrame) -> DataFrame:
    """Per person: events by kind, distinct days, total and mean value."""
    day = F.to_date("ts")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count_distinct(day).alias("days"), F.round(F.sum("value"), 4).alias("value"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for a status line: ``nodes, files, edges, kinds``, the kinds in order."""
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("files"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return a.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def strict_gate(broken: DataFrame, scores: DataFrame, least: float = 0.9) -> DataFrame:
    """``reason, n``: what keeps a graph from passing: broken rules by number, and relations of ``scores (relation, precision,
    recall)`` of which either is below ``least``, or unknown. No rows mean that it passes."""
    rules = broken.groupBy(F.concat(F.lit("rule: "), "rule").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    low = scores.filter((F.coalesce("precision", F.lit(0.0)) < least) | (F.coalesce("recall", F.lit(0.0)) < least))
    return rules.unionByName(low.select(F.concat(F.lit("score: "), "relation").alias("reason"), F.lit(1).cast("long").alias("n")))
