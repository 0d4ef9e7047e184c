"""How symbols named together call each other, and the lines that show an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.cuts import cut

#: How many symbols a flow is looked for among, and how many it may pass.
NAMED, CHAIN = 8, 7


def call_chain(edges: DataFrame, nodes: DataFrame, ids: list[str]) -> list[str]:
    """The chain of calls that passes the most of the first ``NAMED`` callables of ``ids``, the shorter of equals; between two of
    them it may pass one other callable, and go from an interface's method to an implementation. [] for less than three.

    The cluster finds the steps between the named ones (at most one a pair); the search among these few is a driver's step."""
    asked = ids[: 4 * NAMED]  # a short list that a hit list named
    callable_ = nodes.filter("kind IN ('function', 'method')").select(F.col("id").alias("c_id"))
    known = {r["c_id"] for r in callable_.filter(F.col("c_id").isin(asked)).collect()}
    own = [x for x in dict.fromkeys(asked) if x in known][:NAMED]
    if len(own) < 2:
        return []
    calls = edges.filter("relation = 'calls' AND source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.filter("relation = 'implements'").join(callable_, F.col("source") == F.col("c_id"), "left_semi").join(callable_, F.col("target") == F.col("c_id"), "left_semi")
    steps = calls.unionByName(back.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    near = steps.filter(F.col("a").isin(own) & F.col("b").isin(own)).select("a", "b", F.lit(None).cast("string").alias("over"))
    out = steps.filter(F.col("a").isin(own) & ~F.col("b").isin(own)).select("a", F.col("b").alias("over"))
    into = steps.filter(~F.col("a").isin(own) & F.col("b").isin(own)).select(F.col("a").alias("o"), "b")
    bridged = out.join(into, F.col("over") == F.col("o")).filter("a <> b").groupBy("a", "b").agg(F.min("over").alias("over"))
    links: dict[str, dict[str, str | None]] = {x: {} for x in own}
    for r in bridged.unionByName(near).collect():  # NAMED * NAMED of either kind at most
        if r["over"] is None or r["b"] not in links[r["a"]]:
            links[r["a"]][r["b"]] = r["over"]
    best: tuple[int, int, list[str]] = (1, 0, [])
    todo = [([x], 1) for x in reversed(own)]
    while todo:
        chain, named = todo.pop()
        if (named, -len(chain)) > best[:2]:
            best = (named, -len(chain), chain)
        for nxt in reversed([x for x in own if x in links[chain[-1]]]):
            over = links[chain[-1]][nxt]
            grown = [*chain, *([over] if over else []), nxt]
            if nxt not in chain and over not in chain and len(grown) <= CHAIN:
                todo.append((grown, named + 1))
    return best[2] if len(best[2]) >= 3 else []


def quote_lines(edges: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``source, target, relation, at, quote``: the line of each edge in its source's file; for one without a line, the first in the
    source's span that writes the target's name. ``lines (path, line, text)``."""
    at = nodes.select(F.col("id").alias("s_id"), F.col("path").alias("s_path"), "start_line", "end_line")
    named = nodes.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"))
    # written tables and texts take many times their files' bytes in memory: no side is sent to the driver
    rows = cut(edges.join(at.hint("merge"), F.col("source") == F.col("s_id")).join(named.hint("merge"), F.col("target") == F.col("t_id"), "left"), "quoted")
    own = lines.select(F.col("path").alias("l_path"), F.col("line").alias("l_line"), "text")
    told = rows.filter("line > 0").join(own.hint("merge"), (F.col("s_path") == F.col("l_path")) & (F.col("line") == F.col("l_line")))
    told = told.select("source", "target", "relation", F.col("l_line").cast("long").alias("at"), F.col("text").alias("quote"))
    # words are looked up, not lines: an equi-join on the path and the name
    words = own.select("l_path", "l_line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("word"))
    mute = rows.filter("coalesce(line, 0) = 0").join(words.hint("merge"), (F.col("s_path") == F.col("l_path")) & (F.col("t_name") == F.col("word")) & (F.col("l_line") >= F.col("start_line")) & (F.col("l_line") <= F.col("end_line")))
    mute = mute.groupBy("source", "target", "relation").agg(F.min(F.struct("l_line", "text")).alias("b"))
    return told.unionByName(mute.select("source", "target", "relation", F.col("b.l_line").cast("long").alias("at"), F.col("b.text").alias("quote")))
