"""The engine from a command line: ``python -m quarry build TREE SAVED``, then questions to what was saved. ``--json`` prints rows as JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.engine import Engine, as_json, markdown, mermaid
from quarry.sources import files as FS
from quarry.sources import git as V


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--json", action="store_true")
    p.add_argument("--most", type=int, default=100, help="rows that are printed")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("build", "tree", "saved"), ("refresh", "saved", "tree"), ("ask", "saved", "query"), ("walk", "saved", "symbol"), ("path", "saved", "a", "b"), ("read", "saved", "selector"),
        ("skeleton", "saved", "file"), ("grep", "saved", "pattern"), ("map", "saved"), ("dead", "saved"), ("complexity", "saved"), ("cycles", "saved"), ("routes", "saved"),
        ("quality", "saved"), ("check", "saved", "tree"), ("blast", "saved", "tree", "base"), ("hotspots", "saved", "tree"),
    ):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name in ("ask", "grep", "dead"):
            c.add_argument("--in", dest="prefix", default="")
        if name == "walk":
            c.add_argument("--out", action="store_true")
            c.add_argument("--depth", type=int, default=1)
        if name == "grep":
            c.add_argument("-i", dest="ignore_case", action="store_true")
            c.add_argument("-F", dest="fixed", action="store_true")
        if name == "cycles":
            c.add_argument("--files", action="store_true")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame | str:
    if a.command == "build":
        Engine.build(spark, a.tree).save(a.saved)
        return f"saved below {a.saved}"
    e = Engine.load(spark, a.saved)
    if a.command == "refresh":
        e.refresh(a.tree).save(a.saved + ".next")
        return f"saved below {a.saved}.next"
    if a.command == "path":
        steps = e.path(a.a, a.b)
        return mermaid(steps) if steps else "no path"
    if a.command == "blast":
        _, ranges = V.changes(spark, a.tree, a.base)
        seeds, _, modules = e.blast(ranges.filter("start IS NOT NULL").select("path", "range_id", "start", "end"))
        return modules if a.json else markdown(seeds, modules)
    calls = {
        "ask": lambda: e.ask(a.query, prefix=a.prefix), "walk": lambda: e.walk(a.symbol, "out" if a.out else "in", a.depth), "read": lambda: e.read(a.selector), "skeleton": lambda: e.skeleton(a.file),
        "grep": lambda: e.grep(a.pattern, a.prefix, a.ignore_case, a.fixed), "map": lambda: e.repo_map()[0], "dead": lambda: e.dead_code(a.prefix), "complexity": lambda: e.complexity(),
        "cycles": lambda: e.cycles("file" if a.files else "dir"), "routes": e.routes, "quality": e.quality, "check": lambda: FS.changed_since(FS.scan(spark, a.tree), FS.fingerprint(e.graph.files)),
        "hotspots": lambda: e.hotspots(V.history(spark, a.tree)),
    }
    return calls[a.command]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    try:
        out = answer(spark, a)
    except ValueError as x:
        print(x, file=sys.stderr)
        return 1
    if isinstance(out, DataFrame):
        out = as_json(out, a.most) if a.json else "\n".join("\t".join("" if v is None else str(v) for v in row) for row in out.select([F.col(c).cast("string") for c in out.columns]).limit(a.most).collect())
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
