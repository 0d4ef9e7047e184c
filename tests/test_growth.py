"""Steps whose work grew faster than their input."""

from quarry.operators import joins as J


def joined_rows(df):
    """The most rows that a join of the plan, once run, gave."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_typed_members_are_counted_before_they_meet(spark):
    intents = spark.range(300).selectExpr("id AS intent", "'T' AS type", "'m' AS method", "IF(id % 3 = 2, NULL, id % 3) AS args")
    members = spark.range(300).selectExpr("id", "'B' AS type", "'m' AS method", "IF(id < 299, 0L, 1L) AS arity")
    parents = spark.createDataFrame([("T", "B")], "type string, parent string")
    df = J.typed_members(intents, members, parents)
    got = {r.intent: (r.target, r.level, r.outcome) for r in df.collect()}
    assert got == {k: ((299, 1, "bound") if k % 3 == 1 else (None, 1, "ambiguous")) for k in range(300)}
    assert joined_rows(df) <= 300


def test_long_spans_make_no_more_rows_than_short_ones(spark):
    far = 10**13
    spans = spark.createDataFrame([("a", 0, far, 1), ("a", 100, 200, 2), ("b", 5, 5, 3), ("a", 100, 200, 4)], "k string, start long, end long, span_id long")
    at = spark.createDataFrame([("a", 150), ("a", 201), ("a", far), ("a", far + 1), ("b", 5), ("b", 6)], "k string, at long")
    assert {(r.k, r.at): r.span_id for r in J.enclosing(at, spans, "k", "at", 64).collect()} == {("a", 150): 2, ("a", 201): 1, ("a", far): 1, ("a", far + 1): None, ("b", 5): 3, ("b", 6): None}
    assert {(r.k, r.at) for r in J.residual(at, spans, "k", "at", 64).collect()} == {("a", far + 1), ("b", 6)}
    ranges = spark.createDataFrame([("a", 150, far, 1), ("a", 300, 400, 2), ("b", 6, 9, 3), ("a", 0, 100, 4), ("a", far, far, 5)], "k string, start long, end long, range_id long")
    pairs = J.overlapping(ranges, spans, "k", 64)
    assert sorted((r.range_id, r.span_id) for r in pairs.collect()) == [(1, 1), (1, 2), (1, 4), (2, 1), (4, 1), (4, 2), (4, 4), (5, 1)]
    assert sorted((r.range_id, r.span_id) for r in J.innermost(pairs).collect()) == [(1, 4), (2, 1), (4, 4), (5, 1)]


def test_spans_are_not_broadcast(spark):
    spans = spark.range(10).selectExpr("1 AS k", "id AS start", "id AS end", "id AS span_id")
    at = spark.range(3).selectExpr("1 AS k", "id AS line")
    for df in (J.residual(at, spans, "k"), J.enclosing(at, spans, "k", "line"), J.overlapping(spans.withColumnRenamed("span_id", "range_id"), spans, "k")):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_file_is_split_into_lines_once(spark, monkeypatch):
    import ast

    from quarry.sources import extract as E

    text = "# é\r\nclass A(B):\n" + "".join(f"    def f{k}(self, é='é', b={{1: 2}}):  # c\n        return 1\n" for k in range(50)) + "\n@d\nasync def g(a,\n            b=1) -> int:\n    def h(): return lambda: 0\n    return h\n" + f"def w(a={list(range(300))}):\n    pass"
    want = {}
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            want[node.name] = " ".join(ast.get_source_segment(text, node).split(":\n")[0].split())[:400]
    monkeypatch.delattr(ast, "get_source_segment")
    assert {r["name"]: r["signature"] for r in E.rows_of("a.py", text) if r.get("signature")} == want


def test_files_are_dealt_over_tasks(spark):
    from quarry.sources import extract as E

    files = spark.createDataFrame([(f"a{k}.py", "def f(): pass\n") for k in range(40)], "path string, text string").coalesce(1)
    tasks = E.extract(files).selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks > 1


def test_routes_meet_the_function_below_them_only(spark):
    from quarry.operators import routes as H

    n = 3000  # lines apart as in the modules that routes_declared writes
    text = "".join(f"@app.get('/p/{k}')\ndef f{k}():\n    return 1\n\n" for k in range(n))
    files = spark.createDataFrame([("web/a.py", text, "python")], "path string, text string, family string")
    nodes = spark.createDataFrame([(f"web/a.py#f{k}", f"f{k}", "function", "web/a.py", 4 * k + 1, 4 * k + 3) for k in range(n)], "id string, name string, kind string, path string, start_line int, end_line int")
    df = H.routes(files, nodes)
    assert {(r.path, r.handler) for r in df.collect()} == {(f"/p/{k}", f"web/a.py#f{k}") for k in range(n)}
    assert "start_line#" not in "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x)


def test_quotes_are_not_broadcast(spark):
    from quarry.operators import flows

    nodes = spark.createDataFrame([("s", "s", "f.py", 1, 3), ("t", "t", "g.py", 1, 1)], "id string, name string, path string, start_line int, end_line int")
    edges = spark.createDataFrame([("s", "t", "calls", 0), ("s", "s", "calls", 3)], "source string, target string, relation string, line int")
    lines = spark.createDataFrame([("f.py", 1, "def s():"), ("f.py", 2, "  t()"), ("f.py", 3, "  s()")], "path string, line int, text string")
    df = flows.quote_lines(edges, nodes, lines)
    assert {(r.target, r["at"], r.quote) for r in df.collect()} == {("t", 2, "  t()"), ("s", 3, "  s()")}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_several_blocks_are_those_of_one(spark):
    import collections

    import pytest

    from quarry.operators import graph as G

    rows = [(f"n{k * k % 31}", f"n{k % 17}") for k in range(120)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), ("far", "away")]
    edges = spark.createDataFrame(rows, "source string, target string").repartition(3)
    weight = {"n1": 2.0, "n4": 1.0, "alone": 1.0}
    near = collections.defaultdict(list)
    for a, b in rows:
        near[a].append(b)
        near[b].append(a)
    start = {k: w / 4 for k, w in weight.items()}
    mass = dict(start)
    for _ in range(7):
        step, lost = collections.defaultdict(float), 0.75 * sum(m for x, m in mass.items() if not near[x])
        for x, m in mass.items():
            for y in near[x]:
                step[y] += 0.75 * m / len(near[x])
        for x, r in start.items():
            step[x] += (0.25 + lost) * r
        mass = step
    want = {x: m / max(mass.values()) for x, m in mass.items()}
    assert "far" not in want
    seeds = spark.createDataFrame([("n1", 1.5), ("n1", 0.5), ("n4", 1.0), ("alone", 1.0)], "id string, weight double")
    for links in (20, 10**6):
        df = G.pagerank(edges, seeds, 7, every=3, block_links=links)
        assert {r.id: r["rank"] for r in df.collect()} == pytest.approx(want)


def test_a_long_loop_is_searched_by_one_task(spark):
    import random

    from quarry.operators import graph as G

    n = 600_000  # colouring would take a round a step
    loop = spark.range(n).selectExpr("concat('n', id) AS source", f"concat('n', (id + 1) % {n}) AS target")
    assert G.components_of(loop).groupBy("component").count().collect() == [("n0", n)]
    chance = random.Random(5)
    for size in (3, 8, 20):
        pairs = [(f"{chance.randrange(size)}", f"{chance.randrange(size)}") for _ in range(2 * size)]
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        nodes = {x for p in pairs for x in p}
        assert G.strong_components(pairs) == {x: min(y for y in nodes if y == x or (x, y) in reach and (y, x) in reach) for x in nodes}


def test_many_patches_make_few_batches(spark, monkeypatch):
    import pyarrow as pa

    from quarry.sources import git as V

    made = []
    batches = type("Texts", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: made.extend(run(iter([pa.RecordBatch.from_pydict({"patch": texts})])))})
    texts = [f"diff --git x y\n--- a/{k}\n+++ b/{k}\n@@ -0,0 +{k},2 @@\n+a\n+b\n-c" for k in range(12_000)] + [None]
    V.patches(batches())
    assert len(made) < 10 and sum(b.num_rows for b in made) == 12_000
    assert [r["start"] for b in made for r in b.to_pylist()] == list(range(12_000))


def test_a_text_is_counted_as_it_is_split(spark):
    import collections

    from quarry.functions import text as X

    texts = ["HTTPServer readFile's uses, boxes; axes pies ponies stopped running bring bed fed agreed X1Y22 the İstanbul Kelvin classes glass", "", None, "ABCDef ghIJk __init__ missing missings ee 12 3 été"]
    want = [collections.Counter(r.t) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(X.terms(X.F.col("t")).alias("t")).collect()]
    assert [X.count_terms(t, {}) for t in texts] == want


def test_a_walk_moves_its_frontiers_steps_only(spark, monkeypatch):
    from quarry.operators import graph as G

    rows = [(f"n{k}", f"n{j}", r, 7 * k + j) for k in range(300) for j in (k * k % 97, k // 2, k // 2) for r in ("calls", "references")]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, ord long")
    seeds = spark.createDataFrame([("n1",), ("n5",)], "id string")
    walks = lambda: [sorted(map(repr, df.collect())) for df in (G.impact(edges, seeds, 3), G.impact(edges, seeds, 2, incoming=False), G.distances(edges, seeds))]
    few = walks()
    monkeypatch.setattr(G, "FEW", 0)
    assert walks() == few
    frontier = spark.createDataFrame([("a",)], "id string")
    df = G.met(spark.createDataFrame([("a", 1), ("b", 2)], "here string, ord int"), frontier, 1)
    assert [tuple(r) for r in df.collect()] == [("a", 1)]
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and "bucket" in "".join(joins)


def test_types_meet_interfaces_in_rows_for_a_manner_each(spark):
    from quarry.operators import retrieval as T

    columns = "owner string, dir string, method string, arity long, variadic boolean, results int, exported boolean"
    types = spark.createDataFrame([("a", "x", "m", 1, False, r, True) for r in range(40)] + [("b", "y", "m", 1, False, None, True), ("c", "x", "m", 1, False, 99, True)], columns)
    asks = spark.createDataFrame([("I", "x", "m", 1, False, 3, True), ("J", "x", "m", 1, False, None, False), ("K", "x", "m", None, False, 3, True)], columns)
    df = T.satisfied(types, asks)
    assert {tuple(r) for r in df.collect()} == {("a", "I"), ("b", "I"), ("a", "J"), ("c", "J")}
    assert joined_rows(df) <= 6


def test_neighbours_of_seeds_are_dealt_by_their_number(spark, monkeypatch):
    import collections
    import re

    from quarry.operators import graph as G
    from quarry.operators import retrieval as T

    relations = ("calls", "references", "contains")
    rows = [(f"n{k}", f"n{j}", relations[(k + j) % 3], (k * 31 + j * 17) % 50) for k in range(400) for j in (0, k * k % 97, k // 2, k // 2, k)]
    tests = {f"n{k}" for k in range(0, 400, 3)}
    seeds = {f"n{k}" for k in range(0, 400, 2)} | {"away"}
    least = collections.defaultdict(dict)
    for a, b, relation, ord in rows:
        for seed, other, group in ((b, a, "caller"), (a, b, "dependency")) if relation != "contains" else ():
            if seed in seeds:
                own = least[seed, "test" if other in tests else group]
                own[other] = min(ord, own.get(other, ord))
    want = sorted((seed, group, other, k + 1) for (seed, group), own in least.items() for k, other in enumerate(sorted(own, key=lambda x: (own[x], x))[:2]))
    edges = spark.createDataFrame(rows, "source string, target string, relation string, ord long")
    nodes = spark.createDataFrame([(f"n{k}", f"n{k}" in tests or None) for k in range(300)] + [(f"n{k}", f"n{k}" in tests) for k in range(300, 400)], "id string, is_test boolean")
    own = spark.createDataFrame([(x,) for x in sorted(seeds)], "id string")
    monkeypatch.setattr(T, "ROWS", 100, raising=False)
    for few in (G.FEW, 0):
        monkeypatch.setattr(G, "FEW", few)
        df = T.edit_context(edges, nodes, own)
        assert sorted(tuple(r) for r in df.select("seed", "group", "other", "place").collect()) == want
        dealt = re.search(r"hashpartitioning\(seed#\d+, other#\d+, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
        assert dealt and int(dealt[1]) >= 2 * len([r for r in rows if r[2] != "contains"]) / 100


def test_a_bitmap_knows_every_bit_of_a_byte(spark):
    from quarry.operators import graph as G

    frontier = spark.range(60_000).selectExpr("concat('n', 2 * id) AS id")
    steps = spark.range(120_000).selectExpr("concat('n', id) AS here")
    got = {r.here for r in G.marked(steps, frontier).collect()}
    assert got >= {f"n{k}" for k in range(0, 120_000, 2)} and len(got) < 60_200
