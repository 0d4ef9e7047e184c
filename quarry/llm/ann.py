"""Approximate nearest neighbours by inner product: a navigable small-world hierarchy per shard.

Build. Vectors are dealt over shards of at most SHARD_ROWS distinct vectors by a hash. Equal vectors are one node, so that
copies can't crowd a neighbour list; a node carries the ids of its copies, as many of the smallest as any answer can need
(``k`` and the query's own: ties go to smaller ids, so no other copy can be among the k nearest).
Within a shard inner product is turned into Euclidean distance by one more coordinate, sqrt(M**2 - |x|**2), M the largest
length in the shard. A node's level is drawn by its hash from the usual geometric law. Levels are built from the top: nodes
of a level that are in the graph already are searched from above, and those that are new are added in batches, each linked to
its LINKS (2 LINKS on the ground level) nearest by the beam search, chosen so that no neighbour is nearer to a chosen one
than to the node (fewer are filled up), with links back, pruned by the same rule. A shard's graph is stored as flat arrays:
vectors, ids, and for each level the node numbers and a rectangle of neighbours, -1 where there is none.

Search. Every shard answers each block of queries by beam search with BEAM candidates from the top level down; its k best
are scored again in double precision on the original vectors, and the shards' answers are merged by rank.

Left out: vectors that are null, empty, all zero, or hold null or non-finite components; null ids. Rows that repeat an id
and vector are one; an id with several vectors answers with its best. Queries and rows of another dimension than most
have no common shard (shards are by dimension). Empty tables give no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship

ship(__name__)

#: Each query meets each shard, so shards are as large as a task can build; a graph is read once for a block of queries.
SHARD_ROWS, BLOCK_QUERIES = 65_536, 65_536
LINKS, BUILD_BEAM, BEAM = 16, 64, 400
ADD, ASK = 512, 512
K = 20


class Layer:
    """One level: the nodes it holds and their neighbours, by place in the level."""

    def __init__(self, nodes: np.ndarray, width: int, total: int):
        self.nodes, self.width = nodes, width
        self.near = np.full((len(nodes), width), -1, np.int32)
        self.place = np.full(total, -1, np.int32)
        self.place[nodes] = np.arange(len(nodes))


def beam_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances less |q|**2) of the ``beam`` nearest found for each query, nearest first; -1 where there
    are fewer. ``entry``: places to start from, a row for each query, -1 for none."""
    n_q, norms = len(q), (x * x).sum(1)

    def distance(rows, places):
        return norms[places] - 2 * np.einsum("qd,qjd->qj", q[rows], x[places])

    seen = np.zeros((n_q, len(x)), bool)
    every = np.arange(n_q)
    place = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    width = min(beam, entry.shape[1])
    start = entry[:, :width]
    d0 = np.where(start >= 0, distance(every, np.maximum(start, 0)), np.inf)
    order = np.argsort(d0, axis=1, kind="stable")
    place[:, :width], dist[:, :width] = np.take_along_axis(start, order, 1), np.take_along_axis(d0, order, 1)
    done[:, :width] = ~np.isfinite(dist[:, :width])
    for col in range(width):
        ok = start[:, col] >= 0
        seen[every[ok], start[ok, col]] = True
    while True:
        open_ = ~done
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            return np.where(np.isfinite(dist), place, -1), dist
        best = open_[active].argmax(axis=1)  # the nearest that is not expanded
        done[active, best] = True
        cand = near[place[active, best]]
        fresh = (cand >= 0) & ~seen[active[:, None], np.maximum(cand, 0)]
        rows, cols = np.nonzero(fresh)
        if not len(rows):
            continue
        seen[active[rows], cand[rows, cols]] = True
        d = np.where(fresh, distance(active, np.maximum(cand, 0)), np.inf).astype(np.float32)
        all_d = np.concatenate((dist[active], d), 1)
        all_p = np.concatenate((place[active], cand), 1)
        all_done = np.concatenate((done[active], ~fresh), 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, keep, 1)
        place[active] = np.take_along_axis(all_p, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(dist[active])


def spread(x: np.ndarray, center: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (places, nearest first, -1 for none) ``width`` that lie in different directions: one is taken
    unless it is nearer to one taken before than to the center; free room goes to the nearest of the others."""
    n, m = cand.shape
    vec = x[np.maximum(cand, 0)]
    to_center = ((vec - center[:, None, :]) ** 2).sum(2)
    sq = (vec * vec).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * vec @ vec.transpose(0, 2, 1)
    ok = cand >= 0
    taken = np.zeros((n, m), bool)
    for j in range(m):
        hidden = (taken & (between[:, j, :] < to_center[:, j, None])).any(axis=1)
        taken[:, j] = ok[:, j] & ~hidden & (taken.sum(1) < width)
    rank = np.where(taken, 0, np.where(ok, 1, 2)) * m + np.arange(m)
    order = np.argsort(rank, axis=1)[:, :width]
    out = np.take_along_axis(np.where(ok, cand, -1), order, 1)
    return out if out.shape[1] == width else np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def link(layer: Layer, x: np.ndarray, new: np.ndarray, cand: np.ndarray) -> None:
    """Link places ``new`` to their candidates and back."""
    out = spread(x, x[new], cand, layer.width)
    layer.near[new] = out
    rows, cols = np.nonzero(out >= 0)
    target, source = out[rows, cols], new[rows]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    spots, first, count = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(spots), int(count.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(spots)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    for a in range(0, len(spots), 1024):
        s = spots[a : a + 1024]
        both = np.concatenate((layer.near[s].astype(np.int64), extra[a : a + 1024]), 1)
        both = np.sort(both, axis=1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        d = np.where(both >= 0, ((x[np.maximum(both, 0)] - x[s][:, None, :]) ** 2).sum(2), np.inf)
        order = np.argsort(d, axis=1)
        both = np.take_along_axis(both, order, 1)
        both = both[:, : max(layer.width, int((both >= 0).sum(1).max()))][:, : 3 * layer.width]
        layer.near[s] = spread(x, x[s], both, layer.width)


def raised(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors with the coordinate that turns inner product into distance."""
    rest = np.sqrt(np.maximum(top * top - (x.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate((x, rest[:, None].astype(np.float32)), 1)


def build(x: np.ndarray, draw: np.ndarray) -> list[Layer]:
    """The levels of a graph over ``x`` (raised), top first. ``draw``: a number in (0, 1) for each node."""
    n = len(x)
    level = np.minimum((-np.log(draw) / np.log(LINKS)).astype(int), 8)
    layers: list[Layer] = []
    for lev in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= lev)
        own = x[nodes]
        layer = Layer(nodes, LINKS * (2 if lev == 0 else 1), n)
        # the first ones see each other; the rest are added to what is there, in ever larger batches up to ADD
        order = np.argsort(draw[nodes], kind="stable")  # nodes of higher levels first
        head = min(len(order), 2 * LINKS)
        d = ((own[order[:head], None, :] - own[None, order[:head], :]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        cand = order[:head][np.argsort(d, axis=1)]
        cand[np.arange(head), -1] = -1
        link(layer, own, order[:head], cand)
        a = head
        while a < len(order):
            new = order[a : a + min(ADD, max(LINKS, a // 2))]
            start = entries(layers, layer, x, own[new], order[:1])
            found, _ = beam_search(own, layer.near, own[new], start, BUILD_BEAM)
            # the batch's members may be each other's neighbours too
            inner = ((own[new] ** 2).sum(1)[None, :] - 2 * own[new] @ own[new].T)
            np.fill_diagonal(inner, np.inf)
            some = np.argsort(inner, axis=1)[:, : LINKS]
            both = np.concatenate((found, np.where(np.isfinite(np.take_along_axis(inner, some, 1)), new[some], -1)), 1)
            d = np.where(both >= 0, ((own[np.maximum(both, 0)] - own[new][:, None, :]) ** 2).sum(2), np.inf)
            both = np.take_along_axis(both, np.argsort(d, axis=1), 1)
            link(layer, own, new, both[:, :BUILD_BEAM])
            a += len(new)
        bridged(layer, own)
        layers.append(layer)
    return layers


def islands(near: np.ndarray) -> np.ndarray:
    """The first node of each one's island, links read both ways."""
    label = np.arange(len(near))
    rows, cols = np.nonzero(near >= 0)
    target = near[rows, cols]
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[target])
        np.minimum.at(low, target, label[rows])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def bridged(layer: Layer, x: np.ndarray, rounds: int = 32) -> None:
    """Link islands of a level to the rest: each one's first node and the node nearest to it outside, both ways. Such a link may
    push out another, so what is apart after ``rounds`` is chained by two neighbours more, which are nobody else's."""
    for _ in range(rounds):
        label = islands(layer.near)
        heads = np.unique(label)
        if len(heads) == 1:
            return
        for head in heads[1:]:
            d = ((x - x[head]) ** 2).sum(1)
            d[label == label[head]] = np.inf
            other = int(d.argmin())
            layer.near[head, -1], layer.near[other, -1] = other, head
    heads = np.unique(islands(layer.near))
    if len(heads) > 1:
        layer.near = np.pad(layer.near, ((0, 0), (0, 2)), constant_values=-1)
        layer.near[heads[1:], -2], layer.near[heads[:-1], -1] = heads[:-1], heads[1:]


def entries(layers: list[Layer], below: Layer, x: np.ndarray, q: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Places in ``below`` to start from: what a short search of the levels above finds."""
    at = None
    for layer in layers:
        start = np.zeros((len(q), 1), np.int64) if at is None else np.where(at >= 0, layer.place[at], -1)
        found, _ = beam_search(x[layer.nodes], layer.near, q, start, 4)
        at = np.where(found >= 0, layer.nodes[np.maximum(found, 0)], -1)
    return np.repeat(default[None, :], len(q), 0) if at is None else np.where(at >= 0, below.place[at], -1)


def search(layers: list[Layer], x: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers of the ``beam`` nearest found for each query, -1 where there are fewer."""
    last = layers[-1]
    out = []
    for a in range(0, len(q), ASK):
        own = q[a : a + ASK]
        start = entries(layers[:-1], last, x, own, np.zeros(1, np.int64))
        found, _ = beam_search(x[last.nodes], last.near, own, start, beam)
        # a beam that ran dry was caught among few nodes: those queries look at the whole shard
        dry = np.flatnonzero((found >= 0).sum(1) < min(beam, len(x)))
        if len(dry):
            d = (x * x).sum(1)[None, last.nodes] - 2 * own[dry] @ x[last.nodes].T
            found[dry] = np.argsort(d, axis=1)[:, : found.shape[1]]
        out.append(np.where(found >= 0, last.nodes[np.maximum(found, 0)], -1))
    return np.concatenate(out) if out else np.empty((0, beam), np.int64)


GRAPH = "shard long, dim int, vectors binary, ids array<long>, id_ends array<int>, levels array<int>, nodes binary, near binary"
GRAPH_ARROW = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.int64())), ("id_ends", pa.list_(pa.int32())), ("levels", pa.list_(pa.int32())), ("nodes", pa.binary()), ("near", pa.binary())])


def _floats(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _built(group: pa.Table) -> pa.Table:
    x64 = _floats(group.column("v"))
    x = raised(x64.astype(np.float32), float(np.sqrt((x64**2).sum(1).max())))
    draw = ((group.column("h").to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    layers = build(x, np.minimum(draw, 1 - 1e-12))
    ids = group.column("ids").combine_chunks()
    sizes = [int(v) for layer in layers for v in layer.near.shape]
    row = [[group.column("shard")[0].as_py()], [x64.shape[1]], [x64.tobytes()], [ids.flatten().to_pylist()], [np.asarray(ids.offsets)[1:].tolist()], [sizes], [b"".join(y.nodes.astype(np.int32).tobytes() for y in layers)], [b"".join(y.near.tobytes() for y in layers)]]
    return pa.table([pa.array(v, t) for v, t in zip(row, GRAPH_ARROW.types)], schema=GRAPH_ARROW)


def loaded(row: dict) -> tuple[np.ndarray, np.ndarray, list[Layer], list[np.ndarray]]:
    """(original vectors, raised ones, levels, ids of each node) of a stored graph."""
    x64 = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    x = raised(x64.astype(np.float32), float(np.sqrt((x64**2).sum(1).max())))
    nodes, near, layers, a, b = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["near"], np.int32), [], 0, 0
    for size, width in zip(row["levels"][::2], row["levels"][1::2]):
        layer = Layer(nodes[a : a + size].astype(np.int64), width, len(x))
        layer.near = near[b : b + size * width].reshape(size, width)
        layers.append(layer)
        a, b = a + size, b + size * width
    return x64, x, layers, np.split(np.array(row["ids"], np.int64), row["id_ends"][:-1])


def _answers(k: int, beam: int):
    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not graph.num_rows or not asked.num_rows:
            return schema.empty_table()
        x64, x, layers, ids = loaded(graph.to_pylist()[0])
        q64 = _floats(asked.column("q"))
        q = np.concatenate((q64, np.zeros((len(q64), 1))), 1).astype(np.float32)
        found = search(layers, x, q, min(max(beam, 2 * k), len(x)))
        names = asked.column("query_id").to_numpy()
        out_q, out_v, out_s = [], [], []
        for name, vec, nodes in zip(names, q64, found):
            nodes = nodes[nodes >= 0]
            score = exact(x64[nodes], vec)
            pool_v = np.concatenate([ids[n] for n in nodes])
            pool_s = np.repeat(score, [len(ids[n]) for n in nodes])
            other = pool_v != name
            pool_v, pool_s = pool_v[other], pool_s[other]
            best = np.lexsort((pool_v, -pool_s))[:k]
            out_q.append(np.full(len(best), name))
            out_v.append(pool_v[best])
            out_s.append(pool_s[best])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=schema)

    return run


def exact(rows: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in order of the components."""
    return np.cumsum(rows * vec, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each shard, its graph in flat arrays. Every valid row is in it."""
    rows = valid(vectors, vec_id, embedding)
    # the smallest k + 1 ids of each distinct vector, in two steps so that copies in great number are thinned where they lie
    own = rows.select("vec_id", "v").distinct().select("vec_id", "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    near = own.withColumn("at", F.row_number().over(Window.partitionBy("v", "h", "salt").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    nodes = near.groupBy("v", "h", "salt").agg(smallest(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.groupBy("v", "h").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")), "nodes")
    n = nodes.count()
    parts = max(1, ceil(n / (0.9 * shard_rows)))
    # h deals and draws by different bits
    dealt = nodes.withColumn("shard", F.size("v") * F.lit(1 << 32).cast("long") + F.pmod(F.xxhash64("h"), F.lit(parts)))
    return cut(dealt.select("shard", "v", "h", "ids").groupBy("shard").applyInArrow(_built, GRAPH), "graphs")


def nearest(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block: int = BLOCK_QUERIES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per query ``query_id, rank, vec_id, score``: the k nearest found, the query's own id left out."""
    asked = valid(queries, vec_id, embedding).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = cut(asked, "queries")
    blocks = max(1, ceil(asked.count() / block))
    # queries are a stated set: each of its blocks meets each shard once
    shards = graphs.select(F.col("shard").alias("shard_no"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("dim", F.size("q"))
    asked = asked.join(shards.withColumn("s_dim", F.shiftright("shard_no", 32).cast("int")), F.col("dim") == F.col("s_dim")).select("shard_no", "block", "query_id", "q")
    spread_ = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = spread_.groupBy("shard", "block").cogroup(asked.groupBy("shard_no", "block")).applyInArrow(_answers(k, beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 20, k: int = K, **names: str) -> DataFrame:
    """Index ``vectors`` and ask for the k nearest of each row whose id is divisible by ``every``."""
    graphs = index(vectors, k, **names)
    ask = vectors.filter(F.col(names.get("vec_id", "vec_id")) % every == 0)
    return nearest(graphs, ask, k, **names)
