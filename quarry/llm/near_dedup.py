"""MinHash near-duplicate detection: fast similarity sketching, banding, exact verification.

Sketching (after Dahlgaard, Knudsen and Thorup). A document's set holds the hashes of its distinct five-word shingles. In
round i < t every element is thrown into one of t bins with a value in [i, i+1); in round t + j into bin j. A bin keeps its
least value, and a document is done after the first round that leaves no bin empty; so every coordinate fills within 2t
rounds at most, in about t ln t + n throws, and the share of equal coordinates of two sketches is concentrated about their
similarity as that of t independent ones would be.

Banding. The t coordinates make bands of as many rows as let a pair at the threshold miss all of them with probability
MISS at most: 64 bands of 10 for 0.85 (8e-7), 80 bands of 8 for 0.8 (4e-7). Documents with equal sets are one node. Nodes that
share a band are in one bucket; every pair of a bucket is a candidate.

Exact verification, in groups of bounded size, by full sets, all pairs of a group at once as products of zero-one matrices.
1. A node meets the least leader of its buckets (a bucket's leader is its smallest node); a leader with many such nodes meets
   them in as many groups as it takes. Confirmed links make components.
2. Buckets whose nodes were all in one group, or are in one component by now, are done: only links between components are
   still of interest. Of buckets with the same nodes one is kept. What is left is dealt again: a small bucket is a group; of a
   large one, the nodes outside its main component, if few, meet that component's in as many groups as it takes; else the bucket
   is divided by each other band that its nodes share, so that documents which share a template but little more part, and
   these buckets are treated likewise. A bucket that is large after DEPTH divisions is verified by pairs of blocks.
So nodes are compared within buckets and with their leaders, never all over a component, and no pair of a bucket is left out
(but for one divided: a pair that shares that band and no other, which pairs at the threshold do with probability 1e-5).

Nulls: a null text has no words. Documents without words are linked with nothing. A row with a null id is linked with
nothing either, its component is null and it is kept. Rows that share an id are one document. Texts of any length are
used whole: words are hashed in slices of about SLICE_BYTES, a long text in several; its shingles (8 bytes each, several times
over) are in memory at once. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, meet, packed, ship, text_hash, unpacked

ship(__name__)

WORDS = 5
PERCENT = 85
COORDINATES, MISS = 640, 1e-6
SLICE_BYTES = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: A group holds about as many documents and shingles at most.
GROUP_DOCS, GROUP_SHINGLES = 256, 600_000
DEPTH = 3

U = np.uint64
_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]
STEP = U(0x9E3779B97F4A7C15)
PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of SLICE_BYTES, each up to the end of the word that it would cut."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text). Words are runs of other than ASCII white space, A-Z lower-cased."""
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        parts = [_hashed([x])[0] for x in pieces(texts[0])]
        return (words := np.concatenate(parts)), np.zeros(len(words), np.int64)
    return _hashed(texts)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = ends - starts
    letters = raw[~gap]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), STEP, np.uint64))
    value = np.add.reduceat(BYTE[letters] * power[place], first)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return mixed(value + length.astype(np.uint64)), np.searchsorted(begin, starts, "right") - 1


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' distinct shingles, sorted within a text; number of shingles of each text)."""
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), int)
    runs, whose = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        runs = words[:m] * PLACE[0]
        for k in range(1, WORDS):
            runs = runs + words[k : k + m] * PLACE[k]
        inside = owner[:m] == owner[WORDS - 1 :]
        runs, whose = mixed(runs[inside]), owner[:m][inside]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        begin = np.cumsum(n) - n
        alone = [int((words[begin[i] : begin[i] + n[i]] * PLACE[: n[i]]).sum(dtype=np.uint64)) + int(n[i]) & 0xFFFFFFFFFFFFFFFF for i in short]
        runs, whose = np.concatenate((runs, mixed(np.array(alone, np.uint64)))), np.concatenate((whose, short))
    order = np.lexsort((runs, whose))
    runs, whose = runs[order], whose[order]
    if len(runs):
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (whose[1:] != whose[:-1])
        runs, whose = runs[new], whose[new]
    return runs, np.bincount(whose, minlength=len(texts))


def sketches(sets: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    n = len(sizes)
    empty = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    missing = np.full(n, t)
    for i in range(2 * t):
        if not len(owner):
            break
        h = mixed(sets + U(int(STEP) * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        low = (h & U(0xFFFFFFFF)) | U(i << 32)
        at = owner * t + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else owner * t + (i - t)
        free = out[at] == empty  # bins of earlier rounds hold lesser values
        spots = at[free]
        if len(spots):
            np.minimum.at(out, spots, low[free])
            filled = np.unique(spots)
            missing -= np.bincount(filled // t, minlength=n)
            more = missing[owner] > 0
            if not more.all():
                owner, sets = owner[more], sets[more]
    return out.reshape(n, t)


def band_rows(percent: int) -> int:
    """Rows of a band: as many as the bound on missed pairs allows."""
    same = percent / 100
    return next(r for r in range(32, 0, -1) if r == 1 or (1 - same**r) ** (COORDINATES // r) <= MISS)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    n = COORDINATES // rows
    odd = np.random.default_rng(7).integers(0, 1 << 63, rows, dtype=np.uint64) * U(2) + U(1)
    keys = (sketch[:, : n * rows].reshape(len(sketch), n, rows) * odd).sum(axis=2, dtype=np.uint64)
    return mixed(keys + STEP * np.arange(1, n + 1, dtype=np.uint64)).view(np.int64)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for k, x in enumerate(texts):
        if held and held + len(x) > SLICE_BYTES:
            yield a, k
            a, held = k, 0
        held += len(x) + 1
    if a < len(texts):
        yield a, len(texts)


SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signed(rows: int):
    n_bands = COORDINATES // rows

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, ths = batch.column("doc_id"), batch.column("th")
            for a, b in slices(texts):
                sets, sizes = shingle_sets(texts[a:b])
                some = np.flatnonzero(sizes)
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                keys = np.empty((0, n_bands), np.int64)
                if len(some):
                    first = (np.cumsum(sizes) - sizes)[some]
                    d1[some] = np.add.reduceat(mixed(sets + U(1)), first)
                    d2[some] = np.add.reduceat(mixed(sets * STEP + U(3)), first)
                    keys = band_keys(sketches(sets, sizes[some], COORDINATES), rows)
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, n_bands, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), ths.slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), bands], schema=SIGNED)

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """``edges (a, b)`` of longs -> ``node, root``, root the smallest node of its component. Alternates large-star and
    small-star steps (Kiveris and others), each written to the shared folder, until the links no longer change."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark, n = None, now.count()
    while n:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        star = meet(both.filter("b > a"), "a", low, "u", "degree", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = cut(star.unionByName(low.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        low = star.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        more = meet(star, "a", low, "u", "degree", 2 * n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, cut(more.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        n, new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(old, star)
        if (n, new) == mark:
            break
        mark = (n, new)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets reach ``percent`` % similarity: a square of booleans."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    names = np.cumsum(count > 1) - 1
    code, owner = names[code[shared]], owner[shared]
    inter = np.zeros((m, m), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = max(64, (1 << 22) // max(m, 1))
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, (a, a + width))
        part = np.zeros((m, min(width, int(code[-1]) + 1 - a)), np.float32)
        part[owner[lo:hi], code[lo:hi] - a] = 1
        inter += part @ part.T  # counts below 2**24, so exact
    inter = np.rint(inter).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    return 100 * inter >= percent * union


def forest(link: np.ndarray) -> np.ndarray:
    """The number of the first member of each one's component."""
    label = np.arange(len(link))
    link = link | np.eye(len(link), dtype=bool)
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(percent: int):
    def run(group: pa.Table) -> pa.Table:
        comp, node, block = (group.column(c).to_numpy() for c in ("comp", "node", "block"))
        texts = group.column("text").cast(pa.binary()).to_pylist()
        sets: list[np.ndarray] = []
        for a, b in slices(texts):
            flat, sizes = shingle_sets(texts[a:b])
            sets += np.split(flat, np.cumsum(sizes)[:-1])
        order = np.argsort(comp, kind="stable")
        left, right = [], []
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            link = linked([sets[k] for k in own], percent)
            sides = block[own]
            if sides.min() != sides.max():  # two blocks: what is within one of them is another task's
                link &= sides[:, None] != sides[None, :]
            root = forest(link)
            joined = np.flatnonzero(root != np.arange(len(own)))
            left.append(node[own][joined])
            right.append(node[own][root[joined]])
        return pa.table([np.concatenate(left), np.concatenate(right)], schema=LINKS)

    return run


def weight(n: str) -> Column:
    """A node's share of a group."""
    return F.greatest(F.lit(1 / GROUP_DOCS), F.col(n) / GROUP_SHINGLES)


def confirmed(texts: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` (a spanning forest of each group's, written) within ``groups (comp, node, th, block, w)``: ``comp``
    names a group, ``w`` is its weight; a group of two blocks is compared across them only. ``texts``: doc_id, th, text."""
    groups = cut(groups, "groups")
    small_groups = F.col("w") <= 0.25
    bins = max(1, ceil(2 * (groups.filter(small_groups).agg(F.sum(F.col("share"))).first()[0] or 0)))
    # light groups share a task; texts move only for nodes that are in some group
    task = F.when(small_groups, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp"))
    wanted = groups.select(F.col("node").alias("w_node"), F.col("th").alias("w_th")).distinct().hint("merge")
    own = texts.join(wanted, (F.col("doc_id") == F.col("w_node")) & (F.col("t_th") == F.col("w_th"))).dropDuplicates(["doc_id", "t_th"]).select("doc_id", "t_th", "text")
    rows = groups.join(own, (F.col("node") == F.col("doc_id")) & (F.col("th") == F.col("t_th")))
    rows = rows.select(task.alias("g"), small_groups.alias("light"), "comp", "node", F.col("block").cast("long").alias("block"), "text")
    return cut(rows.groupBy("g", "light").applyInArrow(_verified(percent), "a long, b long"), "links")


def led(lead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``lead (node, th, n, bands)``: (per node with a candidate ``node, th, n, bands, leader``, the least leader of its buckets;
    per leader ``l_node, l_n, chunks``, the groups that it takes, and ``w``)."""
    keys = lead.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy(F.col("key").alias("b_key")).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("c")).filter("low <> high").drop("high")
    buckets = cut(buckets, "buckets")
    total = buckets.agg(F.sum("c")).first()[0] or 0
    low = meet(keys, "key", buckets, "b_key", "c", total).groupBy(F.col("node").alias("k_node")).agg(F.min("low").alias("leader"))
    followers = cut(lead.join(low, F.col("node") == F.col("k_node")).drop("k_node"), "followers")
    taken = followers.filter("leader <> node").groupBy(F.col("leader").alias("l_node")).agg(F.count(F.lit(1)).alias("c"), F.sum(weight("n")).alias("w"))
    heads = followers.select(F.col("node").alias("h_node"), F.col("n").alias("l_n"), F.col("th").alias("l_th"))
    taken = taken.join(heads, F.col("l_node") == F.col("h_node")).drop("h_node")
    taken = taken.withColumn("chunks", F.when(F.col("w") + weight("l_n") <= 1, F.lit(1)).otherwise(F.ceil(2 * F.col("w"))).cast("long"))
    return followers, cut(taken, "leaders")


NODE = ["node", "th", "n"]


def first_groups(followers: DataFrame, leaders: DataFrame) -> DataFrame:
    """Every leader with those that it leads, in its chunks."""
    total = leaders.agg(F.sum("c")).first()[0] or 0
    rows = meet(followers.filter("leader <> node").select("node", "th", "n", "leader"), "leader", leaders, "l_node", "c", total)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")))
    heads = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    heads = heads.select(F.col("l_node").alias("leader"), "chunk", F.col("l_node").alias("node"), F.col("l_th").alias("th"), F.col("l_n").alias("n"), "w", "chunks", "l_n")
    rows = rows.select(*heads.columns).unionByName(heads)
    return rows.select(F.xxhash64("leader", "chunk").alias("comp"), "node", "th", F.lit(0).alias("block"), (F.col("w") / F.col("chunks") + weight("l_n")).alias("w"), weight("n").alias("share"))


def dealt_again(live: DataFrame, bands: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Of ``live (key, node, th, n, comp, leader, whole)``, the members of buckets: (groups to verify, the members of divided buckets,
    named anew, for the next round). ``bands (b_node, bands)`` are fetched for members of divided buckets only."""
    size = weight("n")
    facts = live.groupBy(F.col("key").alias("b_key")).agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("c"), F.sum(size).alias("bw"), F.min("comp").alias("main"), F.max("comp").alias("other"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sign"))
    facts = facts.filter("main <> other").drop("other")
    one = facts.groupBy("c", "sign").agg(F.min("b_key").alias("keep")).select("keep")
    facts = cut(facts.join(one, F.col("b_key") == F.col("keep"), "left_semi").drop("sign"), "open")
    total = facts.agg(F.sum("c")).first()[0] or 0
    seen = (F.col("node") == F.col("low")) | (F.col("leader") == F.col("low")) & F.col("whole")
    rows = cut(meet(live, "key", facts, "b_key", "c", total).drop("b_key").withColumn("seen", seen), "members")
    state = rows.groupBy(F.col("key").alias("s_key")).agg(F.min("seen").alias("all_seen"), F.sum(F.when(F.col("comp") != F.col("main"), size)).alias("rest"), F.max("c").alias("s_c"))
    rows = meet(rows, "key", cut(state.filter("not all_seen"), "state"), "s_key", "s_c", total).drop("s_key", "s_c", "all_seen")
    fits, few, many = F.col("bw") <= 1, F.col("rest") <= 0.5, (F.col("c") > GROUP_DOCS) & F.lit(depth < DEPTH)
    rows = cut(rows.withColumn("way", F.when(fits, "group").when(few, "main").when(many, "divide").otherwise("blocks")), "dealt")
    named = lambda *c: F.xxhash64("key", *c, F.lit(depth))
    out = rows.filter("way = 'group'").select(named().alias("comp"), "node", "th", F.lit(0).alias("block"), F.col("bw").alias("w"), size.alias("share"))
    # the few outside the main component meet it chunk by chunk
    chunks = F.greatest(F.lit(1), F.ceil(2 * (F.col("bw") - F.col("rest")))).cast("long")
    own = F.when(F.col("comp") == F.col("main"), F.array(F.pmod(F.xxhash64("node", F.lit("chunk")), chunks))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
    main = rows.filter("way = 'main'").withColumn("chunk", F.explode(own))
    out = out.unionByName(main.select(named("chunk").alias("comp"), "node", "th", F.lit(0).alias("block"), F.lit(1.0).alias("w"), size.alias("share")))
    blocks = F.greatest(F.lit(2), F.ceil(2 * F.col("bw"))).cast("long")
    pairs = rows.filter("way = 'blocks'").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    i, j = F.least("block", "with"), F.greatest("block", "with")
    out = out.unionByName(pairs.select(F.xxhash64("key", i, j, F.lit(depth)).alias("comp"), "node", "th", F.col("block").cast("int").alias("block"), F.lit(1.0).alias("w"), size.alias("share")))
    again = rows.filter("way = 'divide'").select("key", *NODE, "leader").join(bands, F.col("node") == F.col("b_node")).withColumn("band", F.explode("bands")).filter("band <> key")
    return out, again.select(F.xxhash64("key", "band").alias("key"), *NODE, "leader", F.lit(False).alias("whole"))


def links_of(docs: DataFrame, lead: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the nodes that have a confirmed link. ``docs``: doc_id, text; ``lead``: node, th, n, bands."""
    texts = docs.select("doc_id", text_hash(F.col("text")).alias("t_th"), F.coalesce("text", F.lit("")).alias("text"))
    followers, leaders = led(lead)
    links = confirmed(texts, first_groups(followers, leaders), percent)
    roots = components(links, "roots")
    whole = leaders.filter("chunks = 1").select(F.col("l_node").alias("whole_node"))
    near = followers.join(whole, F.col("leader") == F.col("whole_node"), "left").withColumn("whole", F.col("whole_node").isNotNull()).drop("whole_node")
    live = near.select(*NODE, "leader", "whole", F.explode("bands").alias("key"))
    bands = followers.select(F.col("node").alias("b_node"), "bands")
    for depth in range(DEPTH + 1):
        known = roots.select(F.col("node").alias("r_node"), "root")
        live = live.join(known, F.col("node") == F.col("r_node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("r_node", "root")
        groups, live = dealt_again(live, bands, depth)
        new = confirmed(texts, groups, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links, "roots")
        if live.isEmpty():
            break
    return roots


def classes(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    signed = cut(given.mapInArrow(_signed(band_rows(percent)), "doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>"), "signed")
    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("s", F.xxhash64("d1", "d2", "n_shingles"))
    sets = able.groupBy(F.col("s").alias("set_s"), F.col("d1").alias("s1"), F.col("d2").alias("s2")).agg(F.min(F.struct("doc_id", "th")).alias("first"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    sets = cut(sets.select("set_s", "s1", "s2", "first.*", "n", "copies").withColumnsRenamed({"doc_id": "rep", "th": "rep_th"}), "sets")
    # one document for each distinct set
    lead = able.select("doc_id", "th", "d1", "d2", "bands").join(sets, (F.col("doc_id") == F.col("rep")) & (F.col("th") == F.col("rep_th")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")))
    lead = lead.dropDuplicates(["rep", "rep_th"]).select(F.col("rep").alias("node"), "th", "n", "bands")
    roots = links_of(docs, lead, percent)
    # copies of one set, and rows that share an id, hang on the set's first document
    roots = cut(sets.join(roots, F.col("rep") == F.col("node"), "left").select("set_s", "s1", "s2", "copies", F.coalesce("root", "rep").alias("class")), "classes")
    rows = meet(able.select("doc_id", "th", "n_shingles", "d1", "d2", "s"), "s", roots, "set_s", "copies", roots.agg(F.sum("copies")).first()[0] or 0)
    rows = rows.filter("d1 = s1 AND d2 = s2").select("doc_id", "th", "n_shingles", F.col("class").alias("component_id"))
    rows = rows.unionByName(signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each class; columns unchanged."""
    found = cut(classes(docs, percent, doc_id, text), "classes")
    keep = found.filter("kept").groupBy(F.col("doc_id").alias("k_id")).agg(F.min("th").alias("k_th"), F.count(F.lit(1)).alias("k_n"))
    keep = cut(keep, "kept")
    rows = packed(docs, own_id=F.col(doc_id), own_th=text_hash(F.col(text)))
    out = rows.join(keep, F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("k_id").isNull() | (F.col("own_th") == F.col("k_th"))), "left_semi")
    if not keep.filter("k_n > 1 AND k_id IS NOT NULL").isEmpty():  # rows that repeat
        out = out.filter("own_id IS NOT NULL").dropDuplicates(["own_id"]).unionByName(out.filter("own_id IS NULL"))
    return unpacked(out, docs)
