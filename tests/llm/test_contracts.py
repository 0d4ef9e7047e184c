"""The queries against SQL on small tables, and those that SQL can't express against plain versions."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from compare import differences

import corpus_pipeline
from quarry.llm import queries as Q

A_Z = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, sf, name):
    assert not differences(spark, Q.QUERIES[name], Q.ORACLES[name], sf)


def plain_classes(rows, percent):
    """Brute force over all pairs that share a shingle."""
    sets, holders = {}, collections.defaultdict(list)
    for i, t in rows:
        w = WORDS.findall((t or "").encode().translate(A_Z))
        sets[i] = frozenset() if not w else frozenset([b" ".join(w)] if len(w) < 5 else [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)])
        for g in sets[i]:
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for j, n in collections.Counter(j for g in own for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_op5_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.QUERIES["op5_near_dedup"](spark, sf).collect()}
    assert got == plain_classes(rows, 85)


def area(score, y):
    """The area under the curve: how often a row of label 1 scores above one of label 0, ties half."""
    _, place, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize("name,label,parts,held,recall", [("op2_quality", "quality", 3, 1, (0.97, 0.97)), ("op4_toxicity", "toxic", 5, 0, (0.65, 0.98))])
def test_held_out_accuracy(spark, name, label, parts, held, recall):
    """What a constant can't reach: recall of either label (1, 0) and the area under the curve."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.QUERIES[name](spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    y, score = np.array([truth[r.doc_id] for r in own]), np.array([r.score for r in own])
    assert np.mean(score[y == 1] >= 0.5) >= recall[0] and np.mean(score[y == 0] < 0.5) >= recall[1] and area(score, y) >= 0.95


def test_op10_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in Q.QUERIES["op10_ann"](spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = v @ v[k]
        score[k] = -math.inf
        best = np.lexsort((ids, -score))[:20]
        own = sorted(got[ids[k]])
        assert [x[0] for x in own] == list(range(1, 21)) and all(x[1] != ids[k] for x in own)
        assert all(math.isclose(x[2], v[k] @ v[np.flatnonzero(ids == x[1])[0]], abs_tol=1e-12) for x in own)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(own, own[1:]))
        hit += len({x[1] for x in own} & set(ids[best]))
    assert hit / 20 / len(got) >= 0.9


def plain_toxicity(text, model):
    """The noisy-or of a text's sentences, one word after another."""
    from quarry.llm import toxicity

    clean = 1.0
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    for s in re.split(r"[.!?]+\s+|\n+", low):
        if words := set(re.findall(r"\w+", s)):
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights[list(toxicity.feature_ids(w, {}))].astype(np.float32).sum() for w in words))))
    return 1 - clean


def test_pipeline_against_plain_stages(spark, sf):
    """Each stage's rows follow from its own input, by a plain version of the stage."""
    import duckdb
    import pyarrow as pa
    from pyspark.sql import functions as F
    from test_cases import plain_hits, plain_shards

    from quarry.llm import toxicity
    from quarry.llm.common import cut, table

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf), name)
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        ids = collections.Counter(r["doc_id"] for r in after)
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, sf, "labels"), F.lit(True))
            assert ids == collections.Counter(r["doc_id"] for r in before if plain_toxicity(r["text"], model) < 0.5) and len(after) < len(before)
        elif name == "near_dedup":
            want = plain_classes([(r["doc_id"], r["text"]) for r in before], 80)
            assert ids == collections.Counter(i for i, x in want.items() if x[2])
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            hits = plain_hits([(r["doc_id"], r["text"]) for r in before], items)
            assert ids == collections.Counter(i for i, (_, _, n) in hits.items() if not n) and len(after) < len(before)
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", pa.Table.from_pylist(before, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
            plan = con.execute(Q.OP7_SQL).fetchall()
            assert ids == +collections.Counter({i: int(taken / size + 0.5) if size else 1 for i, size, _, _, taken in plan})
        else:
            want = plain_shards([(r["doc_id"], r["text"]) for r in before], 16 << 20)
            assert all(r["shard"].split("-")[0] == want[r["doc_id"], r["text"]] and r["bytes"] == len((r["text"] or "").encode()) for r in after)
            assert ids == collections.Counter(r["doc_id"] for r in before) and max(r["shard_bytes"] for r in after) <= 16 << 20
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "sharding" or out.columns == docs.columns)
        docs = out
    assert collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == ids
