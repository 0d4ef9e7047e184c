"""Cases that an operator once got wrong, held against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import ann, common, decontamination, mixing, near_dedup, secrets, sharding, substring_dedup, toxicity, warc

A_Z = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return text.encode().translate(A_Z).decode()


def plain_hits(docs, items, window=8):
    """{doc: (words, words inside an occurrence, items)} by trying every window at every place."""
    wins = {}
    for i, t in items:
        w = ITEM_WORD.findall(lowered(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, held = ITEM_WORD.findall(lowered(t)), set(), set()
        for x, own in wins.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    held |= own
        out[d] = (len(w), len(hit), len(held))
    return out


@pytest.mark.parametrize("bound", [None, 0])
def test_decontamination_any_case(spark, monkeypatch, bound):
    """Letters whose small form depends on their neighbours, other scripts, apostrophes and full stops; with and without broadcast."""
    if bound is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = random.Random(3)
    pool = "ΟΔΟΣ ΑΘΗΝΑΣ ΑΒ ΓΔ ΕΖ İI ſS ÜBER Straße KelvinK ДОМ words Σ ΣΣ 日本 x1".split()
    vary = lambda w: rng.choice([w, w, w.lower(), w.upper(), w.translate({k: k + 32 for k in range(65, 91)})])
    items = [(1, "ΟΔΟΣ ΑΒ ΓΔ ΕΖ"), (2, "ÜBER"), (3, "Σ'ΣΣ")] + [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(4, 14)]
    docs = [(1, "ΟΔΟΣ ΑΒ ΓΔ ΕΖ"), (2, "ΟΔΟΣ.ΑΒ ΓΔ ΕΖ"), (3, "x ÜBER y")]
    for k in range(4, 60):
        w = [vary(rng.choice(pool)) for _ in range(20)]
        piece = [vary(x) if k % 2 else x for x in rng.choice(items)[1].split()]
        a = rng.randint(0, 20)
        docs.append((k, "".join(x + rng.choice([" ", ".", "'", ": ", ", "]) for x in w[:a] + piece + w[a:])))
    got = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == plain_hits(docs, items)


def test_secrets_judged_by_repositories_too(spark):
    """Tokens of one owner: one in few documents, one in many; and one that two owners have."""
    live, copied, two = "Zz9" + "aB3" * 8, "Yy8" + "cD4" * 8, "Xx7" + "eF5" * 8
    rows = [(0, live, "a"), (1, two, "a"), (2, two, "b")] + [(10 + k, copied, "a") for k in range(secrets.EXAMPLE_REPOS)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0].n_owned, got[0].n_live, got[0].most_repos) == (1, 1, 1)
    assert got[1].n_owned == got[2].n_owned == 1 and got[1].most_repos == 2
    assert all((got[10 + k].n_owned, got[10 + k].spans, got[10 + k].n_example) == (0, "", 0) for k in range(secrets.EXAMPLE_REPOS))


def test_toxicity_that_learned_nothing_calls_nothing_toxic(spark):
    text = "Clean words of no kind. " * 5_000
    d = spark.createDataFrame([(1, text), (2, "a b. c")], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(3, 1)]):
        lab = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity.report(d, lab, held=9).collect())


def test_toxicity_blocks_do_not_change_scores():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)] + ["averylongwordwithinnerletters", "日本語の文章は空白を持たない"]
    texts = [". ".join(" ".join(rng.choice(words, 7)) for _ in range(n)) for n in (1, 50, 700, 0, 3)]
    model = toxicity.Model(rng.normal(0, 0.5, 1 << toxicity.BITS), -4.0)
    want = []
    for t in texts:
        clean = 1.0
        for s in re.split(r"[.!?]+\s+|\n+", t.lower()):
            if w := dict.fromkeys(re.findall(r"\w+", s)):
                clean *= 1 - 1 / (1 + np.exp(-(sum(model.weights[list(toxicity.feature_ids(x, {}))].sum() for x in w) + model.bias)))
        want.append(1 - clean)
    assert model.document_scores(texts, {}) == pytest.approx(want, abs=1e-9)
    old, toxicity.BLOCK = toxicity.BLOCK, 64
    try:
        parts = list(toxicity.blocks(texts, {}, 64))
    finally:
        toxicity.BLOCK = old
    assert len(parts) > 50 and max(len(c) for c, _, _ in parts) < 64 + 7 * 30


def test_sample_is_filled_up_after_the_bounds(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(k, "x " * (5_000 if k % 2 else 10)) for k in range(100)] + [(0, "x again")], "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(100)], "doc_id long, toxic int")
    rows = toxicity.training_rows(d, lab, "toxic", F.lit(True), 40, 64 * 1_000)
    assert len(rows) == 40 == len({r["doc_id"] for r in rows}) and sum(r["y"] for r in rows) == 20 and all(len(r["text"]) < 1_000 for r in rows)
    assert sum(len(r["text"]) for r in toxicity.training_rows(d, lab, "toxic", F.lit(True), 40, 640)) <= 640


def plain_shards(rows, limit):
    """{(id, text): (shard, depth)} by splitting lists of rows on one bit after another."""
    key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], 16)
    out, todo = {}, [("", rows)]
    while todo:
        bits, own = todo.pop()
        if sum(len((r[1] or "").encode()) for r in own) <= limit or len(bits) == 60:
            out.update({r: bits for r in own})
        else:
            for b in "01":
                todo.append((bits + b, [r for r in own if format(key(r), "060b")[len(bits)] == b]))
    return out


@pytest.mark.parametrize("bound", [None, 0])
def test_sharding_against_plain_splits(spark, monkeypatch, bound):
    """With a broadcast directory and without; with a cell that the first bits can't split; a caller's own ``shard`` is kept."""
    from pyspark.sql import functions as F

    if bound is not None:
        monkeypatch.setattr(sharding, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    rows = [(k, "é" * rng.randint(0, 200)) for k in range(400)] + [(None, "z"), (7, None)]
    hot = [(1000, "h" * 90)] * 30
    d = spark.createDataFrame(rows + hot, "doc_id long, text string").withColumn("shard", F.lit("mine"))
    out = sharding.shard_rows(d, 1_000)
    assert out.columns == ["doc_id", "text", "shard", "bytes", "shard_", "shard_depth", "shard_bytes"]
    got, size = out.collect(), collections.Counter()
    want = plain_shards(rows, 10**9) | plain_shards(rows + hot, 1_000)
    for r in got:
        size[r.shard_] += r.bytes
        assert r.shard == "mine" and r.shard_.split("-")[0] == want[r.doc_id, r.text]
    assert len(got) == 432 and max(size.values()) <= 1_000 and all(size[r.shard_] == r.shard_bytes for r in got)


def test_mixed_rows_take_the_planned_turns(spark):
    """Rows that are equal in id and size get exactly the turns that were planned for them together."""
    rng = random.Random(6)
    rows = [(k // 4, " ".join(f"{'abc'[k % 3]}{k}" for _ in range(10 + k // 4 % 7)), "abc"[k // 4 % 3]) for k in range(1_200)] + [(None, "n m", None)] * 50
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = collections.Counter()
    for r in mixing.mix(d).collect():
        want[r.doc_id, r.size] += int(r.taken / r.size + 0.5)
    got = mixing.mixed_rows(d).collect()
    assert collections.Counter((r.doc_id, len(r.text.split())) for r in got) == +want
    each = collections.Counter((r.doc_id, r.text) for r in got)
    assert max(each[r[0], r[1]] for r in rows if r[0] is not None) <= 2


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    """A stretch of large pages among small ones; URLs with blanks at their ends."""
    rows = [(k, f" http://a/{k} %41\t", f"{k}" + "x" * (30_000 if 500 < k < 540 else 20)) for k in range(1_000)] + [(2_000, "big", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "w")
    warc.write(pages, path, archive_bytes=100_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert sizes[-2] <= 100_000 + 31_000 and sizes[-1] <= 301_000 and len(sizes) >= 12
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {k: (r.url, r.payload_bytes) for k, r in got.items()} == {k: (u, len(h)) for k, u, h in rows}


def test_islands_that_stay_apart_are_chained():
    x = np.zeros((6, 2), np.float32)
    layer = ann.Layer(np.arange(6), 1, 6)
    layer.near[:, 0] = [1, 0, 3, 2, 5, 4]
    ann.bridged(layer, x, rounds=0)
    assert layer.near.shape == (6, 3) and len(np.unique(ann.islands(layer.near))) == 1


def test_ann_over_shards(spark):
    """Shards answer alone and are merged: recall over all of them, blocks of queries smaller than the query set."""
    rng = np.random.default_rng(8)
    center = rng.normal(size=(20, 16))
    v = (center[rng.integers(0, 20, 3_000)] + 0.6 * rng.normal(size=(3_000, 16))).astype(np.float32)
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    graphs = ann.index(d, shard_rows=500)
    assert graphs.count() >= 6
    got = collections.defaultdict(dict)
    for r in ann.nearest(graphs, d.filter("vec_id % 20 = 0"), block=40).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    v, hit = v.astype(np.float64), 0
    for q, own in got.items():
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(set(own.values()) & set(np.argsort(-score)[:20]))
        assert sorted(own) == list(range(1, 21))
    assert len(got) == 150 and hit / 3_000 >= 0.95


def test_near_dedup_of_a_template_is_near_linear(spark, monkeypatch):
    """5,000 documents of one template, similar by about a half: few of their pairs meet, and planted copies are found."""
    dealt = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, name: (lambda out: (dealt.append(out.count()) if name == "groups" else None, out)[1])(common.cut(df, name)))
    frame = " ".join(f"t{k}" for k in range(40))
    rows = [(k, f"{frame} " + " ".join(f"d{k}x{j}" for j in range(20))) for k in range(5_000)]
    rows += [(10_000 + k, rows[k][1] + " more") for k in range(0, 5_000, 500)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 10_000 for i, _ in rows}
    assert sum(dealt) <= 6 * len(rows)


def test_substring_dedup_grows_spans(spark):
    """Short lines, run-ons and cut-out passages: spans grow to their least length, and run-ons are cut alike everywhere."""
    lines = "\n".join(f"row {k}" for k in range(500))
    words = " ".join(f"word{k}" for k in range(500))
    shout = "BUY!! NOW!! " * 20
    inside = " ".join(f"word{k}" for k in range(200, 260))
    texts = [lines, words, shout]
    rows = list(enumerate(texts)) + [(10 + k, t) for k, t in enumerate(texts)] + [(20, f"Something else before it {inside} and something else after it.")]
    got = {r.doc_id: r for r in substring_dedup.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == got[1].n_removed == 0 and got[0].clean_text == lines and got[1].clean_text == words
    assert all(got[10 + k].clean_text == "" for k in range(3))
    assert got[20].clean_text.startswith("Something else") and got[20].clean_text.endswith("after it.") and len(got[20].clean_text.split()) < 50
    for t in texts:
        assert "".join(substring_dedup.sentences(t, {})) == t
