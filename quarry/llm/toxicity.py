"""Toxicity by multiple-instance learning: sentences are scored, and a document is toxic unless every sentence is clean.

A sentence's score is the logistic of a bias and the summed weights of its distinct words' features (the word, its beginnings
of three to six letters, and the inner runs of four letters of a word of more than ``LONG``, as scripts without spaces have
them; all hashed to 2**BITS columns); a document's is the noisy-or of its sentences'. The weights are learned from document
labels only, by the gradient of the noisy-or, so blame goes to the sentences that explain a label, and the same scores then
locate them.

The model is fitted on the driver on at most SAMPLE labelled documents of SAMPLE_BYTES together and SAMPLE_BYTES / 64 each,
taken by a hash of their ids in equal numbers from either label as far as they go; these bounds are parameters. Everything else,
whole texts of all documents, is scored by executors. A fold column names rows whose labels must not be learned from.

Nulls: a null or empty text has no sentence and scores 0. A null id is held in no fold (its label can't be found). Labels that
are null, or contradict each other for one id, are not learned from. Repeated rows are scored alike. With labels of one kind
only, or none, nothing can be learned and every text scores next to 0, however long it is. Empty tables give no rows. Very long
texts are encoded and scored in blocks of sentences of a bounded number of features, all of them. Other columns are left out of
scores, and kept by ``clean_rows``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, ship, text_hash

ship(__name__)

BITS = 18
SAMPLE, SAMPLE_BYTES = 6_000, 24 << 20
EPOCHS, BATCH, RATE, DECAY = 24, 256, 0.3, 1e-4
#: Documents of the sample that a column must occur in to get a weight.
LEAST_DOCS = 2
#: Where learning starts, and where it stays if there is nothing to learn: a billion sentences are clean together.
START_BIAS, CLEAN_BIAS = -5.0, -60.0
#: Words of more letters are also known by what is inside them; words up to MEMO_LETTERS are remembered.
LONG, MEMO, MEMO_LETTERS = 12, 200_000, 40
#: Features that are held at a time.
BLOCK = 1 << 20
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
WORD = re.compile(r"\w+")


def feature_ids(word: str, memo: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    """Columns of a word."""
    got = memo.get(word)
    if got is None:
        names = {"^" + word[:k] for k in range(3, 7) if len(word) > k} | {"=" + word}
        if len(word) > LONG:
            names.update("~" + word[k : k + 4] for k in range(4, len(word) - 3))
        got = tuple(zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in sorted(names))
        if len(memo) < MEMO and len(word) <= MEMO_LETTERS:
            memo[word] = got
    return got


def lowered(text: str) -> str:
    """The text in small letters, each in its place."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their number
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of each sentence that has a word."""
    at = 0
    for m in SENTENCE.finditer(text):
        if WORD.search(text, at, m.end()):
            yield at, m.end()
        at = m.end()
    if WORD.search(text, at):
        yield at, len(text)


def blocks(texts: Iterable[str], memo: dict, most: float = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of sentences of about ``most`` features at most: (columns, the place of each sentence's first one, its text's number)."""
    cols, starts, owner = array("i"), array("q"), array("q")
    for k, text in enumerate(texts):
        low = lowered(text)
        for a, b in sentences(low):
            starts.append(len(cols))
            owner.append(k)
            for w in dict.fromkeys(WORD.findall(low, a, b) if b - a < BLOCK else (m[0] for m in WORD.finditer(low, a, b))):
                cols.extend(feature_ids(w, memo))
            if len(cols) >= most:
                yield np.frombuffer(cols, np.int32), np.frombuffer(starts, np.int64), np.frombuffer(owner, np.int64)
                cols, starts, owner = array("i"), array("q"), array("q")
    if starts:
        yield np.frombuffer(cols, np.int32), np.frombuffer(starts, np.int64), np.frombuffer(owner, np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, cols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.add.reduceat(self.weights[cols], starts) + self.bias)))

    def document_scores(self, texts: list[str], memo: dict) -> np.ndarray:
        clean = np.zeros(len(texts))
        for cols, starts, owner in blocks(texts, memo):
            clean += np.bincount(owner, np.log1p(-np.minimum(self.sentence_scores(cols, starts), 1 - 1e-12)), len(texts))
        return -np.expm1(clean)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """Minimise the log loss of the noisy-or by AdaGrad on the documents' labels, the rarer label weighted up."""
    model = Model(np.zeros(1 << BITS), START_BIAS)
    # the arrays hold the sample once, in four bytes a feature
    found = list(blocks(texts, {}, float("inf"))) if len(texts) else []
    counts = np.bincount(found[0][2], minlength=len(texts)) if found else np.zeros(len(texts), np.int64)
    if not found or labels[counts > 0].min() == labels[counts > 0].max():
        return Model(model.weights, CLEAN_BIAS)
    cols, starts, _ = found[0]
    ends = np.append(starts[1:], len(cols))
    first = np.cumsum(counts) - counts
    docs_with = np.zeros(1 << BITS, np.int32)
    for d in np.flatnonzero(counts):
        docs_with[np.unique(cols[starts[first[d]] : ends[first[d] + counts[d] - 1]])] += 1
    rare = docs_with < LEAST_DOCS
    squared, squared_bias = np.full(1 << BITS, 1e-3), 1.0
    rng = np.random.default_rng(seed)
    usable = np.flatnonzero(counts)
    share = max(1e-9, labels[usable].mean()) if len(usable) else 0.5
    cost = np.sqrt(np.where(labels == 1, 0.5 / share, 0.5 / max(1e-9, 1 - share)))
    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            sent = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), counts[docs])
            length = ends[sent] - starts[sent]
            at = np.repeat(starts[sent] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            own, whose = cols[at], np.repeat(np.arange(len(sent)), length)
            z = np.bincount(whose, model.weights[own], len(sent)) + model.bias
            p = 1 / (1 + np.exp(-z))
            clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs))
            toxic = np.maximum(-np.expm1(clean), 1e-9)
            y = labels[docs]
            # d loss / d z of a sentence: p for clean documents, -p (1 - toxic) / toxic for toxic ones
            slope = np.where(y[owner] == 1, -p * ((1 - toxic) / toxic)[owner], p) * cost[docs][owner] / len(docs)
            grad = np.bincount(own, slope[whose], 1 << BITS)
            grad[rare] = 0
            hit = np.flatnonzero(grad)
            g = grad[hit] + DECAY / len(order) * model.weights[hit]
            squared[hit] += g * g
            model.weights[hit] -= RATE * g / np.sqrt(squared[hit])
            gb = slope.sum()
            squared_bias += gb * gb
            model.bias -= RATE * gb / np.sqrt(squared_bias)
    return model


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, sample_bytes: int, doc_id: str = "doc_id", text: str = "text") -> list:
    """At most ``sample`` rows (text, y) of ``sample_bytes`` together, of either label half if there are as many; ids in hash
    order. Texts of more than a 64th of these bytes are passed over, and others take their places. One text for each id."""
    lab = labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("y")).filter("l_id IS NOT NULL AND y IN (0, 1)")
    lab = lab.filter(learn).groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    sizes = own.select("doc_id", text_hash(F.col("text")).alias("th"), F.octet_length("text").alias("n")).filter(F.col("n") <= sample_bytes // 64)
    sizes = sizes.join(lab, F.col("doc_id") == F.col("l_id")).groupBy("l_id", "y").agg(F.min(F.struct("th", "n")).alias("one")).select("l_id", "y", "one.*")
    key = F.xxhash64(F.lit("sample"), "l_id")
    half = [sizes.filter(F.col("y") == y).orderBy(key, "l_id").limit(sample // 2) for y in (0, 1)]
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(key, "l_id"))  # over `sample` rows at most
    chosen = half[0].unionByName(half[1]).withColumn("upto", upto).filter(F.col("upto") <= sample_bytes // 2).select("l_id", F.col("th").alias("l_th"), "y")
    rows = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("l_id")) & (text_hash(F.col("text")) == F.col("l_th"))).dropDuplicates(["l_id"])
    return rows.select(key.alias("key"), "doc_id", "text", "y").orderBy("key", "doc_id").toArrow().to_pylist()


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **names: str) -> Model:
    """``learn``: which labels may be learned from, an expression over the label's id as ``l_id``."""
    rows = training_rows(docs, labels, label, learn, sample, sample_bytes, **names)
    texts, y = [r["text"] for r in rows], np.array([r["y"] for r in rows])
    del rows
    model = fit(texts, y)
    del texts
    give_back()
    return model


def _model(weights: bytes, bias: float) -> Model:
    return Model(np.frombuffer(weights, np.float32).astype(np.float64), bias)


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, score``."""
    given = model.weights.astype(np.float32).tobytes(), model.bias

    def run(batches):
        own, memo = _model(*given), {}
        for batch in batches:
            out = own.document_scores(_texts(batch.column("text")), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out)], names=["doc_id", "th", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, score double")


def clean_rows(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; columns unchanged."""
    given = model.weights.astype(np.float32).tobytes(), model.bias

    def run(batches):
        own, memo = _model(*given), {}
        for batch in batches:
            yield batch.filter(pa.array(own.document_scores(_texts(batch.column(text)), memo) < least))

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The offending sentences: ``doc_id, begin, end`` (code points), ``sentence, score`` of those at ``least`` or more."""
    given = model.weights.astype(np.float32).tobytes(), model.bias

    def run(batches):
        own, memo = _model(*given), {}
        for batch in batches:
            for doc, t in zip(*(c.to_pylist() for c in batch.columns)):
                t = t or ""
                p = [x for cols, starts, _ in blocks([t], memo) for x in own.sentence_scores(cols, starts)]
                hits = [(doc, a, b, t[a:b], float(s)) for (a, b), s in zip(sentences(lowered(t)), p) if s >= least]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=["doc_id", "begin", "end", "sentence", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, begin int, end int, sentence string, score double")


def report(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, **names: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``; fold ``held`` of ``parts`` is never learned from."""
    model = train(docs, labels, fold(F.col("l_id"), parts) != held, **names)
    out = score(docs, model, **names)
    return out.select("doc_id", "th", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
