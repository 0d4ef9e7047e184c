"""Quality by a byte-level convolutional network in numpy.

Input. A text's UTF-8 bytes.
Network. FILTERS learned filters of WIDTH bytes are slid over the whole text; ReLU; max-pooled over chunks of two blocks of
BLOCK bytes, overlapping by one block, which cover the document; a learned layer gives each chunk a logit; their mean, over
all chunks, is the logit of the document's one probability.
Training. By Adam on the driver, gradients through the pooled maxima, on all chunks of at most SAMPLE labelled documents of
SAMPLE_BYTES together and SAMPLE_BYTES / 64 each (half of either label as far as they go); these bounds are parameters.
Executors score all chunks of all documents.

Nulls: a null or empty text is one chunk of zero bytes and scores what the network makes of it. A null id is held in no
fold. Labels that are null or contradict each other for one id are not learned from; with none at all, or of one kind only, every
text scores 0.5. Repeated rows are scored alike. Empty tables give no rows. Texts of any length are scored in segments of a
bounded number of blocks. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship, text_hash
from .toxicity import fold, training_rows

ship(__name__)

BLOCK = 256
FILTERS, WIDTH = 12, 6
SAMPLE, SAMPLE_BYTES = 4_000, 16 << 20
EPOCHS, BATCH, RATE = 8, 64, 0.01
SEGMENT = 384
SLICE = 1 << 20


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts, each filled up with zeros to whole blocks and WIDTH - 1 more bytes at least; blocks of each)."""
    blocks = np.array([-(-(len(t) + WIDTH - 1) // BLOCK) for t in texts])
    return np.frombuffer(b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks)), np.uint8), blocks


@dataclass
class Model:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    shift: np.ndarray  # FILTERS
    weight: np.ndarray  # FILTERS
    bias: float

    def pooled(self, code: np.ndarray) -> np.ndarray:
        """Each block's largest filter outputs."""
        padded = np.concatenate((code, np.zeros(WIDTH - 1, code.dtype)))
        out = np.empty((len(code) // BLOCK, FILTERS), np.float32)
        for a in range(0, len(out), SEGMENT):
            b = min(len(out), a + SEGMENT)
            x = self.taps[0].take(padded[a * BLOCK : b * BLOCK], axis=0)
            for k in range(1, WIDTH):
                x += self.taps[k].take(padded[a * BLOCK + k : b * BLOCK + k], axis=0)
            out[a:b] = x.reshape(b - a, BLOCK, FILTERS).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        code, blocks = codes(texts)
        block = self.pooled(code)
        chunk = block.copy()  # the chunk that begins with a block, and the next block of the same text
        inner = np.ones(len(block), bool)
        inner[np.cumsum(blocks) - 1] = False
        at = np.flatnonzero(inner)
        chunk[at] = np.maximum(block[at], block[at + 1])
        logit = chunk @ self.weight + self.bias
        # the last block begins no chunk of its own, unless it is the only one
        counted = inner.copy()
        counted[(np.cumsum(blocks) - 1)[blocks == 1]] = True
        owner = np.repeat(np.arange(len(blocks)), blocks)
        total = np.bincount(owner[counted], logit[counted], len(blocks)) / np.bincount(owner[counted], minlength=len(blocks))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def untrained() -> Model:
    rng = np.random.default_rng(11)
    return Model((rng.normal(0, 0.1, (WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    model, rng = untrained(), np.random.default_rng(12)
    if not len(texts) or labels.min() == labels.max():
        return model
    model.weight = rng.normal(0, 0.3, FILTERS).astype(np.float32)
    chunks, owner = [], []
    reach = 2 * BLOCK + WIDTH - 1
    for k, t in enumerate(texts):
        code, blocks = codes([t])
        code = np.concatenate((code, np.zeros(reach, code.dtype)))
        for s in range(max(1, int(blocks[0]) - 1)):
            piece = code[s * BLOCK : s * BLOCK + reach].copy()
            piece[min(reach, (int(blocks[0]) - s) * BLOCK) :] = 0
            chunks.append(piece)
            owner.append(k)
    x, owner = np.stack(chunks), np.array(owner)
    y = labels[owner].astype(np.float32)
    weight = (1 / np.bincount(owner))[owner]  # a document counts once
    share = labels.mean()
    weight = weight * np.sqrt(np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
    names = ("taps", "shift", "weight")
    first = {n: np.zeros_like(getattr(model, n)) for n in names} | {"bias": 0.0}
    second = {n: np.zeros_like(getattr(model, n)) for n in names} | {"bias": 0.0}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            code = x[own]
            z = model.taps[0].take(code[:, : 2 * BLOCK], axis=0)
            for k in range(1, WIDTH):
                z += model.taps[k].take(code[:, k : 2 * BLOCK + k], axis=0)
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + model.shift
            h = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(h @ model.weight + model.bias)))
            slope = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = slope[:, None] * model.weight * (top > 0)
            taps = np.zeros_like(model.taps)
            filters = np.broadcast_to(np.arange(FILTERS), best.shape)
            for k in range(WIDTH):
                np.add.at(taps[k], (np.take_along_axis(code, best + k, 1), filters), back)
            grads = {"taps": taps, "shift": back.sum(0), "weight": slope @ h + 1e-4 * model.weight, "bias": float(slope.sum())}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for n, g in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
                setattr(model, n, (getattr(model, n) - move).astype(np.float32) if n != "bias" else model.bias - float(move))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **names: str) -> Model:
    """``learn``: which labels may be learned from, an expression over the label's id as ``l_id``."""
    rows = training_rows(docs, labels, label, learn, sample, sample_bytes, **names)
    texts, y = [r["text"].encode() for r in rows], np.array([r["y"] for r in rows])
    del rows
    model = fit(texts, y)
    del texts
    give_back()
    return model


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out = np.empty(len(texts))
            a, held = 0, 0
            for k in range(len(texts) + 1):
                if k > a and (k == len(texts) or held + len(texts[k]) > SLICE):
                    out[a:k] = model.scores(texts[a:k])
                    a, held = k, 0
                held += len(texts[k]) if k < len(texts) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out)], names=["doc_id", "th", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, score``, the probability of good quality."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, th long, score double")


def report(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, **names: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, held_out, score, predicted``; fold ``held`` of ``parts`` is never learned from."""
    model = train(docs, labels, fold(F.col("l_id"), parts) != held, **names)
    out = score(docs, model, **names)
    return out.select("doc_id", "th", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
