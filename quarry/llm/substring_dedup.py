"""Substring dedup by sliding sentence spans.

A sentence ends after a run of . ! ? and white space, or after a line break. One of more than ``BOUND`` words, a run-on, is cut
after each of its words whose MD5 begins with a byte below ``CUT``, so that equal passages are cut at the same places whatever
stands around them. A span runs over consecutive sentences: from each one on, and back from each one, over ``RUN`` of them at
least and as many as it takes to reach ``LEAST`` characters. Every span is hashed (128 bits) and the hashes are joined over the
whole corpus: the first occurrence of a span, by document id and place, stays; each sentence covered by any other occurrence is
removed. Within a document only the first of equal spans goes into the join, so a document counts once for each; the join itself
sees, for each hash, a count and the smallest id, pre-aggregated before the shuffle, so a passage in a third of all documents is
a partial count in every task and its occurrences are spread by the skew join.

Not found: what is less than ``RUN`` whole sentences, such as the edges of a passage that was cut inside a sentence.

Nulls: a null text has no sentences; a null id comes last in the order of ids. Rows that share an id never strip each
other, but each is stripped by itself and by smaller ids. Documents of fewer sentences than ``RUN`` or of less than ``LEAST``
characters have no span and stay whole. Texts of any length are used whole. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_hash

ship(__name__)

RUN, LEAST = 2, 120
BOUND, CUT = 30, 32
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*")
BREAK = re.compile(r"[.!?]+[ \t\n\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*")
#: The largest long stands for a null id.
LAST = (1 << 63) - 1
MEMO = 200_000


def sentences(text: str, memo: dict[str, bool]) -> list[str]:
    """The text's sentences, each with the white space after it; joined they are the text. ``memo``: which words end a cut."""
    out, a = [], 0
    for b in [*(m.end() for m in BREAK.finditer(text)), len(text)]:
        piece = text[a:b]
        # str.split knows more white space, so it never finds fewer words
        if b - a > 2 * BOUND and len(piece.split()) > BOUND and len(words := WORD.findall(piece)) > BOUND:
            at = len(piece) - sum(map(len, words))  # white space at the very start
            begin = 0
            for w in words:
                at += len(w)
                cut_here = memo.get(w)
                if cut_here is None:
                    cut_here = hashlib.md5(w.rstrip(SPACE).encode()).digest()[0] < CUT
                    if len(memo) < MEMO:
                        memo[w] = cut_here
                if cut_here:
                    out.append(piece[begin:at])
                    begin = at
            piece = piece[begin:]
        if piece:
            out.append(piece)
        a = b
    return out


def _grown(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs from each sentence and up to each that have ``RUN`` sentences and ``LEAST`` characters."""
    found = set()
    upto = [0, *itertools.accumulate(sizes)]
    n, end = len(sizes), 0
    for first, ahead in enumerate(upto):
        end = max(end, first + RUN)
        while end <= n and upto[end] - ahead < LEAST:
            end += 1
        if end > n:
            break
        found.add((first, end))
    first = 0
    for end in range(RUN, n + 1):
        total = upto[end]
        if total < LEAST:
            continue
        while first < end - RUN and total - upto[first + 1] >= LEAST:
            first += 1
        found.add((first, end))
    return sorted(found)


def digests_of(own: list[str], ends: list[tuple[int, int]]) -> list[bytes]:
    return [xxhash.xxh3_128_digest("\x1f".join(own[i:j])) for i, j in ends]


def runs(pieces: list[str]) -> list[tuple[int, int, bytes]]:
    """(first, last, digest) of each span, in order; white space only is no sentence."""
    real = [(k, s) for k, p in enumerate(pieces) if (s := p.strip(SPACE))]
    own = [s for _, s in real]
    ends = _grown([len(s) for s in own])
    return [(real[i][0], real[j - 1][0], d) for (i, j), d in zip(ends, digests_of(own, ends))]


SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
BATCH = 100_000


def _spans(batches):
    memo = {}
    for batch in batches:
        docs, ths, counts, pos, digests = [], [], [], [], []

        def full():
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.empty((0, 2), np.int64)
            each = np.array(counts, np.int64)
            names = (np.repeat(np.array(x, np.int64), each) for x in (docs, ths))
            return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(pos, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], schema=SPAN)

        for doc, th, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = [s for p in sentences(text, memo) if (s := p.strip(SPACE))]
            found = digests_of(own, _grown([len(s) for s in own]))
            first = dict(zip(found[::-1], range(len(found) - 1, -1, -1)))  # of equal spans the first one's number
            docs.append(doc)
            ths.append(th)
            counts.append(len(first))
            pos += first.values()
            digests += first
            if len(digests) >= BATCH:
                yield full()
                docs, ths, counts, pos, digests = [], [], [], [], []
        yield full()


CLEAN = "doc_id long, th long, n_sentences long, n_repeated long, n_removed long, clean_text string, clean_sha256 string"


def _packed(batches):
    """Texts as they are shuffled: a third of their size."""
    for batch in batches:
        packed = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "th", "text"])


def _stripped(batches):
    memo = {}
    for batch in batches:
        out = []
        for doc, th, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                out.append((doc, th, 0, 0, 0, None, hashlib.sha256(b"").hexdigest()))
                continue
            pieces = sentences(zlib.decompress(text).decode(), memo)
            marks = {m >> 1: m & 1 for m in marks or ()}  # number of a run -> whether another document has it first
            drop, again, seen = set(), set(), set()
            for k, (first, last, digest) in enumerate(runs(pieces)):
                span = range(first, last + 1)
                if k in marks:
                    again.update(span)
                    if marks[k]:
                        drop.update(span)
                if digest in seen:
                    again.update(span)
                    drop.update(span)
                seen.add(digest)
            real = {k for k, p in enumerate(pieces) if p.strip(SPACE)}
            clean = "".join(p for k, p in enumerate(pieces) if k not in drop)
            out.append((doc, th, len(real), len(again & real), len(drop & real), clean, hashlib.sha256(clean.encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[c.split()[0] for c in CLEAN.split(", ")])


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, n_sentences, n_repeated`` (in any repeated span), ``n_removed, clean_text, clean_sha256``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("text"))
    given = rows.filter(F.col("text").isNotNull()).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "th", "text")
    # found once to be counted and once to be joined: they are larger than the texts, and aren't kept
    spans = given.mapInArrow(_spans, "doc_id long, th long, pos int, h1 long, h2 long")
    often = spans.groupBy(F.col("h1").alias("o1"), F.col("h2").alias("o2")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    often = often.filter("first <> last").drop("last")
    marks = spans.join(often, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")))
    mark = F.col("pos") * 2 + F.when(F.col("doc_id") > F.col("first"), 1).otherwise(0)
    # a document's own marks: no more than twice its sentences
    marks = marks.groupBy(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th")).agg(F.collect_set(mark).alias("marks"))
    packed = rows.mapInArrow(_packed, "doc_id long, th long, text binary")
    both = packed.join(marks, (F.coalesce("doc_id", F.lit(LAST)) == F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    return both.select("doc_id", "th", "text", "marks").mapInArrow(_stripped, CLEAN)
