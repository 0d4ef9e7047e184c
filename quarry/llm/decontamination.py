"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, in DataFrame operations only.

Words: A-Z lower-cased, then runs of other than ASCII non-letters, non-digits. A window is ``window`` consecutive words of
an item, or the whole item if it has fewer. To hold a window, a document must hold every shingle (pair of neighbouring
words) of it, so one necessary shingle, the rarest in the corpus, is its prefix: only documents' shingles that are some
window's prefix are joined. A match fixes where the window would begin; the length bound (the document has words enough)
and the positional bound (it begins at or after the first word) are applied at once, and what is left is verified word by
word on the document itself. Candidates are found on words lower-cased by Unicode one at a time, on both sides: words that are
equal once A-Z are lower-cased stay equal, whatever stands around them, so none is missed (lower-casing whole texts would
miss some: a capital sigma's small letter depends on what follows). Only documents with candidates pay for the exact case.

Nulls: a null text has no words, a null id is an id like any other. Items without words have no window; items that repeat
or share windows are all counted. Rows that repeat give equal rows. Empty tables give no rows, or zero counts. Very long
texts: candidates grow with the occurrences of prefixes, which are the rarest shingles of their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, cut, packed, small, text_hash, unpacked

WINDOW = 8
MIN_ITEMS = 2
SPANS = "array<struct<begin:int,wlen:int,win:bigint>>"
#: What lies between words (fixed values: all ASCII but digits and letters), whether or not A-Z are lower-cased yet
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, GAP), lambda w: w != ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(w: Column) -> Column:
    """The shingles of a list of words, one for each word but the last."""
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def windows_of(bench: DataFrame, window: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(distinct windows ``win, wlen, wtext``, owners ``win, item``)."""
    b = bench.select(F.col(item_id).cast("string").alias("item"), words(ascii_lower(F.col(text))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    spans = b.select("item", n.alias("wlen"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))).alias("at", "wtext"))
    owners = spans.select("wtext", "wlen", "item").distinct().withColumn("win", F.xxhash64("wtext"))
    owners = cut(owners, "windows")
    return owners.select("win", "wlen", "wtext").distinct(), owners.select("win", "item").distinct()


def candidates(docs: DataFrame, wins: DataFrame, n_wins: int) -> DataFrame:
    """``doc_id, th, begin, win, wtext, wlen`` where a prefix and both bounds agree. ``docs``: doc_id, text."""
    tokens = docs.filter(F.col("text").isNotNull()).select("doc_id", text_hash(F.col("text")).alias("th"), F.transform(words(F.col("text")), F.lower).alias("w"))
    single = F.xxhash64(F.lit("one"), F.lower("wtext"))
    shingles = wins.select("win", "wlen", "wtext", F.split("wtext", " ").alias("w"))
    shingles = shingles.select("win", "wlen", "wtext", F.posexplode(F.when(F.size("w") > 1, pairs(F.transform("w", F.lower))).otherwise(F.array(single))).alias("off", "sh"))
    shingles = cut(shingles, "shingles")
    seen = tokens.filter(F.size("w") > 1).select("doc_id", "th", F.size("w").alias("n"), F.posexplode(pairs(F.col("w"))).alias("at", "h"))
    if not wins.filter("wlen = 1").isEmpty():
        ones = tokens.select("doc_id", "th", F.size("w").alias("n"), F.posexplode(F.transform("w", lambda x: F.xxhash64(F.lit("one"), x))).alias("at", "h"))
        seen = seen.unionByName(ones)
    # one pass over all texts: the places of shingles that some window has, for counting and for joining
    seen = cut(among(seen, "h", shingles, "sh", shingles.count()), "places")
    counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
    # windows with a shingle that no document holds drop out here
    rare = shingles.join(counts, F.col("sh") == F.col("h"), "left").groupBy("win").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "sh")).alias("best"))
    prefix = rare.filter("best.freq > 0").select(F.col("win").alias("p_win"), F.col("best.off").alias("off"), F.col("best.sh").alias("sh"))
    prefix = cut(prefix.join(wins, F.col("p_win") == F.col("win")).drop("p_win"), "prefixes")
    hit = seen.join(small(prefix, n_wins), F.col("h") == F.col("sh"))
    begin = F.col("at") - F.col("off")
    return hit.filter((begin >= 0) & (begin + F.col("wlen") <= F.col("n"))).select("doc_id", "th", begin.alias("begin"), "win", "wtext", "wlen")


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per row of ``docs``: ``doc_id, th, n_words, hits`` with hits an array of (begin, wlen, win) in order of begin; owners)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    wins, owners = windows_of(bench, window, item_id, item_text)
    wins = cut(wins, "distinct_windows")
    n_wins = wins.count()
    found = candidates(docs, wins, n_wins)
    # a document has a bounded number of candidates for each of its words: those windows that share a prefix
    found = found.groupBy(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).agg(F.collect_set(F.struct("begin", "wlen", "win", "wtext")).alias("c"))
    both = docs.withColumn("th", text_hash(F.col("text"))).join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left")
    both = both.select("doc_id", "th", "c", words(F.when(F.col("c").isNull(), F.col("text")).otherwise(ascii_lower(F.col("text")))).alias("w"))
    true = F.filter("c", lambda x: F.array_join(F.slice(F.col("w"), x["begin"] + 1, x["wlen"]), " ") == x["wtext"])
    hits = F.array_sort(F.transform(true, lambda x: F.struct(x["begin"], x["wlen"], x["win"])))
    return both.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.coalesce(hits.cast(SPANS), F.array().cast(SPANS)).alias("hits")), owners


def covered(hits: Column) -> Column:
    """Words inside any of the spans, which come in order of begin."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = F.greatest(acc["end"], x["begin"] + x["wlen"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["begin"])).cast("long").alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, **names: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows, owners = scan(docs, bench, window, **names)
    rows = cut(rows.select("doc_id", "th", "n_words", covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["win"])).alias("wins")), "hits")
    held = rows.filter(F.size("wins") > 0).select("doc_id", "th", F.explode("wins").alias("d_win")).distinct()
    items = held.join(small(owners, owners.count()), F.col("d_win") == F.col("win")).groupBy(F.col("doc_id").alias("i_id"), F.col("th").alias("i_th"))
    items = items.agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    both = rows.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("th") == F.col("i_th")), "left")
    n = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items"))
    digest = F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256)
    return both.select("doc_id", "th", "n_words", "n_hit", n.cast("long").alias("n_items"), digest.alias("items_sha256"), (n >= min_items).alias("contaminated"))


def clean_rows(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are contaminated; columns unchanged."""
    bad = report(docs, bench, doc_id=doc_id, text=text, **options).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    rows = packed(docs, own_id=F.col(doc_id), own_th=text_hash(F.col(text)))
    return unpacked(rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_th") == F.col("bad_th")), "left_anti"), docs)
