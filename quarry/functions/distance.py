"""Edit distance with transpositions, and suggestions for misspelt names."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Suggestions are at most this far and at least this alike (fixed values).
FARTHEST, ALIKE = 3, 0.4


def distance(a: str, b: str, most: int = FARTHEST) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, each 1; anything over ``most`` is ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def suggestions(names: DataFrame, wanted: str, n: int = 8) -> DataFrame:
    """``name, far`` of the nearest of ``names (name)``: equal but for case and separators first, else the least distance within
    bounds. Lengths are compared before any distance is computed."""
    flat = lambda c: F.lower(F.translate(c, "_-", ""))
    own = names.select("name").distinct().filter(F.abs(F.length("name") - len(wanted)) <= FARTHEST)
    # a swap is two plain edits: what is further than that on the JVM needs no look by Python
    own = own.filter(F.levenshtein(F.lower("name"), F.lit(wanted.lower()), 2 * FARTHEST) >= 0)
    rows = own.withColumn("far", F.when(flat(F.col("name")) == flat(F.lit(wanted)), F.lit(0)).otherwise(osa_distance(F.lower("name"), F.lit(wanted.lower()))))
    alike = 1 - F.col("far") / F.greatest(F.length("name"), F.lit(len(wanted)))
    rows = rows.filter((F.col("far") <= FARTHEST) & (alike > ALIKE))
    least = rows.agg(F.min("far").alias("least"))
    return rows.join(F.broadcast(least)).filter("far = least").select("name", "far").orderBy("name").limit(n)
