"""Sub-projects of a source tree, by the files that mark them, and Go modules' names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks a project, in the order in which marks are listed, and how deep one may lie (fixed values).
MARKERS = ("package.json", "go.mod", "pyproject.toml", "setup.py", "Cargo.toml", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts")
DEEPEST = 2


def discover(files: DataFrame) -> DataFrame:
    """``prefix, markers`` of ``files (path)``: the folders, the root as an empty prefix, that hold a mark; not those below another
    marked folder, nor deeper than ``DEEPEST``. A tree without any is one scope without marks."""
    name = F.element_at(F.split("path", "/"), -1)
    marks = files.filter(name.isin(*MARKERS)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("prefix"), name.alias("mark")).distinct()
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    order = F.array_position(F.array(*map(F.lit, MARKERS)), F.col("mark"))
    own = marks.filter(depth <= DEEPEST).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "mark"))).alias("x"))
    own = own.select("prefix", F.transform("x", lambda x: x["mark"]).alias("markers"))
    above = own.filter("prefix <> ''").select(F.col("prefix").alias("a_prefix"))
    kept = own.join(above, F.substring_index("prefix", "/", 1) == F.col("a_prefix"), "left_anti").unionByName(own.filter(~F.col("prefix").contains("/")).join(above, F.col("prefix") == F.col("a_prefix"), "left_semi"))
    none = files.sparkSession.createDataFrame([("", [])], "prefix string, markers array<string>")
    found = kept.agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(none.join(F.broadcast(found)).filter("n = 0").drop("n"))


def go_modules(files: DataFrame) -> DataFrame:
    """``dir, module``: the names that ``go.mod`` files of ``files (path, text)`` give their folders."""
    own = files.filter((F.col("path") == "go.mod") | F.col("path").endswith("/go.mod"))
    module = F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)
    return own.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), module.alias("module")).filter("module <> ''")
