"""Source trees as DataFrames: listing, skip rules, decoding, hashes, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never listed (unless included by name), the size cap, and suffixes with their language,
#: longest first, and the family within which names resolve.
SKIPPED = ("node_modules", "dist", "build", "_build", "out", "target", "vendor", "coverage", "__pycache__", "venv")
MOST_BYTES = 1_000_000
LANGUAGES = (
    (".tsx", "tsx", "js"), (".jsx", "jsx", "js"), (".mts", "typescript", "js"), (".cts", "typescript", "js"),
    (".ts", "typescript", "js"), (".mjs", "javascript", "js"), (".cjs", "javascript", "js"), (".js", "javascript", "js"),
    (".pyi", "python", "python"), (".py", "python", "python"), (".go", "go", "go"), (".java", "java", "java"),
    (".rs", "rust", "rust"), (".cpp", "cpp", "c"), (".hpp", "cpp", "c"), (".cc", "cpp", "c"), (".c", "c", "c"), (".h", "c", "c"), (".sql", "sql", "sql"),
)


def language_of(path: Column) -> Column:
    low, out = F.lower(path), F.lit(None).cast("string")
    for ext, label, _ in reversed(LANGUAGES):
        out = F.when(low.endswith(ext), label).otherwise(out)
    return out


def family_of(path: Column) -> Column:
    low, out = F.lower(path), F.lit(None).cast("string")
    for ext, _, family in reversed(LANGUAGES):
        out = F.when(low.endswith(ext), family).otherwise(out)
    return out


def listed(path: Column, include: tuple[str, ...] = ()) -> Column:
    """Whether no folder of a relative path is to be skipped: dot folders always, SKIPPED ones unless included by name."""
    names = [n for n in SKIPPED if n not in include]
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.exists(folders, lambda x: x.startswith(".") | x.isin(*names))


def decoded(content: Column) -> Column:
    """UTF-8 (malformed bytes become U+FFFD), a UTF-8 mark dropped, UTF-16 little-endian by its mark; big-endian is null."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.make_valid_utf8(content.cast("string"))
    body = lambda n: F.substring(content, F.lit(n), F.octet_length(content))
    return (
        F.when(head == "EFBBBF", F.make_valid_utf8(body(4).cast("string")))
        .when(head.startswith("FFFE"), F.decode(body(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.lit(None).cast("string"))
        .otherwise(utf8)
    )


def passed_over(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modificationTime, content`` of files below ``root`` that Spark's readers leave out, since their names, or a
    folder's above them, begin with an underscore (or a file's with a dot): packages' own modules are among them. They are looked
    for by name, a depth at a time, and of at most MOST_BYTES bytes each; a tree's few, read by the driver through the file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows: dict[str, tuple] = {}

    def keep(status) -> None:
        path = status.getPath()
        if status.getLen() <= MOST_BYTES and any(path.getName().lower().endswith(ext) for ext, _, _ in LANGUAGES):
            stream = fs.open(path)
            try:
                content = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            rows[path.toString()] = (path.toString(), status.getLen(), status.getModificationTime() / 1000, content)

    at = root.rstrip("/")
    while (level := fs.globStatus(hadoop.Path(at + "/*"))) is not None and len(level):
        for status in [*(fs.globStatus(hadoop.Path(at + "/_*")) or []), *(fs.globStatus(hadoop.Path(at + "/.*")) or [])]:
            if not status.isDirectory():
                keep(status)
            elif status.getPath().getName().startswith("_"):
                inside = fs.listFiles(status.getPath(), True)
                while inside.hasNext():
                    keep(inside.next())
        at += "/*"
    schema = "path string, length long, t double, content binary"
    return spark.createDataFrame(list(rows.values()), schema).select("path", "length", F.timestamp_seconds("t").alias("modificationTime"), "content")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = (), only: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """``path`` (below ``root``), ``size, mtime_ms, text, hash, language, family``: files with a known suffix, not empty, of at most
    MOST_BYTES bytes, not below a skipped folder, and below one of ``only`` if any is given. A file system that lists with
    its own rules (say, what a version control shows) can be joined on ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.select("path", "length", "modificationTime", "content").unionByName(passed_over(spark, root))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    rows = raw.filter(F.col("length") <= MOST_BYTES).select(rel.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    rows = rows.filter(listed(F.col("path"), include) & language_of(F.col("path")).isNotNull())
    if only:
        rows = rows.filter(" OR ".join(f"path = '{o}' OR startswith(path, '{o}/')" for o in (x.strip('/') for x in only)))
    if extensions:
        rows = rows.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    rows = rows.withColumn("text", decoded(F.col("content"))).drop("content")
    return rows.select("path", "size", "mtime_ms", "text", F.sha2("text", 256).alias("hash"), language_of(F.col("path")).alias("language"), family_of(F.col("path")).alias("family"))


def fingerprint(files: DataFrame) -> DataFrame:
    """What an incremental build compares: ``path, size, mtime_ms, hash``."""
    return files.select("path", "size", "mtime_ms", "hash")


def changed_since(files: DataFrame, before: DataFrame, by_hash: bool = False) -> DataFrame:
    """``path, status``: added, removed, changed. Equal size and time count as unchanged unless ``by_hash``; a file that can't
    be read now but could before has changed."""
    b = before.select(F.col("path").alias("b_path"), F.col("size").alias("b_size"), F.col("mtime_ms").alias("b_time"), F.col("hash").alias("b_hash"))
    a = fingerprint(files)
    quiet = (F.col("size") == F.col("b_size")) & (F.col("mtime_ms") == F.col("b_time")) if not by_hash else F.lit(False)
    same = quiet | F.col("hash").eqNullSafe(F.col("b_hash"))
    status = F.when(F.col("b_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(~same, "changed")
    return a.join(b, F.col("path") == F.col("b_path"), "full_outer").select(F.coalesce("path", "b_path").alias("path"), status.alias("status")).filter("status IS NOT NULL")
