"""WARC archives with revisit records, written and read back.

Writing: headers (digest, length, id, no payload) are shuffled by payload digest; of equal payloads of ``least`` bytes or
more, the one of the largest id is kept as a response and the others become revisit records that name it. Records are
joined, where they lie, to archives that end once ``archive_bytes`` are reached (so none is larger by more than one record),
and written by Spark's text writer, a file each, with the record end (two CRLF) as line separator: archives are plain WARC 1.1
files in the shared folder and a lost executor's files are written again. Record ids are made from the page's id and digest, so
reruns agree.

Reading: each archive is parsed by its Content-Length fields, never by looking for a separator that a payload may hold, and
each response's digest is computed from its bytes again. Revisits are then joined to responses by digest and id, to get
the full payload's length.

Nulls: a null payload is empty; a null page id is never the largest and reads back as null; a null URL reads back as null.
Rows that repeat an id and a payload are each written; those of the largest id are each a response. Blanks,
line ends and percent signs in URLs are percent-encoded in headers and decoded on reading. Empty tables give no rows, and no
archive. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, ship, small

ship(__name__)

END = "\r\n\r\n"
ARCHIVE_BYTES = 16 * 1024 * 1024
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits, or four digits, at a time."""
    code = F.sha1(payload)
    letter = lambda v, shift: F.substring(F.lit(ALPHABET), (F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1), F.lit(1))
    parts = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(code, i + 1, 5), 16, 10).cast("int")
        parts += [letter(v, s) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def headers(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id, url, payload`` (null in revisits), ``digest, bytes, record_type, refers_to``."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    slim = cut(rows.select("page_id", "digest", "bytes"), "headers")
    kept = slim.filter(F.col("bytes") >= least).groupBy(F.col("digest").alias("k_digest"), F.col("bytes").alias("k_bytes"))
    # most payloads are alone and need no record of it, and hot ones are split by the join
    kept = cut(kept.agg(F.max("page_id").alias("k_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared_payloads")
    kept = small(kept, kept.count())
    rows = rows.join(kept, (F.col("digest") == F.col("k_digest")) & (F.col("bytes") == F.col("k_bytes")), "left")
    other = F.col("k_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("k_id"))
    return rows.select(
        "page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "digest", "bytes",
        F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("k_id")).alias("refers_to"),
    )


def named(page_id: Column, digest: Column) -> Column:
    """A record id that depends on the page and its payload only."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """The text of each record, without its end."""
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))
    clean = F.col("url")
    for c in "%\r\n\t\x0b\x0c ":
        clean = F.replace(clean, F.lit(c), F.lit(f"%{ord(c):02X}"))
    revisit = F.col("record_type") == "revisit"
    target = named(F.col("refers_to"), F.col("digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, target)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("refers_to")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.coalesce(F.octet_length("payload"), F.lit(0))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.coalesce("payload", F.lit(""))).alias("value"))


def _archives(most: int):
    """Joins records to archives of ``most`` bytes; the last one's end is the writer's."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                parts.append(value)
                held += len(value) + len(END)
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(parts)], pa.large_binary()).cast(pa.large_string())], names=["value"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(parts)], pa.large_binary()).cast(pa.large_string())], names=["value"])

    return run


def write(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "none", **names: str) -> None:
    """Write ``pages`` as archives of ``archive_bytes``, and up to one record more, below ``path``."""
    # payloads go from the scan straight to the archives
    archives = records(headers(pages, least, **names)).mapInArrow(_archives(archive_bytes), "value string")
    archives.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", 1).text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive: (headers by lower-case name, payload)."""
    at = 0
    while m := HEAD.match(data, at):
        fields = dict((k.strip().lower(), v.strip()) for k, v in (x.split(b":", 1) for x in m[1].split(b"\r\n")))
        end = m.end() + int(fields[b"content-length"])
        yield fields, memoryview(data)[m.end() : end]
        at = end + len(END)
    if at < len(data):
        raise ValueError(f"no WARC record at byte {at}")


def _parsed(batches):
    for batch in batches:
        for data in batch.column(0):
            out = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")}
            for f, payload in parse(data.as_buffer().to_pybytes()):
                number = lambda name, f=f: int(f[name]) if name in f else None
                kind, uri = f[b"warc-type"].decode(), f.get(b"warc-target-uri")
                response = kind == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else f[b"warc-payload-digest"].decode().removeprefix("sha1:")
                url = None if uri is None else unquote(uri.decode())
                for k, v in zip(out, (number(b"x-page-id"), url, kind, number(b"x-refers-to-page-id"), digest, len(payload) if response else None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``, revisits resolved: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes``.
    One archive at a time is in a task's memory, so archives should be written of a bounded size, as ``write`` does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    rows = cut(files.mapInArrow(_parsed, READ), "records")
    found = rows.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("f_digest"), F.col("page_id").alias("f_id")).agg(F.max("payload_bytes").alias("f_bytes"))
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes")
    revisits = revisits.join(found, (F.col("payload_digest") == F.col("f_digest")) & (F.col("refers_to") == F.col("f_id")), "left")
    cols = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    return rows.filter("record_type = 'response'").select(*cols, "payload_bytes").unionByName(revisits.select(*cols, F.col("f_bytes").alias("payload_bytes")))


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
