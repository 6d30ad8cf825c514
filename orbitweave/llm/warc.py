"""WARC files and their Merkle fixity audit (operator 9).

Pages are written as WARC files and read back record by record, each with its SHA-256 and the range of bytes that it takes.
The records of a file stand in order in numbered slots; a node covers as many neighbouring slots, and later nodes, as the
fan-out says, and hashes its children's hashes with their ranges, counted from its own begin. So a record that is lost or
grows moves the others without touching their nodes. Two replicas are compared from the roots down; only children of nodes
that differ are looked at, and in the slots that are left, records are told apart as changed, lost, added or moved.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitweave.session import durable, shared_dir

#: Slots of a file, and children of a node. A file whose slots take more than CROWDED records each is split by hash.
FILE_RECORDS, FANOUT, CROWDED = 256, 8, 4
#: Rows of two numbers that are sent to all executors, at most.
SENT_ROWS = 100_000
#: Packed bytes that are read at a time from a damaged file; what one of these steps would have given may be lost.
SALVAGED = 64
#: Fixed value: the date in the records' headers, so that records depend on their pages alone.
DATE = "2020-01-01T00:00:00Z"

LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)\r\n", re.I)
RECORD_ID = re.compile(rb"\r\nWARC-Record-ID: *<([^>\r\n]*)>", re.I)
TARGET = re.compile(rb"\r\nWARC-Target-URI: ?([^\r\n]*)", re.I)
SLOT = re.compile(r"urn:page:(?:(-?[0-9]+)|none):([0-9a-f]{4})")


def with_names(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``pages`` (page_id, url, html) with the file, slot and id of each one's record; nulls in url or html count as empty.

    A file takes ``file_records`` successive page ids, one slot each; pages without an id go to files and slots by hash.
    Files in which one id or no id has very many rows are split, so that none outgrows the others.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.md5(F.concat("url", F.lit("\n"), "html")))
    by_hash = F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    rows = rows.withColumn("of", F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1))).withColumn("slot", F.coalesce(F.pmod("page_id", F.lit(file_records)), F.pmod(by_hash, F.lit(file_records))))
    n = rows.groupBy("of").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED * file_records)
    parts = durable(n.select("of", F.ceil(F.col("n") / (CROWDED * file_records)).alias("parts")))
    crowded = parts.count()  # pages meet the few crowded files where they are, and move for the join only if these are many
    rows = rows.join(F.broadcast(parts) if crowded <= SENT_ROWS else parts, "of", "left") if crowded else rows.withColumn("parts", F.lit(None).cast("long"))
    part = F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1)))
    return rows.select(
        "page_id", "url", "html", F.format_string("f%d-%d", "of", part).alias("file"), "slot",
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), "digest").alias("id"),
    )


def record(named_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record, up to the two line ends that close it."""
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <"), named_id, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write_warc(named: DataFrame, path: str, together: bool = False) -> None:
    """Writes the records of :func:`with_names` as gzipped WARC files under ``path``, a folder a file.

    With ``together`` the rows of each file are in one partition as they come, as :func:`read_pages` gives them.
    """
    order = ["file", "slot", "id"]
    body = named.select(*order, record(F.col("id"), F.col("url"), F.col("html")).alias("value"))
    body = body if together else body.repartition("file")
    body.sortWithinPartitions(*order, F.sha2("value", 256)).select("file", "value").write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def records_in(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(id, first, last, SHA-256) of the records of a WARC file's bytes. What can't be read as a record is one of its own, up to the next."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        length = LENGTH.search(data, at, head + 2) if head >= 0 else None
        name = RECORD_ID.search(data, at, head) if head >= 0 else None
        last = head + 8 + int(length[1]) if length else -1
        if not (length and name and data.startswith(b"WARC/", at) and last <= len(data)):
            found = data.find(b"\r\n\r\nWARC/", at + 1)
            last, name = (found + 4 if found >= 0 else len(data)), None
        yield name[1].decode("utf-8", "replace") if name else f"unreadable:{hashlib.md5(data[at:last]).hexdigest()}", at, last, hashlib.sha256(data[at:last]).hexdigest()
        at = last


def read_pages(spark: SparkSession, path: str, file_records: int = FILE_RECORDS) -> DataFrame:
    """The rows of :func:`with_names` again, from the WARC files under ``path``; those of a file are in one partition. What is no record is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, data = b.column(0)[i].as_py(), _unpacked(b.column(1)[i].as_py())
                rows = []
                for name, first, last, _ in records_in(data):
                    head, _, body = data[first:last].partition(b"\r\n\r\n")
                    page, uri = SLOT.match(name), TARGET.search(head)
                    if page and uri:
                        rows.append((int(page[1]) if page[1] else None, uri[1].decode("utf-8", "replace"), body[:-4].decode("utf-8", "replace"), file, slot_of(name, file_records), name))
                yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string()))], ["page_id", "url", "html", "file", "slot", "id"])

    return _files(spark, path).mapInArrow(run, "page_id long, url string, html string, file string, slot long, id string")


def _unpacked(data: bytes) -> bytes:
    """A file's bytes, unpacked where they are packed; of packed bytes that are damaged what stands before the damage."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        out, unpack = [], zlib.decompressobj(31)
        try:
            for i in range(0, len(data), SALVAGED):
                out.append(unpack.decompress(data[i : i + SALVAGED]))
                while unpack.eof and unpack.unused_data:
                    rest, unpack = unpack.unused_data, zlib.decompressobj(31)
                    out.append(unpack.decompress(rest))
        except zlib.error:
            pass
        return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "/file=([^/]*)/[^/]*$", 1).alias("file"), "content")


def slot_of(name: str, file_records: int) -> int:
    m = SLOT.match(name)
    return (int(m[1]) if m[1] else int(m[2], 16)) % file_records if m else 0


def read_warc(spark: SparkSession, path: str, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, slot, id, first, last, hash) of each record of the WARC files under ``path``; ranges are of the unpacked bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, data = b.column(0)[i].as_py(), _unpacked(b.column(1)[i].as_py())
                rows = [(file, slot_of(x[0], file_records), *x) for x in records_in(data)]
                yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "slot", "id", "first", "last", "hash"])

    return _files(spark, path).mapInArrow(run, "file string, slot long, id string, first long, last long, hash string")


def tree(records: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """(file, level, node, first, last, hash) of all nodes of each file's tree; level 0 are the slots, the last level the roots."""

    def up(df: DataFrame, node: Column) -> DataFrame:
        child = F.struct("first", "last", "node", "hash")
        held = df.groupBy("file", node.alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.min("first").alias("first"), F.max("last").alias("last"))
        line = F.array_join(F.transform("children", lambda c: F.concat_ws(" ", c["node"].cast("string"), (c["first"] - F.col("first")).cast("string"), (c["last"] - F.col("first")).cast("string"), c["hash"])), "\n")
        return held.select("file", F.col("up").alias("node"), "first", "last", F.sha2(line, 256).alias("hash"))

    now = durable(up(records.withColumn("node", F.lit(0).cast("long")), F.col("slot")))
    levels, width = [now.withColumn("level", F.lit(0))], file_records
    while width > 1:
        now = up(now, F.floor(F.col("node") / fanout))
        width = -(-width // fanout)
        levels.append(now.withColumn("level", F.lit(len(levels))))
    return reduce(DataFrame.unionByName, levels).select("file", "level", "node", "first", "last", "hash")


def suspects(left: DataFrame, right: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """(file, slot) in which two trees of :func:`tree` differ. Each level reads its own nodes, and of them the children of those that differ."""
    spark = left.sparkSession
    sides = []
    for t in (left, right):
        path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        t.write.partitionBy("level").parquet(path)
        sides.append(spark.read.schema("file string, node long, first long, last long, hash string, level int").parquet(path))
    depth, width = 0, file_records
    while width > 1:
        depth, width = depth + 1, -(-width // fanout)
    found = None
    for level in range(depth, -1, -1):
        pair = [s.filter(F.col("level") == level).select("file", "node", F.col("hash").alias(f"hash_{n}")) for s, n in zip(sides, "ab", strict=True)]
        if found is not None:
            pair = [s.withColumn("up", F.floor(F.col("node") / fanout)).join(found.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up") for s in pair]
        found = durable(pair[0].join(pair[1], ["file", "node"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node"))
    return found.withColumnRenamed("node", "slot")


def compare(left: DataFrame, right: DataFrame, where: DataFrame) -> DataFrame:
    """(finding, id, file_a, first_a, last_a, hash_a, file_b, ...) of the records that differ in the slots of ``where``.

    A record is changed (one id, other bytes), lost, added, or moved (the same bytes in another file). Records that repeat
    are matched one by one, in order.
    """
    sides = []
    for r, n in ((left, "a"), (right, "b")):
        own = r.join(where, ["file", "slot"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("file", "id", "hash").orderBy("first")))
        sides.append(durable(own.select("file", "id", "hash", "nth", F.struct("file", "first", "last", "hash").alias(n))))
    rest = [s.join(o, ["file", "id", "hash", "nth"], "left_anti") for s, o in (sides, sides[::-1])]
    rest = [s.select("id", n, F.row_number().over(Window.partitionBy("id").orderBy(n)).alias("nth")) for s, n in zip(rest, "ab", strict=True)]
    both = rest[0].join(rest[1], ["id", "nth"], "full")
    finding = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(F.col("a.hash") == F.col("b.hash"), "moved").otherwise("changed")
    return both.select(finding.alias("finding"), "id", *[F.col(f"{n}.{c}").alias(f"{c}_{n}") for n in "ab" for c in ("file", "first", "last", "hash")])


def audit_files(spark: SparkSession, left: str, right: str, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """:func:`compare` of two folders of WARC files in the slots where their trees differ; equal ones give no rows."""
    sides = [durable(read_warc(spark, p, file_records)) for p in (left, right)]
    where = suspects(*[tree(s, file_records, fanout) for s in sides], file_records, fanout)
    return compare(*sides, where)


def fixity_audit(pages: DataFrame, rot=None, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are not read) as WARC files, these again after ``rot``, and audits both.

    The replica is made from the files, file by file, so that pages are shuffled once.
    Null ids, urls and html, repeated rows and ids are records like any other; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_names(pages, file_records), f"{folder}/a")
    copy = read_pages(spark, f"{folder}/a", file_records)
    write_warc(rot(copy) if rot else copy, f"{folder}/b", together=True)
    return audit_files(spark, f"{folder}/a", f"{folder}/b", file_records, fanout)


def bit_rot(named: DataFrame, every: int = 97) -> DataFrame:
    """A replica in which each page_id divisible by ``every`` has one character changed, and 13 more than 8 times that is lost."""
    spoilt = F.when(F.col("page_id") % every == 0, F.overlay("html", F.lit("~"), F.lit(12), F.lit(1))).otherwise(F.col("html"))
    return named.withColumn("html", spoilt).filter(F.col("page_id").isNull() | (F.col("page_id") % (every * 8) != 13))


_END = "chr(13) || chr(10)"
_RECORD = (
    f"'WARC/1.1' || {_END} || 'WARC-Type: resource' || {_END} || 'WARC-Date: {DATE}' || {_END} || 'WARC-Record-ID: <' || id || '>' || {_END} || 'WARC-Target-URI: ' || url || {_END}"
    f" || 'Content-Type: text/html' || {_END} || 'Content-Length: ' || strlen(html) || {_END} || {_END} || html || {_END} || {_END}"
)
_SIDE = f"SELECT id, 'f' || (page_id // {FILE_RECORDS}) || '-0' AS file, page_id, strlen(r) AS size, sha256(r) AS hash FROM (SELECT id, page_id, {_RECORD} AS r FROM %s)"
_PLACED = "SELECT *, (sum(size) OVER w - size)::BIGINT AS first, (sum(size) OVER w)::BIGINT AS last FROM %s WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING)"
#: The audit of the pages table against its spoilt replica, for DuckDB.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'urn:page:' || page_id || ':' || md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS id FROM pages),
q AS (SELECT page_id, url, id, CASE WHEN page_id % 97 = 0 THEN substr(html, 1, 11) || '~' || substr(html, 13) ELSE html END AS html FROM p WHERE page_id % {97 * 8} <> 13),
x AS ({_SIDE % "p"}), y AS ({_SIDE % "q"}), a AS ({_PLACED % "x"}), b AS ({_PLACED % "y"})
SELECT CASE WHEN b.id IS NULL THEN 'lost' ELSE 'changed' END AS finding, a.id, a.file AS file_a, a.first AS first_a, a.last AS last_a, a.hash AS hash_a,
  b.file AS file_b, b.first AS first_b, b.last AS last_b, b.hash AS hash_b FROM a LEFT JOIN b USING (id) WHERE b.id IS NULL OR a.hash <> b.hash
"""
