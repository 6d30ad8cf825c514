"""Line dedup (operator 13), in DataFrame functions only.

Normalised lines are hashed and exploded; a hash's documents are counted with map-side combine; a line above the limit
loses all its places but those in the smallest document that holds it, and texts are put together again by position.
Texts are shuffled once, at the end; before that a line is two numbers. What the joins read is written first, so that
both sides are plain exchanges and adaptive execution splits a line, or a repeated row, that holds a large share.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textstats import BLANKS
from orbitweave.session import durable

#: A line of at least this many code points, in at least this many documents, stays in one document alone.
LINE_CHARS = 10
LINE_DOCUMENTS = 2


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does it where a text has no other letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, chars: int = LINE_CHARS) -> DataFrame:
    """(doc_id, t1, t2, lines) by row: 128 bits of the text, and of each line's key; null where a key is shorter than ``chars``."""
    twice = lambda x, a, b: (F.xxhash64(x).alias(a), F.xxhash64(F.lit(1), x).alias(b))
    keys = F.transform(F.split(_lower_ascii(_text()), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = F.transform(keys, lambda x: F.when(F.length(x) >= chars, F.struct(*twice(x, "h1", "h2"))))
    return docs.select("doc_id", *twice(_text(), "t1", "t2"), lines.alias("lines"))


def repeated_lines(lines: DataFrame, documents: int = LINE_DOCUMENTS) -> DataFrame:
    """(h1, h2, holder) of the keys in at least ``documents`` documents, with the smallest doc_id that holds each.

    Rows of one doc_id are one document, and so are all rows without an id, which comes after every other. Two documents
    are told by the least and the greatest id; only more need distinct ids.
    """
    each = lines.select("doc_id", F.explode(F.array_distinct("lines")).alias("line")).filter("line is not null").select("doc_id", "line.*")
    of = each.groupBy("h1", "h2")
    none = F.max(F.col("doc_id").isNull()).alias("none")
    if documents == 2:
        found = of.agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), none).filter("holder < last or (none and holder is not null)")
    else:
        found = of.agg(F.min("doc_id").alias("holder"), F.count_distinct("doc_id").alias("n"), none).filter(F.col("n") + F.col("none").cast("int") >= documents)
    return found.select("h1", "h2", "holder")


def dropped_places(docs: DataFrame, chars: int = LINE_CHARS, documents: int = LINE_DOCUMENTS) -> DataFrame:
    """(doc_id, t1, t2, places) of the texts that lose lines: the places of these, from 0."""
    lines = durable(line_hashes(docs, chars))  # cut once for the counts and the places
    above = durable(repeated_lines(lines, documents))
    each = lines.select("doc_id", "t1", "t2", F.posexplode("lines").alias("place", "line")).filter("line is not null").select("doc_id", "t1", "t2", "place", "line.*")
    gone = each.join(above, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("place").alias("places"))


def _judged(docs: DataFrame, chars: int, documents: int) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` as a struct, so that no name of a column can clash."""
    found = durable(dropped_places(docs, chars, documents))
    rows = docs.select(F.struct("*").alias("row"), _text().alias("text"), F.col("doc_id").alias("id"), F.xxhash64(_text()).alias("k1"), F.xxhash64(F.lit(1), _text()).alias("k2"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    met = rows.join(found, same, "left").withColumn("cut", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("cut"), i)), "\n"))
    return met.select("row", F.size("cut").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, chars: int = LINE_CHARS, documents: int = LINE_DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) by row of ``docs``, with the text that is left.

    ``docs`` has doc_id and text; other columns are not read. A null or empty text is one empty line. Rows of one doc_id
    are one document: a line that only they hold stays in all of them, and of equal lines in one document all stay or go.
    A row without an id keeps a line only where no row with an id holds it. An empty table gives no rows.
    """
    found = _judged(docs.select("doc_id", "text"), chars, documents)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("text"))


def without_repeated_lines(docs: DataFrame, chars: int = LINE_CHARS, documents: int = LINE_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` with all their columns, and the text that is left; texts that lose nothing, nulls too, stay as they are."""
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text")
    return _judged(docs, chars, documents).select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


#: The query for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(generate_series(1, len(lines))) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= {LINE_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LINE_DOCUMENTS}),
j AS (SELECT k.doc_id, i, line, coalesce(holder <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
