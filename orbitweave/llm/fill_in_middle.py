"""Fill-in-middle transformation (operator 12) by an index of distinct texts.

Equal texts are grouped by digest and content, so that a text's token boundaries are found once, as an Elias-Fano list;
documents meet the list by digest and each selects the two boundaries that its seed names. Texts reach Python once per
distinct text, and boundaries alone do so per document; cuts, outputs and digests stay in the JVM. A text of very many
copies is dealt out in parts for the join; the grouping has combined it before the shuffle.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from orbitweave.session import durable

SEED = 42
#: Of 100 documents so many are transformed, and of 100 of these so many begin with the suffix.
RATE = 50
SPM_RATE = 80
#: A text of more copies than this, and than a shuffle partition's share of all rows, is dealt out in parts of so many.
PART_COPIES = 2_000
#: The marks before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"

HEAD = struct.Struct("<QQB")
ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def encode(values: np.ndarray) -> bytes:
    """An Elias-Fano list of rising whole numbers: low bits as they are, high bits by unary gaps."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros(n + (top >> width) + 1, dtype=np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return HEAD.pack(n, top, width) + np.packbits(high, bitorder="little").tobytes() + np.packbits(low.ravel(), bitorder="little").tobytes()


def size(packed: bytes) -> int:
    return HEAD.unpack_from(packed)[0]


def select(packed: bytes, places: list[int]) -> list[int]:
    """The values at ``places`` (from 0) of a list of :func:`encode`."""
    n, top, width = HEAD.unpack_from(packed)
    end = HEAD.size + (n + (top >> width) + 1 + 7) // 8
    high = np.frombuffer(packed, np.uint8, end - HEAD.size, HEAD.size)
    ones = np.cumsum(ONES[high])
    out = []
    for i in places:
        at = int(np.searchsorted(ones, i + 1))
        left = i - (int(ones[at - 1]) if at else 0)
        byte = int(high[at])
        for _ in range(left):
            byte &= byte - 1
        bit = at * 8 + (byte & -byte).bit_length() - 1
        first = i * width
        raw = int.from_bytes(packed[end + first // 8 : end + (first + width + 7) // 8], "little") >> first % 8
        out.append((bit - i) << width | raw & ((1 << width) - 1))
    return out


def token_ends(text: str) -> np.ndarray:
    """Ends, in code points, of the tokens: a word with the white space before it, and white space at the very end."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(c):
        return np.zeros(0, dtype=np.int64)
    word = (c != 32) & ((c < 9) | (c > 13))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    return ends if word[-1] else np.append(ends, len(c))


@pandas_udf(BinaryType())
def _bounds(texts: pd.Series) -> pd.Series:
    return pd.Series([encode(token_ends(t)) for t in texts], dtype=object)


@pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "a", "b")]))
def _cut(bounds: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The number of tokens, and the places in code points that two drawn numbers select."""
    out = []
    for packed, x, y in zip(bounds, first, second):
        n = size(packed)
        low, high = sorted((int(x) % (n + 1), int(y) % (n + 1)))
        ends = iter(select(packed, [k - 1 for k in (low, high) if k]))
        out.append((n, *(next(ends) if k else 0 for k in (low, high))))
    return pd.DataFrame(out, columns=["n", "a", "b"])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(key, text): each distinct text of ``texts`` (key, text) once, with its digest.

    Texts of one digest are compared as they are grouped; two different ones would end the job.
    """
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts of one digest")))
    return texts.groupBy("key").agg(F.collect_set("text").alias("texts")).select("key", one.alias("text"))


def boundary_index(distinct: DataFrame) -> DataFrame:
    """(key, bounds): the list of token ends of each of :func:`distinct_texts`."""
    return distinct.select("key", _bounds("text").alias("bounds"))


def _met(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bounds) of each row, by its text's digest.

    Texts are shuffled once: the join takes them as they were grouped, and the lists, which Python made, come beside them.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _digest(F.col("text")))
    slim = durable(rows.select("doc_id", "key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = max(PART_COPIES, slim.count() // parts)
    # fewer than ``parts`` keys can have so many rows: the list is small whatever the input
    hot = durable(slim.groupBy("key").count().filter(F.col("count") > large).select("key", F.ceil(F.col("count") / large).cast("int").alias("deal")))
    texts = distinct_texts(rows.select("key", "text"))
    few = F.broadcast(hot)
    cold = slim if hot.isEmpty() else slim.join(few, "key", "left_anti")
    found = cold.join(texts, "key").join(boundary_index(texts), "key").select("doc_id", "text", "bounds")
    if hot.isEmpty():
        return found
    texts = distinct_texts(rows.join(few, "key", "left_semi").select("key", "text"))
    index = texts.join(boundary_index(texts), "key").join(few, "key").select("key", "text", "bounds", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("part"))
    dealt = slim.join(few, "key").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "deal").cast("int"))
    return found.union(dealt.join(index, ["key", "part"]).select("doc_id", "text", "bounds"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) by row of ``docs``: its tokens, the form chosen, and the new text.

    ``docs`` has doc_id and text; other columns are not read. A null text counts as empty; empty texts, and those that
    hold a mark, stay plain, with null lengths. The seed's digest is of ``seed:doc_id``, with nothing after the colon for
    a null id, so that rows of one id draw alike. Repeated rows come out alike; an empty table gives no rows.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("drawn", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.col("text").contains(P) | F.col("text").contains(S) | F.col("text").contains(M)
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    met = _met(docs).withColumn("drawn", drawn).select("doc_id", "text", form.alias("form"), _cut("bounds", h[0], h[1]).alias("cut"))
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle))
        .otherwise(F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle))
    )
    told = F.col("form") != "plain"
    return met.select("doc_id", F.col("cut.n").alias("n"), "form", F.when(told, F.col("cut.a")).alias("prefix_chars"), F.when(told, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of; no mark is in it, so the marks part the output in one way."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


#: The query for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id) AS s FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[ \\t\\n\\x0b\\x0c\\r]*[^ \\t\\n\\x0b\\x0c\\r]+|[ \\t\\n\\x0b\\x0c\\r]+') AS w FROM d),
h AS (SELECT *, len(w)::BIGINT AS n, ('0x' || s[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(w) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '{P}') OR contains(text, '{S}') OR contains(text, '{M}') OR ('0x' || s[17:24])::BIGINT % 100 >= {RATE} THEN 'plain'
    WHEN ('0x' || s[25:32])::BIGINT % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS pre, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(w[greatest(x, y) + 1:], '') AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{P}' || pre || '{S}' || suf || '{M}' || mid ELSE '{S}' || suf || '{P}' || pre || '{M}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
