"""Quality rules by cross-document line frequency (operator 5), in DataFrame functions only.

Normalised lines are hashed and counted by distinct documents of their host; lines above the host's limit count as
removed, and a document that they deplete is rejected. Documents of one text are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textstats import count_of, duplicate_lines, with_repeated_words, word_chars, words_of
from orbitweave.session import durable

#: A line is above its host's limit in more than this many distinct documents and, as short lines recur by chance, more
#: than this share of them where it has fewer than LONG_LINE words.
LINE_DOCUMENTS = 10
LINE_SHARE = 0.005
LONG_LINE = 20
#: A document is depleted where less than this share of its words is left.
LEFT_SHARE = 0.2
#: Parts into which a frequent line's documents are dealt when its count meets them again.
SALTS = 16

#: Fixed values of the base rules.
FEWEST_WORDS = 50
MOST_REPEATED = 50


def _host(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host, text_key) by row."""
    counted = docs.select(
        "doc_id", _host("source").alias("host"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("words", words_of(F.col("text")))
    counted = counted.select(
        "doc_id", "host", "words",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("words")).alias("word_chars"),
        count_of(F.col("text"), "[#*$%&|<>]").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return with_repeated_words(counted, "words", "n_repeat_words").drop("words").withColumn("base_failed", failed)


def normalised_lines(text: Column) -> Column:
    """Lower-case lines with single blanks, those with a word."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\x0B\f\r]+", " ")
    return F.filter(F.transform(F.split(flat, "\n", -1), lambda line: F.btrim(line, F.lit(" "))), lambda line: line != "")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_key, lines, words) by row: each line's hash and its words."""
    cut = docs.select("doc_id", _host("source").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), normalised_lines(F.col("text")).alias("texts"))
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return cut.select("doc_id", "host", "text_key", F.transform("texts", lambda x: F.xxhash64(x)).alias("lines"), F.transform("texts", n_words).alias("words"))


def frequent_lines(lines: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """(host, line) of the lines above their host's limit, from :func:`lines_of`. Documents are told apart by text_key."""
    each = lines.select("host", "text_key", F.inline(F.arrays_zip("lines", "words")).alias("line", "words"))
    counts = each.groupBy("host", "line", "words").agg(F.count_distinct("text_key").alias("n"))
    hosts = lines.filter(F.size("lines") > 0).groupBy("host").agg(F.count_distinct("text_key").alias("of"))
    return counts.filter(F.col("n") > documents).join(hosts, "host").filter((F.col("words") >= LONG_LINE) | (F.col("n") > share * F.col("of"))).select("host", "line").distinct()


def depletion(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """(doc_id, host, text_key, words, removed, removed_lines) of each text with lines."""
    lines = durable(lines_of(docs))  # two numbers a line, so that texts are cut once for both counts and the verdict
    above = frequent_lines(lines, documents, share).select(
        F.col("host").alias("above_host"), F.col("line").alias("above_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    each = lines.select("doc_id", "host", "text_key", F.inline(F.arrays_zip("lines", "words")).alias("line", "words"))
    each = each.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    met = each.join(above, (F.col("host") == F.col("above_host")) & (F.col("line") == F.col("above_line")) & (F.col("part") == F.col("salt")), "left")
    gone = F.col("above_line").isNotNull()
    return met.groupBy("doc_id", "host", "text_key").agg(
        F.sum("words").alias("words"), F.sum(F.when(gone, F.col("words")).otherwise(0)).alias("removed"), F.collect_set("above_line").alias("removed_lines")
    )


def _judged(docs: DataFrame, documents: int, share: float, left_share: float) -> DataFrame:
    """:func:`base_statistics` with left_share (of the words, 1 for texts without lines), removed_lines and kept."""
    lost = depletion(docs, documents, share).select(
        F.col("doc_id").alias("lost_id"), F.col("host").alias("lost_host"), F.col("text_key").alias("lost_key"), (1 - F.col("removed") / F.col("words")).alias("left_words"), "removed_lines"
    )
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("host") == F.col("lost_host")) & (F.col("text_key") == F.col("lost_key"))
    left = F.coalesce("left_words", F.lit(1.0))
    return base_statistics(docs).join(lost, same, "left").withColumn("left_share", left).withColumn("kept", ~F.col("base_failed") & (left >= left_share))


def quality_rules(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_share, kept) by row of ``docs``.

    ``docs`` has doc_id, text and source; other columns are not read. Null text counts as empty, and empty texts fail the
    base rules; a null source is a host of its own. Repeated rows are judged alike. An empty table gives no rows.
    """
    return _judged(docs, documents, share, left_share).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_share", "kept"
    )


def _kept(docs: DataFrame, found: DataFrame, reject: bool, remove: bool) -> DataFrame:
    """The rows of ``docs`` by what was ``found`` of them (doc_id, host, text_key, removed_lines).

    The caller's columns ride in one struct, so that no name of theirs can clash.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _host("source").alias("of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    found = found.select("doc_id", "host", "text_key", "removed_lines").dropDuplicates(["doc_id", "host", "text_key"])
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("host")) & (F.col("key") == F.col("text_key"))
    met = rows.join(found, same, "inner" if reject else "left")
    flat = lambda x: F.btrim(F.regexp_replace(F.lower(x), r"[ \t\x0B\f\r]+", " "), F.lit(" "))
    rest = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x: ~F.array_contains("removed_lines", F.xxhash64(flat(x)))), "\n")
    text = F.when(F.size("removed_lines") > 0, rest).otherwise(F.col("row.text")).alias("text")
    return met.select(*[text if c == "text" and remove else F.col(f"row.`{c}`") for c in docs.columns])


def kept_documents(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """The rows of ``docs`` that pass, as they are, with all their columns.

    Rows that agree in doc_id are judged one by one. Null texts count as empty and don't pass; an empty table gives no rows.
    """
    return _kept(docs, _judged(docs, documents, share, left_share).filter("kept"), reject=True, remove=False)


def without_frequent_lines(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """The rows of ``docs`` with the lines above their host's limit taken out of the texts; null texts stay null."""
    return _kept(docs, depletion(docs, documents, share).filter("removed > 0"), reject=False, remove=True)


def cleaned_documents(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """:func:`kept_documents` with the lines above their host's limit taken out of the texts; lines are counted once for both."""
    return _kept(docs, _judged(docs, documents, share, left_share).filter("kept"), reject=True, remove=True)


#: The same query for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS words FROM d),
p AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(words) - 2), lambda i: {{'i': i, 'g': words[i:i+2]}})) AS x FROM w WHERE len(words) >= 3),
r AS (SELECT doc_id, x.i AS i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, x.g) > 1),
n AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, list_filter(list_transform(string_split(regexp_replace(lower(text), '[ \\t\\x0b\\x0c\\r]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM d),
e AS (SELECT doc_id, host, text, unnest(lines) AS line FROM l),
h AS (SELECT host, count(DISTINCT text) AS docs FROM e GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM e GROUP BY host, line) JOIN h USING (host) WHERE n > {LINE_DOCUMENTS} AND (len(string_split(line, ' ')) >= {LONG_LINE} OR n > {LINE_SHARE} * docs)),
q AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS words, sum(CASE WHEN f.line IS NULL THEN 0 ELSE len(string_split(line, ' ')) END) AS removed FROM e LEFT JOIN f USING (host, line) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND coalesce(1 - removed / words, 1.0) >= {LEFT_SHARE} AS kept
FROM s LEFT JOIN q USING (doc_id)
"""
