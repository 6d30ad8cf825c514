import random

import pytest
from pyspark.sql import functions as F

from orbitweave.llm.line_dedup import line_dedup, without_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, chars=10, documents=2):
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key_of(x)) >= chars:
                holders.setdefault(key_of(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key_of(x)) >= chars and len(h := holders[key_of(x)]) >= documents and d != min(h, key=lambda i: (i is None, i))
        kept = [x for x in lines if not gone(x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rng = random.Random(3)
    pool = [f"Line {i} of the POOL é{i}" for i in range(30)] + ["short", "", "  ", "ÀÉ same letters", "àé same letters", "\x0b tab line here \r"]
    rows = [(i, "\n".join(rng.choice((str.upper, str.lower, str))(rng.choice(pool)) + rng.choice(("", " ", "\t")) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows += [(500 + i, "one line that all the copies hold") for i in range(300)]  # a third of the rows
    rows += [(None, "one line that all the copies hold\nowned by none"), (None, "owned by none\nowned by two of none"), (None, "owned by two of none")]
    rows += [(900, "\nabcdefghi\n" * 3), (901, "abcdefghi\nabcdefghij"), (902, "abcdefghiJ\n\nABCDEFGHIJ  "), (903, None), (904, ""), (905, "\n"), (907, "Owned by NONE")]
    rows += [(910, "twice the same line\ntwice the same line"), (911, "twice the same line"), (912, "own lines only here\nown lines only here")]
    rows += [(920, "\n".join(f"long text line number {i % 3000}" for i in range(60_000))), (921, "long text line number 17\nx")]
    return rows + [rows[0], (901, "a second row of one id"), (901, "a second row of one id"), (902, "a second row of one id")]


@pytest.mark.parametrize("documents", [2, 3])
def test_lines_match_plain(spark, documents):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    order = lambda r: (r[0] is None, *map(str, r))
    got = sorted(map(tuple, line_dedup(docs, documents=documents).collect()), key=order)
    assert got == sorted(plain(rows, documents=documents), key=order)
    by_id = {r[0]: r for r in got}
    assert by_id[905][1:3] == (2, 0) and by_id[911][2] == (documents == 2) and by_id[799][2] == 1


def test_empty_table_and_names_that_clash(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["row", "id", "k1", "k2", "t1", "places", "cut", "kept", "n_dropped", "place", "line"]
    rows = [(i, "a line of two documents\nmine alone", *range(len(names))) for i in range(2)] + [(None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"`{n}` long" for n in names))
    found = without_repeated_lines(docs)
    assert found.columns == docs.columns
    want = [rows[0], (1, "", *range(len(names))), rows[2]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_hot_lines_are_split_by_adaptive_execution(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 > 0, F.lit("a banner of most of the documents\n")).otherwise(""), F.lit("line of its own "), "id").alias("text"))
    found = line_dedup(docs).agg(F.sum("n_lines"), F.sum("n_dropped"), F.min("text")).first()
    assert tuple(found) == (66_666, 26_665, "a banner of most of the documents\nline of its own 1")
