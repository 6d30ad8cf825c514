import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitweave.llm import fill_in_middle as fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def plain(d, text):
    t = text or ""
    w = TOKENS.findall(t)
    s = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return d, len(w), "plain", None, None, t, t
    if h[3] % 100 < 80:
        return d, len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", t
    return d, len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5000) | st.integers(1, 3), max_size=300))
def test_elias_fano_gives_back_each_value(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.int64))
    packed = fim.encode(values)
    assert fim.size(packed) == len(values) and fim.select(packed, list(range(len(values)))) == values.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab<P>é😀", max_size=60))
def test_token_ends_match_the_pattern(text):
    assert fim.token_ends(text).tolist() == [m.end() for m in TOKENS.finditer(text)]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé😀<PSM>") for _ in range(rng.randint(1, 6)))
    rows = [(i, rng.choice(("", " ", "\n")) + rng.choice((" ", "\n\t ", "  ")).join(word() for _ in range(rng.randint(1, 40))) + rng.choice(("", "  "))) for i in range(200)]
    rows += [(1000 + i, "a text that has very many copies <") for i in range(120)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "x"), (304, "has <P> in it"), (305, "has <M>"), (306, "<<S>"), (None, "no id at all"), (None, None), (307, "w " * 200_000)]
    rows += [(i, f"<{i}<S <P <M P>S>M>") for i in range(310, 340)]
    return rows + rows[:5] + [(0, "other text of one id")]


def check(spark, rows):
    names = ["key", "count", "deal", "part", "bounds", "drawn", "form", "n"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", `{n}` long" for n in names)).repartition(5)
    found = fim.fill_in_middle(docs)
    found = found.withColumn("again", fim.restored(F.col("output"), F.col("form")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain(*r) for r in rows), key=str)


def test_documents_match_plain(spark):
    rows = corpus()
    check(spark, rows)
    assert {plain(*r)[2] for r in rows} == {"plain", "psm", "spm"}


def test_hot_texts_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fim, "PART_COPIES", 7)
    check(spark, corpus())


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_index_holds_each_text_once(spark):
    texts = fim.distinct_texts(spark.createDataFrame([("a b",)] * 50 + [("c",), ("",)], "text string").withColumn("key", fim._digest(F.col("text"))))
    found = sorted(fim.select(bytes(r.bounds), list(range(fim.size(bytes(r.bounds))))) for r in fim.boundary_index(texts).collect())
    assert found == [[], [1], [1, 3]] and sorted(r.text for r in texts.collect()) == ["", "a b", "c"]
