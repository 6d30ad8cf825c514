import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitweave.llm import conversation_repair as cr

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else v for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if k == 1 else "".join(y for y in x if y not in ".!?") if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        core = x.strip(BLANKS)
        out.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def plain_edits(rows, faults):
    """Least (cost, audit) by states of what is kept so far, with the repaired turns: every way to edit, row by row."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(3):
            for q, (cost, audit, turns) in list(best.items()):
                to, new = follow[q], (cost + 5, audit + "I", turns + [(name[follow[q]], "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserts({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def put(to, new):
            if to not in after or new[:2] < after[to][:2]:
                after[to] = new

        for q, (cost, audit, turns) in best.items():
            put(q, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            extra, first = 5 * (fault == "truncated"), role[:1]
            if first and (first == follow[q] or (first, q) == ("s", "")):
                put(first, (cost + extra, audit + "K", turns + [(role, text)]))
            put(follow[q], (cost + 1 + extra, audit + "R", turns + [(name[follow[q]], text)]))
        best = inserts(after)
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def plain(original, damage=True):
    out = []
    rows = plain_damage(original) if damage else [(c, t, *(" " if v is None else v for v in rx)) for c, t, *rx in original]
    for c in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(mine)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") or not (a[2] and b[2]) for a, b in zip(mine, mine[1:]))
        cost, audit, repaired = plain_edits(mine, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def some(rng, conv, n, texts=None):
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant"] * 4 + ["system", "usher", "tool", " ", "", None])
        text = rng.choice(texts) if texts else f"text {rng.randrange(10**6)}" + rng.choice([".", "!", "?", ".", ". \n", "", " "])
        rows.append((conv, i if rng.random() < 0.9 else None, role, rng.choice([text] * 12 + ["", " \t", None, "ok.", "ok"])))
    return rows


def corpus():
    rng = random.Random(2)
    rows = [r for c in range(300) for r in some(rng, c, rng.randint(0, 14))]
    rows += some(rng, None, 30) + some(rng, 5000, 900) + some(rng, 5001, 700, ["same.", "again.", "no end"])
    rows += [(6000, 3, "user", "one row of many copies.")] * 500 + [(6001, None, "assistant", "x.")] * 3 + [(6002, 0, "user", "w " * 200_000 + ".")]
    rows += [(7000 + i, 0, "system", "a first turn of many.") for i in range(200)] + [(8000, t, r, x) for t, r, x in [(5, "user", "b."), (5, "user", "a."), (5, "assistant", "a."), (9, "user", "b.")]]
    lost = next(i for i in range(9000, 9900) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "hello.")]


def table(spark, rows, partitions):
    names = ["k", "pos", "copies_", "code", "seen", "part", "n"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} long" for n in names))
    return docs.repartition(partitions)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_damaged_conversations_match_plain(spark):
    rows = corpus()
    assert found(cr.conversation_repair(cr.damaged(table(spark, rows, 4)))) == plain(rows)


@pytest.fixture
def finely(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_long_conversations_are_cut_between_partitions(spark, finely, monkeypatch):
    rows = corpus()
    placed = cr.placed(cr.damaged(table(spark, rows, 4)))
    cut = {r.k for r in placed.groupBy("k").agg(F.count_distinct("part").alias("n")).filter("n > 2").collect()}
    assert {"=5000", "=5001", "=6000"} <= cut
    monkeypatch.setattr(cr, "PIECE_TURNS", 50)
    assert found(cr.conversation_repair(cr.damaged(table(spark, rows, 4)))) == plain(rows)


def test_undamaged_rows_and_the_turns_of_the_repair(spark, finely):
    rows = corpus()
    assert found(cr.conversation_repair(table(spark, rows, 4))) == plain(rows, damage=False)
    turns = cr.repaired_turns(table(spark, rows, 4)).orderBy("conv_id", "piece", "place").collect()
    of = {}
    for t in turns:
        of.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    shas = {r[0]: r[-1] for r in plain(rows, damage=False)}
    assert {c: hashlib.sha256("\n".join(of.get(c, [])).encode()).hexdigest() for c in shas} == shas


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.conversation_repair(cr.damaged(empty)).collect() == [] and cr.repaired_turns(empty).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=9), st.lists(st.integers(0, 12), max_size=9))
def test_pieces_chain_as_one(left, right):
    states, total = cr.scan(left + right)
    whole = tuple(c + total for c in cr.AUTOMATON.vectors[states[0]])
    assert cr._over(cr._over(cr.END, cr.matrix(right)), cr.matrix(left)) == whole
    beyond = cr._over(cr.END, cr.matrix(right))
    least = tuple(c - min(beyond) for c in beyond)
    mid = cr.exits(left, least)[cr.START]
    assert cr.exits(right, cr.END)[mid] == cr.exits(left + right, cr.END)[cr.START]


def test_the_automaton_stays_small():
    rng = random.Random(1)
    for _ in range(300):
        codes = [rng.choice([c for c in range(13) if c % 3 < 2]) for _ in range(200)]
        cr.matrix(codes)
        cr.scan(codes)
    assert len(cr.AUTOMATON.vectors) < 400
