"""Conversation structure repair (operator 11) by lazy weighted determinisation.

The cheapest edits lead a small weighted automaton over what may come next. Rows are scanned from the last to the first:
the costs to finish from each of its states, less the least of them, are one state of a deterministic automaton that is
built as it is met, so that a row costs one look into a table. A trace the other way follows the arcs that keep the cost
and takes the least initial; it is a table as well.

Rows are range-partitioned by conversation and turn, so that a conversation is scanned where it lies and a very long one
is cut between partitions. What lies in one partition needs no more. Of a cut conversation each piece gives a matrix of
costs from state to state, then, with the costs beyond it known, the states that a trace leaves it in; the driver chains
these few numbers, at most two pieces a partition, and each piece is then edited where it lies. Texts never meet in one
task; only the digest of a cut conversation is made by one task, which reads its pieces one after the other.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.textstats import BLANKS
from orbitweave.session import durable

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"user": USER, "assistant": ASSISTANT}
#: Costs of the edits; the initials are those of the audit.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row's code is 3 * (0 system, 1 user, 2 assistant, 3 other) + (0 sound, 1 truncated, 2 blank); GONE must be deleted.
GONE = 12
LEGAL = {(0, 1), (1, 2), (2, 1)}
INF = 1 << 60
#: Turns and characters of a piece of a repaired conversation.
PIECE_TURNS, PIECE_CHARS = 2_000, 1_000_000


def follow(state: int) -> int:
    """The state that the role leads to which may be inserted in ``state``."""
    return ASSISTANT if state == USER else USER


def arcs(state: int, code: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one row, by initial."""
    yield "D", DELETE, state
    if code == GONE:
        return
    kind, fault = divmod(code, 3)
    extra = TRUNCATED * (fault == 1)
    fits = {0: state == START, 1: state != USER, 2: state == USER}.get(kind, False)
    if fits:
        yield "K", extra, (SYSTEM, USER, ASSISTANT)[kind]
    yield "R", REROLE + extra, follow(state)


def closed(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[follow(q)]) for q, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """Vectors of costs to finish, less their least, as states; steps and traces are cached as they are met."""

    def __init__(self):
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, costs: Iterable[int]) -> tuple[int, int]:
        """The state of a vector, and what it is less."""
        costs = tuple(costs)
        least = min(costs)
        vector = tuple(c - least if c < INF else INF for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def step(self, right: int, code: int) -> tuple[int, int]:
        """The state before a row, from that after it, and the cost between them."""
        if (right, code) not in self.steps:
            w = self.vectors[right]
            self.steps[right, code] = self.state(closed([min(INF, *(cost + w[to] for _, cost, to in arcs(q, code))) for q in range(4)]))
        return self.steps[right, code]

    def trace(self, right: int, code: int, state: int) -> tuple[str, int]:
        """The edits from ``state`` before a row to after it, insertions first, and the state they lead to."""
        if (right, code, state) not in self.traces:
            (left, cost), w, q, done = self.step(right, code), self.vectors[right], state, ""
            v = self.vectors[left]
            while True:
                tight = [(a, to) for a, c, to in arcs(q, code) if v[q] + cost == c + w[to]]
                if v[q] == INSERT + v[follow(q)]:
                    tight.append(("I", follow(q)))
                a, q = min(tight)
                done += a
                if a != "I":
                    break
            self.traces[right, code, state] = done, q
        return self.traces[right, code, state]


AUTOMATON = Automaton()
#: Costs to finish after the last row.
END = closed([0, INF, INF, 0])


def scan(codes: list[int], right: Iterable[int] = END) -> tuple[list[int], int]:
    """States before each row and after the last, and the cost that vectors of them leave out before the first."""
    at, total = AUTOMATON.state(right)
    states = [at]
    for code in reversed(codes):
        at, cost = AUTOMATON.step(at, code)
        total += cost
        states.append(at)
    return states[::-1], total


def matrix(codes: list[int]) -> list[int]:
    """Costs from each state before the rows to each state after them, row by row; INF where there is no way."""
    columns = []
    for q in range(4):
        states, total = scan(codes, [0 if i == q else INF for i in range(4)])
        columns.append([min(INF, c + total) for c in AUTOMATON.vectors[states[0]]])
    return [columns[j][i] for i in range(4) for j in range(4)]


def exits(codes: list[int], right: Iterable[int]) -> list[int]:
    """The state in which the trace from each of the four leaves the rows."""
    states, _ = scan(codes, right)
    now = list(range(4))
    for after, code in zip(states[1:], codes):
        now = [AUTOMATON.trace(after, code, q)[1] for q in now]
    return now


def last_inserts(state: int) -> str:
    return {SYSTEM: "II", USER: "I"}.get(state, "")


# ---- Rows of one conversation in one task ----

PIECE = pa.schema(
    [("conv_id", pa.int64()), ("k", pa.string()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64())]
    + [("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    + [("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
PIECE_SQL = (
    "conv_id long, k string, at long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first long, last long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def seen_before(rows: list[dict]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    out = []
    for r in rows:
        pair = r["role"], r["text"]
        out.append(bool(r["copies"]) and pair in seen)
        if r["copies"]:
            seen.add(pair)
    return out


def codes_of(rows: list[dict], seen: list[bool]) -> tuple[list[int], list[dict]]:
    """One code a copy, and the row of each."""
    codes, of = [], []
    for r, s in zip(rows, seen):
        for i in range(r["copies"]):
            codes.append(GONE if s or i or r["code"] % 3 == 2 else r["code"])
            of.append(r)
    return codes, of


def pieces_of(rows: list[dict], seen: list[bool], right: Iterable[int] = END, state: int = START, ends: bool = True) -> Iterator[dict]:
    """Pieces of the repaired rows. ``right`` and ``state``: costs beyond the rows, and the state before them."""
    codes, of = codes_of(rows, seen)
    states, _ = scan(codes, right)
    piece = chars = None

    def fresh(at: int) -> dict:
        return {"conv_id": rows[0]["conv_id"], "k": rows[0]["k"], "at": at} | dict.fromkeys(("low", "high", "first", "last")) | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": [], "repaired": []}

    def insert(q: int) -> int:
        piece["repaired"].append(("assistant" if q == USER else "user", ""))
        piece["cost"] += INSERT
        return follow(q)

    def out() -> dict:
        return piece | {"audit": "".join(piece["audit"]), "repaired": [{"role": a, "text": b} for a, b in piece["repaired"]]}

    piece, chars = fresh(rows[0]["pos"]), 0
    for i, (code, r, after) in enumerate(zip(codes, of, states[1:])):
        if len(piece["audit"]) >= PIECE_TURNS or chars > PIECE_CHARS:
            yield out()
            piece, chars = fresh(r["pos"]), 0
        kind, fault = divmod(r["code"], 3)
        if r["turn"] is not None:
            piece["turns"] += piece["high"] != r["turn"]
            piece["low"], piece["high"] = piece["low"] if piece["low"] is not None else r["turn"], r["turn"]
        if piece["last"] is not None:
            piece["illegal"] += (piece["last"], kind) not in LEGAL
        piece["first"], piece["last"] = piece["first"] if piece["first"] is not None else kind, kind
        fault = "blank" if fault == 2 else "duplicate" if code == GONE else "truncated" if fault else None
        if fault:
            piece[fault] += 1
        edits, to = AUTOMATON.trace(after, code, state)
        piece["audit"].append(edits)
        for _ in edits[:-1]:
            state = insert(state)
        piece["cost"] += next(c for a, c, _ in arcs(state, code) if a == edits[-1])
        if edits[-1] != "D":
            role = r["role"] if edits[-1] == "K" else "assistant" if state == USER else "user"
            piece["repaired"].append((role, r["text"]))
            chars += len(r["text"])
        state = to
    if ends:
        for a in last_inserts(state):
            piece["audit"].append(a)
            state = insert(state)
    yield out()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation; they come one after the other."""
    run: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if run and run[0]["k"] != r["k"]:
                yield run
                run = []
            run.append(r)
    if run:
        yield run


def _batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in found:
        held.append(x)
        size += 100 + sum(len(t["text"]) for t in x.get("repaired", ()))
        if size > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches((p for run in _runs(batches) for p in pieces_of(run, seen_before(run))), PIECE)


def _edges(batches: Iterator[pa.RecordBatch], name: str, right: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Of each run its place and :func:`matrix`, or its :func:`exits` where costs beyond it are given."""

    def found():
        for run in _runs(batches):
            codes, at = codes_of(run, [r["seen"] for r in run])[0], run[0]["pos"]
            yield {"k": run[0]["k"], "at": at, name: exits(codes, right[at]) if right else matrix(codes)}

    return _batches(found(), pa.schema([("k", pa.string()), ("at", pa.int64()), (name, pa.list_(pa.int64()))]))


def _edited(batches: Iterator[pa.RecordBatch], right: dict, states: dict, last: set) -> Iterator[pa.RecordBatch]:
    return _batches((p for run in _runs(batches) for at in [run[0]["pos"]] for p in pieces_of(run, [r["seen"] for r in run], right[at], states[at], at in last)), PIECE)


# ---- Tables ----


def _copies(rows: DataFrame) -> DataFrame:
    return rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order over partitions and inside them: (k, conv_id, turn, role, text, copies, code, pos, part), written.

    Rows of one turn stand by role, the first 64 characters of the text, and its hash. Equal rows are spread by number.
    """
    core = F.btrim("text", F.lit(BLANKS))
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    fault = F.when(core == "", 2).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    all_of = _copies(rows).select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("k"),
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), F.col("copies").cast("int").alias("copies"),
    )
    all_of = all_of.withColumn("code", (3 * kind + fault).cast("int")).withColumn("head", F.left("text", F.lit(64))).withColumn("hash", F.xxhash64("text"))
    order = ["k", "turn", "role", "head", "hash", "number"]
    ordered = all_of.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "hash", "number")
    return durable(ordered.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))


def _with_seen(cut: DataFrame) -> DataFrame:
    """Whether role and text stand before in the conversation: by the first place of each in a partition, then of all partitions."""
    twice = cut.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    pair = ["k", "role", "t1", "t2"]
    here = twice.filter("copies > 0").groupBy(*pair, "part").agg(F.min("pos").alias("here"))
    first = here.withColumn("first_pos", F.min("here").over(Window.partitionBy(*pair))).drop("here")
    return twice.join(first, [*pair, "part"], "left").withColumn("seen", (F.col("copies") > 0) & (F.col("pos") > F.col("first_pos")))


def _over(right: tuple[int, ...], m: list[int]) -> tuple[int, ...]:
    return tuple(min(INF, *(m[4 * i + j] + right[j] for j in range(4))) for i in range(4))


def _cut_pieces(cut: DataFrame) -> DataFrame:
    """Pieces of conversations that lie in more than one partition."""
    row = ["k", "conv_id", "turn", "role", "text", "copies", "code", "pos", "seen"]
    rows = durable(_with_seen(cut).select(*row).repartitionByRange("pos").sortWithinPartitions("pos"))
    slim = rows.select("k", "pos", "code", "copies", "seen")
    costs = defaultdict(dict)
    for r in slim.mapInArrow(partial(_edges, name="costs"), "k string, at long, costs array<long>").collect():  # at most one a partition, and one a conversation
        costs[r.k][r.at] = r.costs
    right, last = {}, set()
    for of in costs.values():
        beyond = END
        last.add(max(of))
        for at in sorted(of, reverse=True):
            right[at] = AUTOMATON.vectors[AUTOMATON.state(beyond)[0]]
            beyond = _over(right[at], of[at])
    ways = {r.at: r.ways for r in slim.mapInArrow(partial(_edges, name="ways", right=right), "k string, at long, ways array<long>").collect()}
    states = {}
    for of in costs.values():
        state = START
        for at in sorted(of):
            states[at], state = state, ways[at][state]
    return rows.mapInArrow(partial(_edited, right=right, states=states, last=last), PIECE_SQL)


def _pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of the conversations that lie in one partition, and of the others, if there are any."""
    found = placed(rows)
    # at most one a partition begins there and ends in a later one
    over = durable(found.groupBy("k").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("k"))
    if over.isEmpty():
        return durable(found.mapInArrow(_whole, PIECE_SQL)), None
    whole = found.join(F.broadcast(over), "k", "left_anti").mapInArrow(_whole, PIECE_SQL)
    return durable(whole), durable(_cut_pieces(found.join(F.broadcast(over), "k")))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, place, role, text): the turns of the repaired conversations, in the order of piece and place.

    ``rows`` as in :func:`conversation_repair`.
    """
    whole, cut = _pieces(rows)
    found = whole if cut is None else whole.union(cut)
    return found.select("conv_id", F.col("at").alias("piece"), F.posexplode("repaired").alias("place", "turn")).select("conv_id", "piece", "place", "turn.role", "turn.text")


REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPORT_SQL = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each conversation from its pieces, which come in order and are read one at a time."""

    def found():
        one = k = None
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                if one is None or k != p["k"]:
                    if one:
                        yield done()
                    k, one = p["k"], dict.fromkeys(COUNTS, 0) | {"conv_id": p["conv_id"], "audit": [], "sha": hashlib.sha256(), "any": False, "turns": 0, "low": None, "high": None, "last": None}
                for c in COUNTS[1:]:
                    one[c] += p[c]
                if one["last"] is not None and p["first"] is not None:
                    one["illegal"] += (one["last"], p["first"]) not in LEGAL
                one["last"] = p["last"] if p["last"] is not None else one["last"]
                if p["low"] is not None:
                    one["turns"] += p["turns"] - (p["low"] == one["high"])
                    one["low"], one["high"] = one["low"] if one["low"] is not None else p["low"], p["high"]
                one["audit"].append(p["audit"])
                for t in p["repaired"]:
                    one["sha"].update(("\n" * one["any"] + f"{t['role']}:{t['text']}").encode())
                    one["any"] = True

                def done(one=one):
                    gaps = one["high"] - one["low"] + 1 - one["turns"] if one["low"] is not None else 0
                    return {c: one[c] for c in ("conv_id", *COUNTS)} | {"gaps": gaps, "audit": "".join(one["audit"]), "repaired_sha256": one["sha"].hexdigest()}

        if one:
            yield done()

    return _batches(found(), REPORT)


def conversation_repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text and, if rows may stand for none or several, copies; other columns are not read.
    Null roles and texts are one blank; rows without a conv_id are one conversation, and a null turn comes first. Rows of
    one turn stand by role and text. An empty role fits nowhere. A conversation whose rows have no copies gives zeros. An
    empty table gives no rows.
    """
    whole, cut = _pieces(rows)
    several = Window.partitionBy("k")
    body = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    counted = whole.withColumn("n", F.count(F.lit(1)).over(several))
    found = counted.filter("n = 1").select("conv_id", gaps, *COUNTS[1:], "audit", F.sha2(body.cast("binary"), 256).alias("repaired_sha256"))
    rest = counted.filter("n > 1").drop("n")
    rest = rest if cut is None else rest.union(cut)
    return found.union(rest.repartition("k").sortWithinPartitions("k", "at").mapInArrow(_joined, REPORT_SQL))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults drawn by row: lost, emptied, without ends of sentences, doubled, or of role user."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    drawn = (F.crc32(key.cast("binary")) % 20).alias("drawn")
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), drawn)
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("drawn") == 0, 0).when(F.col("drawn") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
