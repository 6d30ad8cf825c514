"""Near-duplicates by SimHash and generalised pigeonhole search (operator 10).

A pair within ``distance`` bits must be within t_i bits on some part i of the 64 bits whenever the sum of
(t_i + 1) exceeds ``distance``. Correlated bits go to one part, and dynamic programming hands out the t_i (-1: the
part is not probed) by the candidates that a bounded sample of fingerprints lets expect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.components import components
from orbitweave.session import durable

BITS = 64
SEED = 42
#: Fingerprints of the sample on which parts and thresholds are fitted; the search itself covers all.
SAMPLE = 4096
#: Members of a bucket that one task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Edges that a task holds to tie them before it hands them on.
TASK_EDGES = 1_000_000
#: Signatures of one fingerprint on one part at most; plans beyond are too wide to generate.
MOST_PROBES = 600
#: Cost of shuffling one probe, in comparisons.
PROBE_COST = 20.0


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of a text's word shingles, as an unsigned integer; 0 without words."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    n = len(words)
    if not n:
        return 0
    joined, k = b" ".join(words), words_per_shingle
    if n <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _keyed(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, key, fp) by row of ``docs``; key is the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, fp long")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``, fp the fingerprint as a signed 64-bit number. Null text: as empty."""
    return _keyed(docs, words_per_shingle).select("doc_id", "fp")


def correlated_parts(bits: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` parts; each part gathers the bits that correlate most with those it has."""
    spread = bits.std(axis=0)
    safe = np.where(spread > 0, spread, 1)
    centred = (bits - bits.mean(axis=0)) / safe
    strength = np.abs(centred.T @ centred) / max(len(bits), 1)
    np.fill_diagonal(strength, 0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = len(left) // (m - i)
        seed = max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())
        part = [seed]
        left.remove(seed)
        while len(part) < width:
            near = max(sorted(left), key=lambda b: strength[b, part].sum())
            part.append(near)
            left.remove(near)
        parts.append(sorted(part))
    return parts


def plan_parts(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe, cheapest for ``total`` fingerprints by the sample's estimate."""
    sample = sample.astype(np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) if len(sample) else np.zeros((1, BITS))
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    pairs = max(total * (total - 1) / 2, 1)
    for m in range(2, min(distance + 3, BITS)):
        parts = correlated_parts(bits, m)
        budget = distance - m + 1  # what the thresholds sum up to
        cost = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            near = np.zeros(distance + 1)
            for lo in range(0, len(sample), 256):
                apart = np.bitwise_count((sample[lo : lo + 256, None] ^ sample[None, :]) & mask)
                near += [np.count_nonzero(apart <= t) for t in range(distance + 1)]
            share = np.maximum(near - len(sample), 1) / max(len(sample) * (len(sample) - 1), 1)
            probes = [comb(len(part), t) for t in range(distance + 1)]
            cost.append([0.0] + [PROBE_COST * max(total, 1) * n + share[t] * pairs if n <= MOST_PROBES else np.inf for t, n in enumerate(probes)])
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # by the sum of (t + 1) so far
        for c in cost:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (so_far, chosen) in table.items():
                for t in range(-1, distance + 1):
                    if used + t + 1 <= budget + m:
                        entry = (so_far + c[t + 1], (*chosen, t))
                        if used + t + 1 not in after or entry < after[used + t + 1]:
                            after[used + t + 1] = entry
            table = after
        total_cost, chosen = table[budget + m]
        if best is None or total_cost < best[0]:
            best = total_cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]
    assert best is not None
    return best[1]


def signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(sig, val, fp): two values within t bits on a part share a signature, one that leaves out t of its bits."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks = [sum(1 << b for b in part if b not in out) for part, t in plan for out in combinations(part, t)]
    each = F.array(*[F.struct(F.lit(i).alias("sig"), F.col("fp").bitwiseAND(F.lit(signed(x)).cast("long")).alias("val")) for i, x in enumerate(masks)])
    return fps.select("fp", F.explode(each).alias("s")).select("s.sig", "s.val", "fp")


def _rooted(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Ties the sets of ``a`` and ``b``, place by place; ``label`` names the least place of each place's set."""
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _linker(distance: int):
    keys = ("sig", "val", "lo", "hi")

    def settle(cols: list[np.ndarray], fp: np.ndarray) -> np.ndarray:
        """Spanning edges of the links inside each run of equal keys, as rows of two."""
        n = len(fp)
        label = np.arange(n)
        same = np.ones(n - 1, bool) if n else np.zeros(0, bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        group = np.concatenate(([0], np.cumsum(~same))) if n else np.zeros(0, int)
        i, d = np.arange(n), 1
        while True:
            i = i[i + d < n]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            a, b = i, i + d
            near = (label[a] != label[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)
            _rooted(label, a[near], b[near])
            d += 1
        tied = np.flatnonzero((label != np.arange(n)) & (fp != fp[label]))
        return np.stack([fp[tied], fp[label[tied]]], axis=1)

    def stars(edges: list[np.ndarray]) -> pa.RecordBatch:
        """The edges of a task as one star a component, so that what several buckets repeat leaves it once."""
        nodes, places = np.unique(np.concatenate(edges).view(np.int64), return_inverse=True)
        places = places.reshape(-1, 2)
        label = np.arange(len(nodes))
        _rooted(label, places[:, 0], places[:, 1])
        tied = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[tied]), pa.array(nodes[label[tied]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        edges: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.ones(len(cols[0]), bool)
            for c in cols[:-1]:
                last &= c == c[-1]
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                edges.append(settle([c[:cut] for c in cols[:-1]], cols[-1][:cut].view(np.uint64)))
            if sum(map(len, edges)) > TASK_EDGES:
                yield stars(edges)
                edges = []
        if held is not None:
            edges.append(settle(held[:-1], held[-1].view(np.uint64)))
            yield stars(edges)

    return run


def near_edges(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all pairs within ``distance`` bits.

    Every pair within ``distance`` is compared in some bucket; a bucket yields a spanning forest of its links, never
    all its pairs, and a task ties those of its buckets. Edges of different tasks may repeat. Buckets over ``block`` members are dealt out as pairs of hashed blocks, so no task holds more
    than about two blocks of one bucket.
    """
    total = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    probes = signatures(fps, plan_parts(sample, total, distance))
    hot = probes.groupBy("sig", "val").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("sig", "val", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = (
        probes.join(hot, ["sig", "val"], "left")
        .withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")).otherwise(F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .select("sig", "val", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    keys = ["sig", "val", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linker(distance), "u long, v long")


def _kinds(own: DataFrame, distance: int) -> DataFrame:
    """(fp, best, n, root) of each fingerprint of ``own`` (doc_id, key, fp).

    best is the first of its rows by (id is null, id, key), n their number, root the least fingerprint of its component.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best")
    kinds = durable(own.groupBy("fp").agg(best, F.count("*").alias("n")))
    roots = components(near_edges(kinds.select("fp"), distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return kinds.join(roots, "fp", "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3, words_per_shingle: int = 3, salts: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest doc_id that links of at most ``distance``
    differing bits reach, itself included. Null text counts as empty, and texts without words have fingerprint zero
    and link like any other. Repeated rows stay; a null doc_id joins its component without naming it (a component of
    nulls only has a null id). An empty table gives no rows.
    """
    own = durable(_keyed(docs, words_per_shingle).select("doc_id", "key", "fp"))
    linked = _kinds(own, distance)
    first = linked.groupBy("root").agg(F.min("best").alias("first"), F.count("*").alias("kinds"))
    # A fingerprint that one row has, without links, needs no lookup: its component is that row.
    shared = linked.join(first, "root").filter("n > 1 or kinds > 1").select(
        F.col("fp").alias("shared_fp"), F.col("first.doc_id").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    salted = own.withColumn("own_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(shared, (F.col("fp") == F.col("shared_fp")) & (F.col("own_salt") == F.col("salt")), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("shared_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, distance: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns.

    The row of smallest doc_id stays; rows without an id only where their component has no other. Of rows that agree in
    it the one whose text has the smallest hash stays, of rows of one id and text one. Texts that are null or have no
    words are a component. An empty table gives no rows. Columns of any name ride in a struct.
    """
    winners = _kinds(durable(_keyed(docs, words_per_shingle)), distance).groupBy("root").agg(F.min("best").alias("best"))
    # An id and whether it is there as two columns without nulls, so that grouping and join share one shuffle.
    named = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id"), F.col(c).isNull().alias("unnamed"))
    winners = winners.select(*named("best.doc_id"), F.col("best.key").alias("key"))
    # Equal rows meet in their task first, so that many copies of one row don't meet in one.
    rows = docs.select(F.struct("*").alias("row"), *named("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    rows = rows.groupBy("id", "unnamed", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(winners, ["id", "unnamed", "key"], "left_semi").select("row.*")
