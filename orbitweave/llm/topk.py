"""Exact top-k inner products by length buckets (operator 1).

Vectors are ordered by length and packed into buckets of similar length, which stay where they are. The queries come to
them, in rounds of bounded size, as a file that each executor maps into memory. The longest buckets give each query a first
bound; then each task meets its buckets in falling length. The k-th score so far bounds the cosine that a bucket's vectors
must exceed: above one the bucket is skipped, high bounds search sorted coordinate lists for the candidates, low ones take
all that are long enough; products are then verified. Only scores that reach a query's bound leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.session import durable, shared_file

#: Vectors of a bucket at most, and the least ratio of its lengths; queries of a block at most.
BUCKET_ROWS, BUCKET_RATIO, QUERY_ROWS = 4096, 0.9, 2048
#: Bytes of queries that meet the buckets in one round, about; and the longest buckets, which give the first bounds.
ROUND_BYTES, SEED_BUCKETS = 16_000_000, 4
#: From this cosine bound on, sorted coordinate lists pay; and the coordinates looked at.
COORDINATE_FROM, FOCUS = 0.75, 3


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _taken(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v, length) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    v = good.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v"))
    return v.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _pack(rows: int, ratio: float):
    """Packs length-ordered (vec_id, v, length) rows into blocks of one dimension and similar length."""

    def block(ids: list[int], vs: list[list[int]], lengths: list[float]) -> dict:
        m = np.array(vs, np.int64).reshape(len(ids), -1)
        return {"ids": np.array(ids, np.int64).tobytes(), "data": m.tobytes(), "n": len(ids), "dim": m.shape[1], "longest": max(lengths)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, lengths, out = [], [], [], []
        for b in batches:
            for i, v, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (len(ids) == rows or len(v) != len(vs[0]) or length < ratio * lengths[0]):
                    out.append(block(ids, vs, lengths))
                    ids, vs, lengths = [], [], []
                ids.append(i)
                vs.append(v)
                lengths.append(length)
            if out:
                yield pa.RecordBatch.from_pylist(out, _BLOCK)
                out = []
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, vs, lengths)], _BLOCK)

    return run


_BLOCK = pa.schema([("ids", pa.binary()), ("data", pa.binary()), ("n", pa.int32()), ("dim", pa.int32()), ("longest", pa.float64())])
_BLOCK_SQL = "ids binary, data binary, n int, dim int, longest double"


def _unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    number = np.frombuffer(ids, np.int64)
    return number, np.frombuffer(data, np.int64).reshape(len(number), dim)


class Search:
    """The k best so far of a block of queries, of those that reach ``least``."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.queries, self.k, self.least = ids, queries, k, least
        self.lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted

    def bounds(self) -> np.ndarray:
        return np.maximum(self.least, [-f[-1][0] if len(f) == self.k else -np.inf for f in self.found])

    def meet(self, ids: np.ndarray, bucket: np.ndarray, longest: float) -> None:
        dim = max(bucket.shape[1], self.queries.shape[1])  # missing components count as zero
        widen = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m
        bucket, queries = widen(bucket), widen(self.queries)
        # float64 products are exact while no sum can pass 2 ** 53; whole numbers wrap as 64-bit sums do
        most = float(np.abs(bucket.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(dim, 1)
        kind = np.float64 if most < 2**53 else np.int64
        lengths = np.sqrt((bucket.astype(np.float64) ** 2).sum(axis=1))
        scale = self.lengths * longest
        bound = self.bounds()
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(scale > 0, bound / scale, np.where(bound > 0, np.inf, -np.inf))
        cosine -= 1e-9  # rounding must not skip an equal score
        if kind is np.int64:
            cosine[:] = -np.inf
        live = np.flatnonzero(cosine <= 1)
        by_list = live[(cosine[live] >= COORDINATE_FROM) & (dim > 0)]
        rest = live[cosine[live] < COORDINATE_FROM]
        exact = bucket.astype(kind)
        for lo in range(0, len(rest), 256):
            part = rest[lo : lo + 256]
            with np.errstate(invalid="ignore", divide="ignore"):
                least = np.where(self.lengths[part] > 0, bound[part] / self.lengths[part], -np.inf)
            upto = int(np.searchsorted(-lengths, -(least.min() - 1e-6), "right")) if np.isfinite(least).all() and kind is np.float64 else len(ids)
            self.verify(part, queries[part].astype(kind) @ exact[:upto].T, ids[:upto])
        if len(by_list):
            unit = bucket / np.maximum(lengths, 1e-300)[:, None]
            order, values = np.argsort(unit, axis=0, kind="stable"), np.sort(unit, axis=0)
            for q in by_list:
                near = self.candidates(queries[q] / self.lengths[q], min(float(cosine[q]), 1.0), order, values)
                if len(near):
                    self.verify(np.array([q]), queries[q : q + 1].astype(kind) @ exact[near].T, ids[near])

    @staticmethod
    def candidates(unit: np.ndarray, cosine: float, order: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Vectors of a bucket whose largest query coordinates all lie where the cosine can still be reached."""
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        hits = np.zeros(len(order), np.int8)
        for f in focus:
            reach = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2)))
            a, b = unit[f] * cosine - reach, unit[f] * cosine + reach
            # towards the query's own direction the region is open: cosines above the bound lie there too
            low = -1.0 if unit[f] <= -cosine else a
            high = 1.0 if unit[f] >= cosine else b
            lo, hi = np.searchsorted(values[:, f], low - 1e-9, "left"), np.searchsorted(values[:, f], high + 1e-9, "right")
            hits[order[lo:hi, f]] += 1
        return np.sort(np.flatnonzero(hits == len(focus)))

    def verify(self, rows: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        for q, scores in zip(rows.tolist(), products, strict=True):
            found = self.found[q]
            keep = np.flatnonzero(scores >= (-found[-1][0] if len(found) == self.k else self.least[q]))
            keep = keep[ids[keep] != self.ids[q]]
            if len(keep) > self.k:
                keep = keep[np.lexsort((ids[keep], -scores[keep]))[: self.k]]
            self.found[q] = sorted([*found, *((-int(scores[i]), int(ids[i])) for i in keep)])[: self.k]


def _write(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Blocks of queries as integers: their number, of each its rows and dimension, then of each its ids and vectors."""
    head = [len(parts), *(x for ids, v in parts for x in (len(ids), v.shape[1]))]
    return b"".join([np.array(head, np.int64).tobytes(), *(x.tobytes() for ids, v in parts for x in (ids, v))])


def _read(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = data[1 : 1 + 2 * data[0]].reshape(-1, 2)
    at = 1 + sizes.size
    for n, dim in sizes.tolist():
        yield data[at : at + n], data[at + n : at + n + n * dim].reshape(n, dim)
        at += n + n * dim


def _searcher(k: int, queries: str, bounds: str | None):
    """Meets the buckets of a task with the blocks of file ``queries``, from the scores in file ``bounds`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: list[Search] | None = None
        for b in batches:
            if searches is None:
                blocks = list(_read(np.memmap(SparkFiles.get(queries), np.int64, "r")))
                total = sum(len(ids) for ids, _ in blocks)
                least = np.memmap(SparkFiles.get(bounds), np.float64, "r") if bounds else np.full(total, -np.inf)
                searches, at = [], 0
                for ids, v in blocks:
                    searches.append(Search(ids, v, k, least[at : at + len(ids)]))
                    at += len(ids)
            for r in range(b.num_rows):
                ids, data, dim, longest = (b.column(c)[r].as_py() for c in ("ids", "data", "dim", "longest"))
                bucket = _unpacked(ids, data, dim)
                for s in searches:
                    s.meet(*bucket, longest)
        at = 0
        for s in searches or ():
            rows = [(at + q, int(s.ids[q]), i, -score) for q, f in enumerate(s.found) for score, i in f]
            at += len(s.ids)
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["place", "query_id", "vec_id", "score"])

    return run


_FOUND = "place long, query_id long, vec_id long, score long"


def _round(buckets: DataFrame, blocks: list, seeds: float, k: int) -> DataFrame:
    """(query_id, vec_id, score) of what the buckets have for ``blocks``: the k best of each task that reach the bounds."""
    spark = buckets.sparkSession
    parts = [_unpacked(bytes(r.ids), bytes(r.data), r.dim) for r in blocks]
    queries = shared_file(spark, "queries", _write(parts))
    first = buckets.filter(F.col("longest") >= seeds).mapInArrow(_searcher(k, queries, None), _FOUND)
    kth = first.groupBy("place").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("bound"))  # k of each seed bucket's task at most
    least = np.full(sum(len(ids) for ids, _ in parts), -np.inf)
    for r in kth.filter("bound is not null").toLocalIterator():  # a number a query of the round
        least[r.place] = r.bound
    return buckets.mapInArrow(_searcher(k, queries, shared_file(spark, "bounds", least.tobytes())), _FOUND).select("query_id", "vec_id", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with all other vectors.

    ``vectors`` has vec_id and embedding; other columns are not read. ``queries`` picks the queries' rows by vec_id.
    Components count as floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without
    vec_id, take no part. Every row is a candidate but those of the query's own vec_id: rows that repeat a vec_id count
    each, and the answers of queries that share one are ranked together. Vectors of different dimension are compared as if padded with
    zeros. Ties go to the smaller vec_id; with fewer than ``k`` others all are returned. An empty table gives no rows.

    The driver holds the queries of one round at a time, ``round_bytes`` about. Buckets aren't moved once packed; what is
    shuffled are the vectors, once, and the scores that reach the bounds.
    """
    taken = durable(_taken(vectors, scale))
    ordered = taken.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    buckets = durable(ordered.mapInArrow(_pack(bucket_rows, BUCKET_RATIO), _BLOCK_SQL))
    asked = durable(taken.filter(queries).sortWithinPartitions(F.desc("length"), "vec_id").mapInArrow(_pack(query_rows, 0.0), _BLOCK_SQL))
    rounds = -(-asked.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0] // round_bytes) or 1
    longest = [r.longest for r in buckets.select("longest").orderBy(F.desc("longest")).limit(SEED_BUCKETS).collect()]
    found = [vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")]
    for n in range(rounds):
        blocks = asked.filter(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == n).collect()
        if not blocks:
            continue
        part = _round(buckets, blocks, longest[-1] if longest else 0.0, k)
        found.append(part if rounds == 1 else durable(part))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same query for DuckDB.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
