import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import topk
from orbitweave.llm.topk import top_k


def plain(rows, k):
    import math

    good = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q in {i for i, _ in good if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for o, v in good if o == q for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("start", "rounds"), [(0.0, 10**6), (0.75, 500)])
def test_matches_brute_force(spark, monkeypatch, start, rounds):
    monkeypatch.setattr(topk, "COORDINATE_FROM", start)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = []
    for i in range(600):
        v = centres[i % 5] + rng.normal(size=8) * 0.1
        v *= rng.choice([0.1, 1.0, 3.0]) / np.linalg.norm(v)
        rows.append((i, [float(x) for x in v], 1, 1))
    rows += [(1000 + i, rows[50][1], 1, 1) for i in range(30)]  # ties
    rows += [(2000, None, 1, 1), (2001, [None] + [0.5] * 7, 1, 1), (2050, [float("nan")] * 8, 1, 1), (2002, [float("inf")] * 8, 1, 1)]
    rows += [(None, [0.1] * 8, 1, 1), (50, rows[50][1], 1, 1), (100, [0.3] * 8, 1, 1), (2100, [], 1, 1), (2150, [0.0] * 8, 1, 1), (2103, [2.0] * 3, 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, *_ in rows]
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, bucket_rows=64, query_rows=7, round_bytes=rounds).collect())
    assert got == plain(rows, 5)


def test_rows_that_share_an_id_count_each_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in [*range(120), 50, 50, 7, 7, 100]]
    rows += [(7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(con.execute(topk.SQL).fetchall())


def test_huge_components_and_few_rows(spark):
    rows = [(0, [3e6, -2e6]), (1, [2.5e6, 1e6]), (50, [-1e6, 4e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()) == plain(rows, 5)
    assert top_k(df.filter(F.lit(False)), F.col("vec_id") % 50 == 0).collect() == []
