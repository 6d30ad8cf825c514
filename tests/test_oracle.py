"""Each query beside its SQL in DuckDB, on the small tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from orbitweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Joins and windows, which have few rows to meet on the smallest tables.
LARGER = (
    "balanced_in_order", "nearest_complete_scan", "nearest_event_asof", "nearest_k_candidates", "nearest_requested_scan", "raster_gather", "reconstruction_by_sample_and_band",
    "scans_by_request", "spatial_nearest", "spatial_nearest_cos_squared", "spatial_nearest_euclidean", "spatial_nearest_without_wrap", "storm_islands", "truth_by_lookup", "variable_stride_windows", "write_once",
)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return f"{float(x):.9g}" if type(x).__name__ == "Decimal" else str(x) if not isinstance(x, dt.datetime) else x.isoformat()

    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def check(spark, name, sf):
    """Compares a query with its SQL; how many rows it gives."""
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    found = got.collect()
    assert rows(got.columns, found) == rows(columns, want.fetchall())
    return len(found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert check(spark, name, SF) or check(spark, name, "/root/testdata/sf0.01"), "a query without rows shows nothing"


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_sql_on_more_rows(spark, name):
    assert check(spark, name, "/root/testdata/sf0.01")
