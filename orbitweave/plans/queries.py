"""The library's queries on the test tables, each beside the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import geo, scaling
from orbitweave.operators import arrays, metrics, sampling, spatial, temporal, tracking
from orbitweave.plans import catalogues, grids, more, samples  # noqa: F401  they register their queries
from orbitweave.plans.registry import LAT, LON, QUERIES, SQL, query, table
from orbitweave.streaming.windows import windowed_counts

__all__ = ["QUERIES", "SQL"]

r6 = lambda c: F.round(c, 6)


@query("SELECT event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos = n // 2")
def middle_record_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.middle_record(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "ts", "user_id", "value")


BALANCED = "SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos = round_even((0.125 + 0.25 * (user_id % 4))::DOUBLE * (n - 1), 0)"


@query(BALANCED)
def balanced_anchor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_anchor(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("user_id")).select("event_id", "ts", "user_id")


@query(f"SELECT event_id, user_id, 'balanced' AS mode FROM ({BALANCED}) UNION ALL SELECT event_id, user_id, 'all' FROM events WHERE event_type IN ('error', 'signup')")
def sampling_modes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    balanced = sampling.sample_records(events, ["user_id"], ["ts", "event_id"], "balanced", F.col("user_id"))
    everything = sampling.sample_records(events.filter(F.col("event_type").isin("error", "signup")), ["user_id"], ["ts"], "all")
    return balanced.select("event_id", "user_id", F.lit("balanced").alias("mode")).unionByName(everything.select("event_id", "user_id", F.lit("all").alias("mode")))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return left, events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"), F.col("value").alias("purchase_value"))


def _asof(tolerance: int, rank: int, more: str = "") -> str:
    return f"""SELECT error_id, purchase_id, abs_micros, nth FROM (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY abs_micros, purchase_ts, purchase_id) AS nth FROM (
      SELECT e.event_id AS error_id, p.event_id AS purchase_id, p.ts AS purchase_ts, abs(epoch_us(e.ts) - epoch_us(p.ts)) AS abs_micros FROM events e JOIN events p
      ON e.event_type = 'error' AND p.event_type = 'purchase' {more} AND p.ts BETWEEN e.ts - INTERVAL {tolerance} SECOND AND e.ts + INTERVAL {tolerance} SECOND)) WHERE nth <= {rank}"""


@query(_asof(480, 1))
def nearest_event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.nearest_in_time(*_sides(spark, sf_dir), "error_id", "error_ts", "purchase_ts", "purchase_id", 480).select("error_id", "purchase_id", "abs_micros", "nth")


@query(_asof(3600, 3))
def nearest_k_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.nearest_in_time(*_sides(spark, sf_dir), "error_id", "error_ts", "purchase_ts", "purchase_id", 3600, rank=3).select("error_id", "purchase_id", "abs_micros", "nth")


@query(_asof(480, 1, "AND p.value <= 60"))
def asof_skip_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    quarantined = right.filter("purchase_value > 60").select("purchase_id")
    good = right.join(quarantined, "purchase_id", "left_anti")
    return temporal.nearest_in_time(left, good, "error_id", "error_ts", "purchase_ts", "purchase_id", 480).select("error_id", "purchase_id", "abs_micros", "nth")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(DISTINCT event_type) AS n_members, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def complete_scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.complete_groups(table(spark, sf_dir, "events"), F.expr("cast(date_trunc('HOUR', ts) AS timestamp_ntz)"), "hour", "event_type", 5)


@query("SELECT event_id, frame::INTEGER AS frame, ts + (frame - 3) * INTERVAL 20 MINUTE AS frame_ts FROM events, generate_series(0, 6) g(frame) WHERE event_type = 'signup'")
def frame_expansion_7x20min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.frames(table(spark, sf_dir, "events").filter("event_type = 'signup'"), "ts", 7, 3, 20).select("event_id", "frame", "frame_ts")


@query("SELECT event_id, user_id, lead(value, 1) OVER w AS lead1, lead(value, 2) OVER w AS lead2, lead(value, 3) OVER w AS lead3, ts - INTERVAL 120 MINUTE AS first_input FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def causal_frames_and_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tracking.Window.partitionBy("user_id").orderBy("ts", "event_id")
    leads = [F.lead("value", i).over(w).alias(f"lead{i}") for i in (1, 2, 3)]
    return table(spark, sf_dir, "events").select("event_id", "user_id", *leads, (F.col("ts") - F.make_dt_interval(mins=F.lit(120))).alias("first_input"))


@query("SELECT event_id, (CASE WHEN s = 72 THEN ts::DATE + 1 ELSE ts::DATE END)::VARCHAR AS slot_date, (CASE WHEN s = 72 THEN 0 ELSE s END)::INTEGER AS slot FROM (SELECT *, floor(floor(epoch(ts) - epoch(ts::DATE)) / 1200 + 0.5) AS s FROM events)")
def slot_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, slot = temporal.slot_of_day("ts")
    return table(spark, sf_dir, "events").select("event_id", date.cast("string").alias("slot_date"), slot.alias("slot"))


DAYS = "SELECT user_id, ts::DATE AS day, count(*) AS n, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"
ISLANDS = f"SELECT user_id, island, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS n_days, sum(n)::BIGINT AS n_events, round(sum(total), 6) AS total FROM (SELECT *, sum(CASE WHEN day - before <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS island FROM (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM ({DAYS}))) GROUP BY 1, 2"


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return tracking.islands(days, ["user_id"], "day").groupBy("user_id", "island").agg(
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("n_days"), F.sum("n").alias("n_events"), r6(F.sum("total")).alias("total")
    )


@query(ISLANDS)
def storm_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)


@query(f"SELECT user_id, island, n_days, CASE WHEN n_days > 1 THEN 'multi' WHEN user_id IN (SELECT user_id FROM ({ISLANDS}) GROUP BY 1 HAVING max(n_days) > 1) THEN 'single_of_multi' ELSE 'single' END AS kind FROM ({ISLANDS})")
def storm_islands_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _islands(spark, sf_dir).select("user_id", "island", "n_days")
    multi = found.filter("n_days > 1")
    single = found.filter("n_days = 1")
    users = multi.select("user_id").distinct()
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(multi, "multi").unionByName(kind(single.join(users, "user_id", "left_semi"), "single_of_multi")).unionByName(kind(single.join(users, "user_id", "left_anti"), "single"))


@query("""SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_flagged, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS ratio,
  round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders GROUP BY 1, 2""")
def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("o_orderstatus") == "F"
    q = lambda p: r6(F.percentile("o_totalprice", F.lit(p)))
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), r6(F.avg(flag.cast("double"))).alias("ratio"), q(0.25).alias("q1"), q(0.5).alias("med"), q(0.75).alias("q3")
    )


@query("SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS num_time_steps, count(*) * 20 AS duration_min FROM events GROUP BY 1")
def lifetime_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("num_time_steps"), (F.count("*") * 20).alias("duration_min"))


@query("SELECT event_type, ts::DATE::VARCHAR AS day, trunc(avg(value))::INTEGER AS center_y, trunc(avg(hour(ts)))::INTEGER AS center_x FROM events WHERE value > 0 GROUP BY 1, 2")
def label_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value > 0").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").cast("int").alias("center_y"), F.avg(F.hour("ts")).cast("int").alias("center_x"))


@query("""SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, (SELECT count(*) FROM customer s WHERE s.c_mktsegment = c.c_mktsegment AND s.c_custkey NOT IN (SELECT o_custkey FROM orders)) AS customers_without
  FROM customer c JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def key_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    without = customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers_without"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    n = customer.join(urgent, customer.c_custkey == urgent.o_custkey).join(lines.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = n.groupBy("c_mktsegment").agg(F.count_distinct("o_orderkey").alias("orders"), F.count("*").alias("lines"))
    return sums.join(without, "c_mktsegment", "left").fillna(0, ["customers_without"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
def semi_join_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(dear, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT d.source, count(l.doc_id) AS paired, count(*) - count(l.doc_id) AS skipped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def pairing_with_missing_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("has").alias("paired"), (F.count("*") - F.count("has")).alias("skipped"))


@query("SELECT CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 10000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'written' END AS reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    reason = F.when(F.col("n_chars") < 200, "too_short").when(F.col("n_chars") > 10000, "too_long").when(F.col("lang") != "en", "language").when(F.col("has").isNull(), "no_label").otherwise("written")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(labels, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, round(avg(CASE WHEN quality >= 0 THEN quality::DOUBLE END), 6) AS fraction, bool_or(toxic = 1) AS any_toxic, bool_and(n_chars > 10) AS all_long FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(quality) >= 0.8 AND count(*) >= 5")
def quality_gate_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    g = both.groupBy("source").agg(F.avg(F.when(F.col("quality") >= 0, F.col("quality"))).alias("f"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.bool_and(F.col("n_chars") > 10).alias("all_long"), F.count("*").alias("n"))
    return g.filter("f >= 0.8 AND n >= 5").select("source", r6("f").alias("fraction"), "any_toxic", "all_long")


def _errors(by: str) -> str:
    m = "(l_linenumber % 2 = 1)"
    return f"""SELECT {by}, n, round(mse, 3) AS mse, round(mae, 6) AS mae, round(bias, 6) AS bias, round(masked_mse, 3) AS masked_mse, round(visible_mse, 3) AS visible_mse, round(sqrt(mse), 6) AS rmse, round(10 * log10(1e10 / greatest(mse, 1e-12)), 6) AS psnr FROM (
      SELECT {by}, count(*) AS n, avg(e * e) AS mse, avg(abs(e)) AS mae, avg(e) AS bias, coalesce(avg(CASE WHEN {m} THEN e * e END), 0) AS masked_mse, coalesce(avg(CASE WHEN NOT {m} THEN e * e END), 0) AS visible_mse
      FROM (SELECT *, l_quantity * p_retailprice - l_extendedprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY {by})"""


def _error_rows(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).withColumn("pred", F.col("l_quantity") * F.col("p_retailprice"))
    m = metrics.error_metrics(rows, by, "pred", "l_extendedprice", 1e5, F.col("l_linenumber") % 2 == 1)
    return m.select(*by, "n", *[F.round(c, 3 if c.endswith("mse") and c != "rmse" else 6).alias(c) for c in ("mse", "mae", "bias", "masked_mse", "visible_mse", "rmse", "psnr")])


@query(_errors("l_returnflag"))
def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rows(spark, sf_dir, ["l_returnflag"])


@query(_errors("l_suppkey, l_returnflag"))
def per_sample_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error_rows(spark, sf_dir, ["l_suppkey", "l_returnflag"])


def _reconstruction(by: str, frame: str) -> str:
    kinds = {"masked": "(l_linenumber % 2 = 1)", "visible": "(l_linenumber % 2 = 0)", "full": "true"}
    each = lambda f: ", ".join(f(r, m) for r, m in kinds.items())
    moments = each(lambda r, m: f"""count(e) FILTER ({m}) AS {r}_n, sum(e * e) FILTER ({m}) AS {r}_sse, sum(abs(e)) FILTER ({m}) AS {r}_sae, sum(e) FILTER ({m}) AS {r}_se, coalesce(avg(p) FILTER ({m}), 0) AS {r}_mp, coalesce(avg(t) FILTER ({m}), 0) AS {r}_mt,
      coalesce(var_pop(p) FILTER ({m}), 0) AS {r}_vp, coalesce(var_pop(t) FILTER ({m}), 0) AS {r}_vt, coalesce(covar_pop(p, t) FILTER ({m}), 0) AS {r}_c""")
    ssim = each(lambda r, _: f"avg((2 * {r}_mp * {r}_mt + 1e6) * (2 * {r}_c + 9e6) / (({r}_mp * {r}_mp + {r}_mt * {r}_mt + 1e6) * ({r}_vp + {r}_vt + 9e6))) AS {r}_ssim")
    sums = each(lambda r, _: f"sum({r}_n)::BIGINT AS {r}_count, coalesce(sum({r}_sse), 0) / greatest(sum({r}_n), 1) AS {r}_mse, coalesce(sum({r}_sae), 0) / greatest(sum({r}_n), 1) AS {r}_mae, coalesce(sum({r}_se), 0) / greatest(sum({r}_n), 1) AS {r}_bias")
    out = each(lambda r, _: f"{r}_count, round({r}_mse, 2) AS {r}_mse, round(sqrt({r}_mse), 5) AS {r}_rmse, round({r}_mae, 5) AS {r}_mae, round({r}_bias, 5) AS {r}_bias, round(10 * log10(1e10 / greatest({r}_mse, 1e-12)), 6) AS {r}_psnr, round({r}_ssim, 6) AS {r}_ssim")
    return f"""SELECT {by}, {out}, round(target_mean, 5) AS target_mean, round(prediction_mean, 5) AS prediction_mean FROM (SELECT {by}, {sums}, {ssim}, sum(ts) / sum(full_n) AS target_mean, sum(ps) / sum(full_n) AS prediction_mean FROM (
      SELECT {by}, {frame} AS frame, {moments}, sum(t) AS ts, sum(p) AS ps FROM (SELECT *, l_quantity * p_retailprice AS p, l_extendedprice AS t, l_quantity * p_retailprice - l_extendedprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY {by}, {frame}) GROUP BY {by})"""


def _reconstruction_rows(spark: SparkSession, sf_dir: str, by: list[str], frame: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("pred", F.col("l_quantity") * F.col("p_retailprice")).withColumn("frame", F.expr(frame))
    m = metrics.reconstruction_metrics(rows, by, ["frame"], "pred", "l_extendedprice", F.col("l_linenumber") % 2 == 1, 1e5)
    digits = lambda c: 2 if c.endswith("_mse") else 6 if c.endswith(("psnr", "ssim")) else 5
    return m.select(*[c if c in by or c.endswith("_count") else F.round(c, digits(c)).alias(c) for c in m.columns])


@query(_reconstruction("l_returnflag", "l_suppkey"))
def reconstruction_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic of masked, visible and all rows of a band, similarity as the mean over suppliers."""
    return _reconstruction_rows(spark, sf_dir, ["l_returnflag"], "l_suppkey")


@query(_reconstruction("l_suppkey, l_returnflag", "l_orderkey % 3"))
def reconstruction_by_sample_and_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruction_rows(spark, sf_dir, ["l_suppkey", "l_returnflag"], "l_orderkey % 3")


@query("""SELECT l_linestatus, round((2 * mx * my + 1e6) * (2 * cxy + 9e6) / ((mx * mx + my * my + 1e6) * (vx + vy + 9e6)), 6) AS ssim FROM (
  SELECT l_linestatus, avg(l_extendedprice) AS mx, avg(l_quantity * 1000) AS my, var_pop(l_extendedprice) AS vx, var_pop(l_quantity * 1000) AS vy, covar_pop(l_extendedprice, l_quantity * 1000) AS cxy FROM lineitem GROUP BY 1)""")
def global_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("pred", F.col("l_quantity") * 1000)
    return metrics.global_ssim(rows, ["l_linestatus"], "l_extendedprice", "pred", 1e5).select("l_linestatus", r6("ssim").alias("ssim"))


@query("""SELECT l_linestatus, round(coalesce(avg(abs(e)), 0), 6) AS mae, round(coalesce(avg(e), 0), 6) AS bias, round(coalesce(avg(CASE WHEN l_extendedprice >= 50000 THEN abs(e) END), 0), 6) AS wet_mae,
  round(coalesce(avg(CASE WHEN l_extendedprice >= 50000 THEN e END), 0), 6) AS wet_bias, round(corr(l_quantity * 1000, l_extendedprice), 6) AS corr FROM (SELECT *, l_quantity * 1000 - l_extendedprice AS e FROM lineitem) GROUP BY 1""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("pred", F.col("l_quantity") * 1000)
    m = metrics.regression_metrics(rows, ["l_linestatus"], "pred", "l_extendedprice", 50000.0)
    return m.select("l_linestatus", *[r6(c).alias(c) for c in m.columns[1:]])


@query("""WITH u AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), q AS (SELECT quantile_cont(m, 0.33) AS lo, quantile_cont(m, 0.67) AS hi FROM u)
  SELECT CASE WHEN m < lo THEN 'good' WHEN m < hi THEN 'medium' ELSE 'bad' END AS bucket, count(*) AS n, arg_min(user_id, m) AS least, arg_max(user_id, m) AS most, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM u, q GROUP BY 1""")
def percentile_report_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    cuts = users.agg(F.percentile("m", F.array(F.lit(0.33), F.lit(0.67))).alias("q"))
    bucket = F.when(F.col("m") < F.col("q")[0], "good").when(F.col("m") < F.col("q")[1], "medium").otherwise("bad")
    return users.join(F.broadcast(cuts)).groupBy(bucket.alias("bucket")).agg(  # one row
        F.count("*").alias("n"), F.min_by("user_id", "m").alias("least"), F.max_by("user_id", "m").alias("most"), r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std")
    )


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY 1) SELECT event_id, round(least(1, greatest(0, (value - lo) / (hi - lo))), 6) AS stretched FROM events JOIN q USING (event_type)")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    q = events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return events.join(q, "event_type").select("event_id", r6(scaling.min_max(F.col("value"), F.col("q")[0], F.col("q")[1])).alias("stretched"))


@query("SELECT quality AS true_class, toxic AS pred_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("share", r6("share"))


SCORES = """WITH r AS (SELECT l_linenumber % 4 AS t, l_suppkey % 5 AS p FROM lineitem WHERE l_linenumber % 4 <> {ignore}), c AS (SELECT t AS class FROM r UNION SELECT p FROM r),
 s AS (SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t = class AND p <> class) AS fn FROM r JOIN c ON t = class OR p = class GROUP BY 1)"""


@query(SCORES.format(ignore=-1) + " SELECT class::BIGINT AS class, tp, fp, fn, round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM s")
def iou_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("t"), (F.col("l_suppkey") % 5).alias("p"))
    return metrics.class_scores(rows, "t", "p").select("class", "tp", "fp", "fn", r6("iou").alias("iou"))


@query(SCORES.format(ignore=3) + " SELECT round(avg(tp / nullif(tp + fp + fn, 0)), 6) AS macro_iou, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, round(avg((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6)), 6) AS macro_dice FROM s")
def macro_segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("t"), (F.col("l_suppkey") % 5).alias("p"))
    return metrics.class_scores(rows, "t", "p", ignore=3).agg(*[r6(F.avg(c)).alias(f"macro_{c}") for c in ("iou", "f1", "dice")])


@query("SELECT g.class, count(label) AS n FROM generate_series(0, 11) g(class) LEFT JOIN embeddings ON label = g.class GROUP BY 1")
def class_histogram_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.filled_histogram(table(spark, sf_dir, "embeddings"), "label", 12)


@query("""SELECT l_suppkey, round(median(l_extendedprice), 6) AS med, (SELECT l_linenumber FROM lineitem i WHERE i.l_suppkey = o.l_suppkey GROUP BY 1 ORDER BY count(*) DESC, l_linenumber LIMIT 1) AS mode_line FROM lineitem o GROUP BY 1""")
def mode_median_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r6(F.median("l_extendedprice")).alias("med"), F.mode("l_linenumber", True).alias("mode_line"))


LONG = "(SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"SELECT dim, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM {LONG} GROUP BY 1")
def dimension_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = arrays.dimension_statistics(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("dim", *[r6(c).alias(c) for c in s.columns[1:]])


@query(f"""WITH s AS (SELECT dim, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS sd FROM {LONG} GROUP BY 1) SELECT vec_id, dim, round((x - m) / greatest(sd, 1e-6), 5) AS z, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 5) AS scaled FROM {LONG} JOIN s USING (dim)""")
def dimension_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    s = arrays.dimension_statistics(e, "embedding")
    long = e.select("vec_id", F.posexplode("embedding").alias("dim", "x0")).withColumn("x", F.col("x0").cast("double"))
    return long.join(s, "dim").select("vec_id", "dim", F.round(scaling.z_score(F.col("x"), F.col("mean"), F.col("std")), 5).alias("z"), F.round(scaling.min_max(F.col("x"), F.col("low"), F.col("high")), 5).alias("scaled"))


def _nearest(distance: str) -> str:
    return f"""WITH a AS (SELECT event_id AS id_a, ({LAT})::DOUBLE AS lat_a, ({LON})::DOUBLE AS lon_a FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS id_b, ({LAT})::DOUBLE AS lat_b, ({LON})::DOUBLE AS lon_b FROM events WHERE event_type = 'click' AND event_id % 3 = 0),
     w AS (SELECT *, abs((CASE WHEN lon_a < 0 THEN lon_a + 360 ELSE lon_a END) - (CASE WHEN lon_b < 0 THEN lon_b + 360 ELSE lon_b END)) AS d FROM a, b) SELECT id_a, round(min({distance}), 6) AS distance FROM w GROUP BY 1"""


def _nearest_rows(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """Every third click is a place that can be found, so that some are far from all."""
    events = table(spark, sf_dir, "events")
    side = lambda on, s: events.filter(on).select(F.col("event_id").alias(f"id_{s}"), F.expr(LAT).cast("double").alias(f"lat_{s}"), F.expr(LON).cast("double").alias(f"lon_{s}"))
    return spatial.nearest_in_space(side("event_type = 'error'", "a"), side("event_type = 'click' AND event_id % 3 = 0", "b"), "id_a", "id_b", measure).select("id_a", r6("distance").alias("distance"))


@query(_nearest("abs(lat_a - lat_b) + least(d, 360 - d)"))
def spatial_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(spark, sf_dir, "l1_wrapped")


@query(_nearest("pow(lat_a - lat_b, 2) + pow((lon_a - lon_b) * cos(radians(lat_a)), 2)"))
def spatial_nearest_cos_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(spark, sf_dir, "cos_squared")


@query(_nearest("sqrt(pow(lat_a - lat_b, 2) + pow(lon_a - lon_b, 2))"))
def spatial_nearest_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(spark, sf_dir, "euclidean")


@query(_nearest("abs(lat_a - lat_b) + abs(lon_a - lon_b)"))
def spatial_nearest_without_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_rows(spark, sf_dir, "l1")


@query("SELECT c_custkey, CASE WHEN i >= 0 AND i < 11000 // 500 AND abs(c_acctbal - (i * 500.0 - 1000)) <= 0.45 * 500 THEN i::INTEGER END AS cell FROM (SELECT *, round_even((c_acctbal + 1000) / 500.0, 0) AS i FROM customer)")
def regular_grid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", spatial.grid_index(F.col("c_acctbal"), -1000.0, 500.0, 22, 0.45).alias("cell"))


@query("""WITH m AS (SELECT *, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, event_id = first_value(event_id) OVER (PARTITION BY user_id ORDER BY abs(event_id % 97 - 48), event_id) AS anchor FROM events),
  h AS (SELECT user_id, run FROM m WHERE anchor AND value < 60) SELECT m.user_id, m.event_id FROM m JOIN h ON m.user_id = h.user_id AND m.run = h.run WHERE m.value < 60""")
def inside_box_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = F.first("event_id").over(tracking.Window.partitionBy("user_id").orderBy(F.abs(F.col("event_id") % 97 - 48), "event_id"))
    events = table(spark, sf_dir, "events").withColumn("a", F.col("event_id") == nearest)
    return tracking.inside_run(events, ["user_id"], ["ts", "event_id"], F.col("value") < 60, F.col("a")).select("user_id", "event_id")


@query("SELECT n_nationkey, count(*) AS n, min(c_custkey) AS first_key FROM nation JOIN customer ON c_acctbal BETWEEN n_nationkey * 300 - 500 AND n_nationkey * 300 + 100 GROUP BY 1")
def box_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 300.0 - 500).alias("lo"), (F.col("n_nationkey") * 300.0 + 100).alias("hi"))
    found = spatial.in_boxes(boxes, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 600.0)
    return found.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_discount * 100 / 0.5)::INTEGER AS a, least(floor((l_discount * 100 + l_quantity / 5) / 0.5), 39)::INTEGER AS b, (l_suppkey % 8 + 1)::INTEGER AS kind, l_partkey FROM lineitem),
  e AS (SELECT l_orderkey, unnest(generate_series(a, b)) AS bin, l_linenumber * 1000000 + l_partkey AS ord, kind FROM l WHERE b >= a) SELECT l_orderkey, bin::INTEGER AS bin, arg_max(kind, ord * 10 + kind) AS kind FROM e GROUP BY 1, 2""")
def layer_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_discount") * 100
    layers = table(spark, sf_dir, "lineitem").select("l_orderkey", base.alias("base"), (base + F.col("l_quantity") / 5).alias("top"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("kind"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10 + F.col("l_suppkey") % 8 + 1).alias("ord"))
    return arrays.rasterise(layers, ["l_orderkey"], "base", "top", "kind", "ord", 40, 0.5)


@query("""WITH v AS (SELECT o_custkey, (epoch(o_orderdate) / 86400)::DOUBLE AS day, CASE WHEN o_totalprice > 150000 THEN o_totalprice - 150000 END AS y FROM orders), c AS (SELECT o_custkey, count(y) AS n FROM v GROUP BY 1),
  p AS (SELECT o_custkey, day, avg(y) AS y FROM v WHERE y IS NOT NULL GROUP BY 1, 2), g AS (SELECT unnest([9000.0, 9500.0, 10000.0, 10500.0])::DOUBLE AS z),
  s AS (SELECT c.o_custkey, g.z, any_value(n) AS n, max(CASE WHEN p.day <= g.z THEN p.day END) AS x0, arg_max(y, CASE WHEN p.day <= g.z THEN p.day END) AS y0, min(CASE WHEN p.day >= g.z THEN p.day END) AS x1, arg_min(y, CASE WHEN p.day >= g.z THEN p.day END) AS y1 FROM c CROSS JOIN g LEFT JOIN p USING (o_custkey) GROUP BY 1, 2)
  SELECT o_custkey, z AS day, round(CASE WHEN n < 2 THEN 0 WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (z - x0) / (x1 - x0) END, 4) AS price FROM s""")
def linear_interp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices below 150,000 turn negative and don't count; customers with less than two that do get zeros."""
    points = table(spark, sf_dir, "orders").select("o_custkey", (temporal.micros("o_orderdate") / 86_400_000_000).alias("day"), (F.col("o_totalprice") - 150_000).alias("price"))
    out = arrays.interpolate(points, ["o_custkey"], "day", "price", [9000.0, 9500.0, 10000.0, 10500.0])
    return out.withColumn("price", F.round("price", 4))


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))))"


@query(f"""WITH p AS (SELECT user_id, event_id, ts, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon FROM events), q AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, round(sum(coalesce({HAVERSINE}, 0)), 3) AS km FROM q GROUP BY 1""")
def haversine_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    return tracking.along_track(points, ["user_id"], ["ts", "event_id"], "lat", "lon").groupBy("user_id").agg(F.round(F.max("track_km"), 3).alias("km"))


@query(f"""WITH p AS (SELECT event_id, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3.6e9::DOUBLE AS h, 2 * pi() / dayofyear(make_date(year(ts), 12, 31)) * (dayofyear(ts) - 1 + ((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3.6e9::DOUBLE - 12) / 24) AS g FROM events),
  q AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS tilt FROM p)
  SELECT event_id, round(degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(tilt) + cos(radians(lat)) * cos(tilt) * cos(radians((h * 60 + eq + 4 * lon) / 4 - 180)))))), 4) AS sza FROM q""")
def solar_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the time of day to the microsecond, and the length of the time's own year."""
    hour = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)") / 3.6e9
    sza = geo.solar_zenith(F.dayofyear("ts"), hour, F.expr(LAT).cast("double"), F.expr(LON).cast("double"), geo.year_days("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(sza, 4).alias("sza"))


@query(f"""WITH p AS (SELECT event_id, radians(({LAT})::DOUBLE) AS p, radians(({LON})::DOUBLE) AS q FROM events), n AS (SELECT *, 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2, 6378137.0 / sqrt(1 - (1 / 298.257223563 * (2 - 1 / 298.257223563)) * pow(sin(p), 2)) AS n FROM p),
  d AS (SELECT *, 42164160.0 * cos(radians(-75.0)) - n * cos(p) * cos(q) AS dx, 42164160.0 * sin(radians(-75.0)) - n * cos(p) * sin(q) AS dy, -n * (1 - e2) * sin(p) AS dz FROM n)
  SELECT event_id, round(degrees(acos(greatest(-1, least(1, (dx * cos(p) * cos(q) + dy * cos(p) * sin(q) + dz * sin(p)) / sqrt(dx * dx + dy * dy + dz * dz))))), 4) AS vza FROM d""")
def view_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(geo.view_zenith(F.expr(LAT).cast("double"), F.expr(LON).cast("double"), -75.0), 4).alias("vza"))


@query("SELECT l_linenumber, CASE WHEN x < 0 THEN 0 ELSE 1 + (x >= 0.25)::INTEGER + (x >= 0.5)::INTEGER + (x >= 0.75)::INTEGER END::INTEGER AS stage, count(*) AS n FROM (SELECT *, l_quantity / 50 - 0.1 AS x FROM lineitem) GROUP BY 1, 2")
def digitize_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", scaling.stage_class(F.col("l_quantity") / 50 - 0.1).cast("int").alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT event_id, (year(ts) - 2000)::INTEGER AS y, (month(ts) - 1)::INTEGER AS mo, (day(ts) - 1)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi FROM events")
def time_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.year("ts") - 2000).alias("y"), (F.month("ts") - 1).alias("mo"), (F.dayofmonth("ts") - 1).alias("d"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"))


@query("SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1)::INTEGER AS number FROM pages")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("://([^/]*)").alias("host"), part("/([a-z]{2})/[0-9]+").alias("lang"), part("/([0-9]+)").cast("int").alias("number"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events ORDER BY k DESC, event_id LIMIT 25")
def json_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).orderBy(F.desc("k"), "event_id").limit(25)


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) = 1")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.first_seen(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM p WHERE n <= 12 OR list_contains(list_transform(generate_series(0, 11), lambda i: round_even(i * (n - 1) / 11, 0)), pos)")
def evenly_spaced_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.evenly_spaced(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 12).select("user_id", "event_id")


SPLIT = "CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.9) THEN 'val' ELSE 'test' END"


@query(f"SELECT doc_id, {SPLIT} AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def range_split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = tracking.Window.partitionBy("lang")
    placed = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("pos", F.row_number().over(by.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(by))
    return placed.select("doc_id", F.expr(SPLIT).alias("split"))


@query("SELECT doc_id, CASE WHEN (doc_id * 2654435761) % 4294967296 % 5 = 0 THEN 'hold_out' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.pmod(F.pmod(F.col("doc_id") * 2654435761, F.lit(4294967296)), F.lit(5))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(draw == 0, "hold_out").otherwise("train").alias("split"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id * 2654435761 % 4294967296, event_id) > floor(count(*) OVER (PARTITION BY user_id) * (1 - 0.75)))::INTEGER AS masked FROM events")
def rank_noise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.struct(F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296)), "event_id")
    return arrays.rank_mask(table(spark, sf_dir, "events"), ["user_id"], noise, 0.75).select("user_id", "event_id", "masked")


@query("SELECT event_id, r, c, (r // 8) * 8 + c // 8 AS patch, (r % 8) * 8 + c % 8 AS place FROM (SELECT event_id, event_id // 64 % 64 AS r, event_id % 64 AS c FROM events)")
def patchify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select("event_id", F.expr("event_id DIV 64 % 64").alias("r"), (F.col("event_id") % 64).alias("c"))
    return arrays.patches(cells, "r", "c", 8, 64)


@query("SELECT conv_id, turn, i::INTEGER AS dim, round(CASE WHEN i < 8 THEN sin(turn / pow(10000.0, i / 8)) ELSE cos(turn / pow(10000.0, (i - 8) / 8)) END, 6) AS value FROM conversations, generate_series(0, 15) g(i)")
def sincos_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's place in its conversation as 16 sines and cosines."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(arrays.sincos(F.col("turn"), 16)).alias("dim", "v"))
    return turns.select("conv_id", "turn", "dim", r6("v").alias("value"))


@query("""SELECT user_id, center::INTEGER AS center, round(mean, 6) AS mean, low FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS center, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER w AS mean, min(value) OVER w AS low FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE center >= 4 AND center < n - 4 AND (center - 4) % 5 = 0""")
def sliding_profile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tracking.sliding_windows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 9, 5, {"mean": F.avg("value"), "low": F.min("value")})
    return w.select("user_id", "center", r6("mean").alias("mean"), "low")


@query("SELECT l_suppkey, round(avg(least(1, greatest(0, l_quantity * pi() * pow(0.9916, 2) / 150))), 6) AS albedo, round(avg((1392.74 / ln(10803.3 / greatest(l_quantity, 1e-6) + 1) - 0.0755) / 0.99975), 4) AS kelvin FROM lineitem GROUP BY 1")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r6(F.avg(scaling.reflectance(x, 0.9916, 150.0))).alias("albedo"), F.round(F.avg(scaling.brightness_temperature(x, 10803.3, 1392.74, 0.0755, 0.99975)), 4).alias("kelvin"))


@query("SELECT event_type, time_bucket(INTERVAL 20 MINUTE, ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_counts(table(spark, sf_dir, "events"))
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("total").alias("total"))


@query("SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN 'east' WHEN n_regionkey = 1 AND c_acctbal < 0 THEN 'west_low' WHEN n_regionkey = 1 THEN 'west' ELSE 'None' END AS satellite, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def satellite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    region_key = F.col("n_regionkey")
    kind = F.when(region_key == 0, "east").when((region_key == 1) & (F.col("c_acctbal") < 0), "west_low").when(region_key == 1, "west").otherwise("None")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, region_key == F.col("r_regionkey")).select("c_custkey", kind.alias("satellite"), "r_name")


@query("SELECT conv_id, (dense_rank() OVER (ORDER BY conv_id) - 1)::BIGINT AS idx, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def dense_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids get their places by a range partitioning and the counts before each part, so that no task sorts them all."""
    groups = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))
    return sampling.with_dense_index(groups, "conv_id", "idx")


@query("SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7")
def subset_of_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    return have.filter(F.size(F.array_except(F.array(*[F.lit(i) for i in range(1, 8)]), "have")) == 0).select("l_orderkey")
