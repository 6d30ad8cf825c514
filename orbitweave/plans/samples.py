"""Queries on windows, samples, splits and reports, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.operators import chains, metrics, sampling, tracking
from orbitweave.plans.registry import query, table
from orbitweave.session import shared_dir
from orbitweave.sources import staged

r6 = lambda c: F.round(c, 6)
HASH = "event_id * 2654435761 % 4294967296"


def _hash(key: str) -> F.Column:
    return F.pmod(F.col(key) * 2654435761, F.lit(4294967296))


PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events"


@query(f"""WITH RECURSIVE e AS ({PLACED}), v AS (SELECT DISTINCT user_id, 0::BIGINT AS pos FROM events UNION ALL SELECT v.user_id, v.pos + CASE e.event_type WHEN 'click' THEN 4 WHEN 'error' THEN 9 ELSE 2 END FROM v JOIN e ON e.user_id = v.user_id AND e.pos = v.pos)
  SELECT e.user_id, e.event_id, e.pos FROM e JOIN v ON e.user_id = v.user_id AND e.pos = v.pos""")
def variable_stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a scan visits whose stride depends on what it meets."""
    stride = F.when(F.col("event_type") == "click", 4).when(F.col("event_type") == "error", 9).otherwise(2)
    return chains.reached(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], stride).select("user_id", "event_id", "pos")


@query("""WITH o AS (SELECT list(CASE WHEN value < 30 THEN 0 WHEN value < 55 THEN 1 ELSE 2 END ORDER BY ts, event_id) AS kinds, list(event_id ORDER BY ts, event_id) AS ids FROM events),
  r AS (SELECT ids, list_reduce(list_prepend({'k': 0, 'l': 0, 'h': 0, 's': ''}, list_transform(kinds, lambda k: {'k': k, 'l': 0, 'h': 0, 's': ''})), lambda a, x: {'k': x.k,
    'l': a.l + CASE WHEN x.k = 1 AND 4 * a.l <= 5 * a.h THEN 1 ELSE 0 END, 'h': a.h + CASE WHEN x.k = 2 AND 4 * a.h <= 5 * a.l THEN 1 ELSE 0 END,
    's': a.s || CASE WHEN x.k = 0 OR x.k = 1 AND 4 * a.l <= 5 * a.h OR x.k = 2 AND 4 * a.h <= 5 * a.l THEN '1' ELSE '0' END}).s AS picks FROM o)
  SELECT event_id FROM (SELECT unnest(ids) AS event_id, unnest(string_split(picks, '')) AS pick FROM r) WHERE pick = '1'""")
def balanced_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken in order of time: a middle or a high value only while its class is at most 5/4 of the other."""
    value = F.col("value")
    return chains.balanced_in_order(table(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], (value >= 30) & (value < 55), value >= 55).select("event_id")


@query(f"SELECT event_id, place, frame::INTEGER AS frame, ts + (frame - place) * INTERVAL 20 MINUTE AS frame_ts FROM (SELECT *, ({HASH} % 7)::INTEGER AS place FROM events WHERE event_type = 'signup'), generate_series(0, 6) g(frame)")
def event_at_random_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven frames around an event that stands at an index drawn by hash."""
    at = F.pmod(_hash("event_id"), F.lit(7)).cast("int")
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "ts", at.alias("place"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("frame"))
    return e.select("event_id", "place", "frame", (F.col("ts") + F.make_dt_interval(mins=(F.col("frame") - F.col("place")) * 20)).alias("frame_ts"))


@query("SELECT event_id, f::INTEGER AS step, dy, dx, ts + f * INTERVAL 20 MINUTE AS frame_ts FROM events, generate_series(-7, 6) g(f), (SELECT unnest([0, -512, 512, 0, 0]) AS dy, unnest([0, 0, 0, -512, 512]) AS dx) WHERE event_type = 'signup'")
def frames_by_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14 frames around an event at each of five places around its own."""
    places = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in ((0, 0), (-512, 0), (512, 0), (0, -512), (0, 512))])
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "ts", F.explode(F.sequence(F.lit(-7), F.lit(6))).alias("step"))
    return e.select("event_id", "step", (F.col("ts") + F.make_dt_interval(mins=F.col("step") * 20)).alias("frame_ts"), F.inline(places))


SEEN = f"SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY pos) > 1 AS again FROM (SELECT *, event_id * 7 % 60 AS k FROM ({PLACED}))"


@query(f"SELECT user_id, pos AS duplicate FROM ({SEEN}) WHERE again")
def duplicate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, in order, of records whose key a group has shown before."""
    e = tracking.with_repeats(table(spark, sf_dir, "events").withColumn("k", F.col("event_id") * 7 % 60), ["user_id"], ["ts", "event_id"], ["k"])
    return e.filter("again").select("user_id", F.col("pos").cast("long").alias("duplicate"))


@query(f"""WITH s AS ({SEEN}), c AS (SELECT *, count(*) OVER (PARTITION BY user_id) - 70 AS need, count(*) OVER (PARTITION BY user_id, again) AS m, row_number() OVER (PARTITION BY user_id, again ORDER BY pos) - 1 AS j, count(*) FILTER (again) OVER (PARTITION BY user_id) AS d FROM s),
  q AS (SELECT *, CASE WHEN again THEN least(need, d) ELSE need - d END AS goes FROM c)
  SELECT user_id, event_id FROM q WHERE goes <= 0 OR NOT list_contains(list_transform(generate_series(0, goes - 1), lambda i: CASE WHEN goes = 1 THEN 0 ELSE round_even(i * (m - 1) / (goes - 1), 0) END), j)""")
def fixed_length_by_dropping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups cut to 70 records: evenly spaced ones go, repeated ones before others."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") * 7 % 60)
    return tracking.cut_to_length(e, ["user_id"], ["ts", "event_id"], ["k"], 70).select("user_id", "event_id")


@query("SELECT user_id, list({'r': event_id * 37 % 200, 'c': event_id * 91 % 200} ORDER BY event_id * 37 % 200, event_id * 91 % 200)[1:3]::VARCHAR AS first_three FROM events WHERE event_type = 'error' GROUP BY 1")
def sorted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three positions of a group by row, then column."""
    at = F.struct((F.col("event_id") * 37 % 200).alias("r"), (F.col("event_id") * 91 % 200).alias("c"))
    g = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(at)), 1, 3).alias("p"))
    text = F.transform("p", lambda x: F.concat(F.lit("{'r': "), x["r"].cast("string"), F.lit(", 'c': "), x["c"].cast("string"), F.lit("}")))
    return g.select("user_id", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("first_three"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3 ORDER BY user_id, n LIMIT 40")
def limit_across_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records of each group, groups in order, until 40 are there: the limit is the feature, and files beyond it stay closed."""
    path = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    staged.write_ordered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), path, ["user_id"], ["ts", "event_id"])
    return staged.first_of_groups(spark, path, ["user_id"], ["ts", "event_id"], 3, 40).select("user_id", "event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def head_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query(f"(SELECT 'first' AS how, doc_id FROM documents ORDER BY doc_id LIMIT 12) UNION ALL (SELECT 'random', doc_id FROM documents ORDER BY {HASH.replace('event_id', 'doc_id')}, doc_id LIMIT 12)")
def first_or_random_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    how = lambda df, h: df.limit(12).select(F.lit(h).alias("how"), "doc_id")
    return how(docs.orderBy("doc_id"), "first").unionByName(how(docs.orderBy(_hash("doc_id"), "doc_id"), "random"))


@query(f"SELECT doc_id, CASE WHEN pos >= floor(n * 0.9) THEN 'test' WHEN ({HASH.replace('event_id', 'doc_id')}) % 9 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)")
def last_tenth_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth in order is the test; of the others a ninth, by hash, validates."""
    docs = sampling.with_dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "pos")
    n = docs.count()
    return docs.select("doc_id", F.when(F.col("pos") >= F.floor(F.lit(n) * 0.9), "test").when(_hash("doc_id") % 9 == 0, "val").otherwise("train").alias("split"))


@query(f"SELECT event_id, TIMESTAMP '2024-01-01' + ({HASH} % 525600)::INTEGER * INTERVAL 1 MINUTE AS ts, ({HASH} // 7 % 5424) // 32 * 32 + 16 AS r, ({HASH} // 11 % 5424) // 32 * 32 + 16 AS c FROM events WHERE event_type = 'signup'")
def random_times_and_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time in a span and a centre on the tile grid for each sample, drawn by hash."""
    h = _hash("event_id")
    snap = lambda x: F.floor(x / 32) * 32 + 16
    time = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(h % 525600).cast("int"))
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", time.alias("ts"), snap(F.floor(h / 7) % 5424).alias("r"), snap(F.floor(h / 11) % 5424).alias("c"))


@query("""WITH t AS (SELECT user_id, ts::DATE AS day, avg(CASE WHEN event_type <> 'click' THEN 1.0 ELSE 0.0 END) AS f FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS steps, count(*) FILTER (f >= 0.5) AS valid FROM t GROUP BY 1 HAVING count(*) FILTER (f >= 0.5) >= 3""")
def timestep_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with at least three time steps of which half the values are finite; clicks have none here."""
    t = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg((F.col("event_type") != "click").cast("double")).alias("f"))
    return t.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("f") >= 0.5).alias("valid")).filter("valid >= 3")


@query("SELECT user_id, count(*) AS length FROM events GROUP BY 1 HAVING count(*) BETWEEN 80 AND 105")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("length")).filter(F.col("length").between(80, 105))


@query("""SELECT l_linestatus, round((2 * mx * my + 1e6) * (2 * cxy + 9e6) / ((mx * mx + my * my + 1e6) * (vx + vy + 9e6)), 6) AS ssim FROM (SELECT l_linestatus, mx, my, exx - mx * mx AS vx, eyy - my * my AS vy, exy - mx * my AS cxy FROM (
  SELECT l_linestatus, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS exx, sum(w * y * y) / sum(w) AS eyy, sum(w * x * y) / sum(w) AS exy FROM (SELECT l_linestatus, l_linenumber::DOUBLE AS w, l_extendedprice AS x, l_quantity * 1000 AS y FROM lineitem) GROUP BY 1))""")
def weighted_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("pred", F.col("l_quantity") * 1000)
    return metrics.global_ssim(rows, ["l_linestatus"], "l_extendedprice", "pred", 1e5, F.col("l_linenumber").cast("double")).select("l_linestatus", r6("ssim").alias("ssim"))


@query("SELECT l_linestatus, round(max(m), 6) AS worst, round(avg(m), 6) AS mean FROM (SELECT l_linestatus, l_suppkey, avg(abs(l_quantity * 1000 - l_extendedprice)) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def summary_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(F.avg(F.abs(F.col("l_quantity") * 1000 - F.col("l_extendedprice"))).alias("m"))
    return batch.groupBy("l_linestatus").agg(r6(F.max("m")).alias("worst"), r6(F.avg("m")).alias("mean"))


@query("SELECT round(quantile_cont(m, 0.1), 6) AS p10, round(quantile_cont(m, 0.25), 6) AS p25, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.75), 6) AS p75, round(quantile_cont(m, 0.9), 6) AS p90, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)")
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the users' means."""
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    q = m.agg(F.percentile("m", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"), r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std"))
    return q.select(*[r6(F.get("q", F.lit(i))).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "mean", "std")


@query("""WITH q AS (SELECT month(o_orderdate) AS month, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
  SELECT q.month::INTEGER AS month, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS low, max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM q JOIN orders ON month(o_orderdate) = q.month GROUP BY q.month, q1, med, q3""")
def boxplot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 boxes of the box) and the count beyond, by month."""
    o = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("x"))
    s = metrics.boxplot(o, ["month"], "x")
    return s.select("month", *[F.round(c, 4).alias(c) for c in ("q1", "med", "q3")], "low", "high", "outliers")


@query("SELECT l_returnflag, least(floor(l_quantity / 5), 9)::BIGINT AS x, least(floor(l_discount * 100 / 2), 4)::BIGINT AS y, count(*) AS n FROM lineitem WHERE l_orderkey % 8 = 0 GROUP BY 1, 2, 3")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on two axes of every eighth position, as the sampled histogram is defined."""
    rows = table(spark, sf_dir, "lineitem").filter("l_orderkey % 8 = 0").withColumn("d", F.col("l_discount") * 100)
    return metrics.binned_counts_2d(rows, ["l_returnflag"], ("l_quantity", 0.0, 50.0, 10), ("d", 0.0, 10.0, 5)).select("l_returnflag", "x", "y", "n")


@query("SELECT user_id, string_agg(round(m, 3)::VARCHAR, ',' ORDER BY event_type) AS stack, count(*) AS bands FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's bands as one array, in the order of their names."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    g = m.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "m"))).alias("s"))
    return g.select("user_id", F.array_join(F.transform("s", lambda x: F.round(x["m"], 3).cast("string")), ",").alias("stack"), F.size("s").cast("long").alias("bands"))


@query("""WITH r AS (SELECT l_linenumber % 4 AS t, l_suppkey % 4 AS p FROM lineitem WHERE l_linenumber % 4 <> 3), c AS (SELECT class, (SELECT count(*) FROM r WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM r WHERE t = class) AS n FROM (SELECT DISTINCT t AS class FROM r))
  SELECT round(avg(tp / n), 6) AS macro_accuracy, round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM r), 6) AS accuracy FROM c""")
def macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the classes that occur of the share found, and the plain share; label 3 is ignored."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("t"), (F.col("l_suppkey") % 4).alias("p"))
    s = metrics.class_scores(rows, "t", "p", ignore=3).withColumn("own", F.col("tp") + F.col("fn"))
    return s.agg(r6(F.avg(F.when(F.col("own") > 0, F.col("tp") / F.col("own")))).alias("macro_accuracy"), r6(F.sum("tp") / F.sum("own")).alias("accuracy"))


@query("""WITH g AS (SELECT l_suppkey, l_partkey, l_returnflag, avg(pow(l_quantity - l_tax * 500, 2)) AS e FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT l_suppkey, l_partkey, avg(e) AS e FROM g GROUP BY 1, 2)
  SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_partkey % 4 > 0 THEN e END) / nullif(count(*) FILTER (l_partkey % 4 > 0), 0), 0), 4) AS loss FROM t GROUP BY 1""")
def group_averaged_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors averaged over channels, then over groups, then over the tokens that are masked."""
    e = F.pow(F.col("l_quantity") - F.col("l_tax") * 500, 2)
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.avg(e).alias("e"))
    tokens = groups.groupBy("l_suppkey", "l_partkey").agg(F.avg("e").alias("e"))
    return tokens.groupBy("l_suppkey").agg(F.round(F.coalesce(F.avg(F.when(F.col("l_partkey") % 4 > 0, F.col("e"))), F.lit(0.0)), 4).alias("loss"))


@query("SELECT l_suppkey, round(avg(m), 6) AS mean_mae FROM (SELECT l_suppkey, year(l_shipdate) AS t, avg(abs(l_quantity - l_tax * 500)) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def metric_averaged_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("t")).agg(F.avg(F.abs(F.col("l_quantity") - F.col("l_tax") * 500)).alias("m"))
    return t.groupBy("l_suppkey").agg(r6(F.avg("m")).alias("mean_mae"))
