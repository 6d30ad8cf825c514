"""Further queries of the library: predicates, gates, losses, gathers and selections, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import scaling
from orbitweave.operators import arrays, metrics, sampling, spatial, states, temporal, tracking
from orbitweave.plans.registry import query, table
from orbitweave.session import shared_dir
from orbitweave.sources import files, sinks

r6 = lambda c: F.round(c, 6)
CELL = "(event_id * 37) % 200"


@query(f"SELECT event_type, count(*) FILTER (c - 8 >= 40 AND c + 8 < 160) AS half_open, count(*) FILTER (c BETWEEN 40 AND 160) AS closed, bool_and(c >= 0 AND c < 200) AS all_inside FROM (SELECT event_type, {CELL} AS c FROM events) GROUP BY 1")
def disk_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select("event_type", F.expr(CELL).alias("c"))
    inside = lambda lo, hi, half, closed: spatial.inside_disk(F.col("c"), lo, hi, half, closed)
    return cells.groupBy("event_type").agg(
        F.count_if(inside(40, 160, 8, False)).alias("half_open"), F.count_if(inside(40, 160, 0, True)).alias("closed"), F.bool_and(inside(0, 200, 0, False)).alias("all_inside")
    )


@query("SELECT user_id, count(*) AS n, count(v) AS finite, (count(v) = 0 OR max(abs(v)) = 0 OR stddev_pop(v) = 0) AS rejected FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) GROUP BY 1")
def degenerate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(F.count("*").alias("n"), F.count("v").alias("finite"), metrics.degenerate("v").alias("rejected"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 1) > 0 AS f0, (l_partkey & 2) > 0 AS f1, (l_partkey & 4) > 0 AS f2, (l_partkey & 128) > 0 AS f7 FROM lineitem WHERE (l_partkey & 6) = 0")
def quality_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i: (F.getbit("l_partkey", F.lit(i)) == 1).alias(f"f{i}")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_partkey").bitwiseAND(F.lit(6)) == 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", bit(0), bit(1), bit(2), bit(7))


@query("""SELECT l_returnflag, round(avg(e * e), 4) AS mse, round(avg(pow(ln(1 + l_quantity) - ln(1 + l_tax * 500), 2)), 6) AS log1p_mse, round(coalesce(avg(CASE WHEN l_linestatus = 'F' THEN abs(e) END), 0), 6) AS masked_mae,
  round(max(abs(e)), 6) AS max_abs, round(avg(greatest(l_discount, 0) - l_discount * y + ln(1 + exp(-abs(l_discount)))), 6) AS bce FROM (SELECT *, l_quantity - l_tax * 500 AS e, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem) GROUP BY 1""")
def loss_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.col("l_tax") * 500).withColumn("y", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0))
    m = metrics.losses(rows, ["l_returnflag"], "l_quantity", "t", "l_discount", "y", F.col("l_linestatus") == "F")
    return m.select("l_returnflag", F.round("mse", 4).alias("mse"), *[r6(c).alias(c) for c in ("log1p_mse", "masked_mae", "max_abs", "bce")])


@query("SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(var_samp(l_extendedprice), 3) AS var FROM lineitem GROUP BY 1")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r6(F.avg("l_extendedprice")).alias("mean"), F.round(F.var_samp("l_extendedprice"), 3).alias("var"))


@query("SELECT l_returnflag, least(greatest(floor(l_extendedprice / 5000), 0), 19)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_orderkey % 8 = 0 GROUP BY 1, 2")
def strided_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled histogram of the reference: every eighth position is its definition."""
    return metrics.binned_counts(table(spark, sf_dir, "lineitem").filter("l_orderkey % 8 = 0"), ["l_returnflag"], "l_extendedprice", 0.0, 100_000.0, 20)


@query("SELECT event_type, round(quantile_cont(value, 0.3), 6) AS low, round(quantile_cont(value, 0.7), 6) AS high FROM events GROUP BY 1")
def percentile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.contrast_limits(table(spark, sf_dir, "events"), ["event_type"], "value", 0.8)
    return q.select("event_type", r6("low").alias("low"), r6("high").alias("high"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings) WHERE nth <= floor(1.25 * (SELECT min(n) FROM c))""")
def class_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_classes(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 1.25)


@query("SELECT event_id, o::INTEGER AS minutes, ts + o * INTERVAL 1 MINUTE AS frame_ts FROM events, (SELECT unnest([-60, -40, -20, 0, 20, 40, 60]) AS o) WHERE event_type = 'error'")
def offset_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.at_offsets(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts"), "ts", [-60, -40, -20, 0, 20, 40, 60]).select("event_id", "minutes", "frame_ts")


@query("SELECT c_custkey, CASE WHEN c_acctbal < -1000 THEN 0 ELSE least(ceil((c_acctbal + 1000) / 500 - 0.5), 21) END::INTEGER AS axis FROM customer")
def nearest_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = [-1000.0 + 500.0 * i for i in range(22)]
    return table(spark, sf_dir, "customer").select("c_custkey", spatial.axis_index(F.col("c_acctbal"), axis).alias("axis"))


@query("""SELECT user_id, round(median(abs(d)), 6) AS step FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE abs(d) > 0 GROUP BY 1""")
def typical_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.typical_step(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", r6("step").alias("step"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE l_discount END AS merged FROM lineitem")
def merge_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(masked, F.col("l_quantity")).otherwise(F.col("l_discount")).alias("merged"))


@query("SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS a, round(embedding[1]::DOUBLE, 6) AS b, round(embedding[13]::DOUBLE, 6) AS c, round(embedding[8]::DOUBLE, 6) AS first_cut, 70 AS padded FROM embeddings")
def gather_and_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-ordered gather of channels, the middle 50 of 64 values, and padding to 70."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.gather(v, [3, 0, 12]).alias("g"), arrays.centred(v, 50, F.lit(0.0)).alias("cut"), arrays.centred(v, 70, F.lit(0.0)).alias("pad"))
    at = lambda c, i: r6(F.get(c, F.lit(i)))
    return e.select("vec_id", at("g", 0).alias("a"), at("g", 1).alias("b"), at("g", 2).alias("c"), at("cut", 0).alias("first_cut"), F.size("pad").alias("padded"))


@query("SELECT vec_id, i // 16 AS t, i % 16 AS channel, round(x, 6) AS x FROM (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def time_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return flat.select("vec_id", F.floor(F.col("i") / 16).alias("t"), (F.col("i") % 16).cast("long").alias("channel"), r6(F.col("x").cast("double")).alias("x"))


@query("SELECT event_id, printf('%s_%08d_%s', event_type, event_id, strftime(ts, '%Y%m%d%H%M')) AS name, dayofyear(ts)::INTEGER AS doy, (make_date(year(ts), 1, 1) + (dayofyear(ts) - 1)::INTEGER)::VARCHAR AS day FROM events")
def formatted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    doy = F.dayofyear("ts")
    day = F.date_add(F.make_date(F.year("ts"), F.lit(1), F.lit(1)), doy - 1)
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%s_%08d_%s", "event_type", "event_id", F.date_format("ts", "yyyyMMddHHmm")).alias("name"), doy.alias("doy"), day.cast("string").alias("day"))


@query("SELECT l_partkey, replace(replace(lower(p_name), '-', '_'), ' ', '_') AS alias, (l_partkey // 32) * 32 + 16 AS tile FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01') JOIN part ON l_partkey = p_partkey")
def alias_and_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and tile centres of the parts in a set difference: shipped early, and never late."""
    lines = table(spark, sf_dir, "lineitem")
    early, late = lines.filter("l_shipdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'").select("l_partkey"), lines.filter("l_shipdate >= TIMESTAMP_NTZ'2001-01-01 00:00:00'").select("l_partkey")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return early.subtract(late).join(names, "l_partkey").select("l_partkey", F.translate(F.lower("p_name"), "- ", "__").alias("alias"), (F.floor(F.col("l_partkey") / 32) * 32 + 16).alias("tile"))


@query("SELECT c_custkey, i::INTEGER AS dim, ((c_custkey * 4 + i + 42) * 2654435761 % 4294967296) / 4294967296.0::DOUBLE AS x FROM customer, generate_series(0, 3) g(i)")
def synthetic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in vectors that each customer's key draws."""
    made = files.synthetic(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 4)
    return made.select("c_custkey", F.posexplode("vector").alias("dim", "x"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS of_order, o_custkey, round(o_totalprice, 2) AS price FROM orders")
def grouped_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that share a prefix as one struct, and read from it."""
    held = sinks.grouped_by_prefix(table(spark, sf_dir, "orders"), {"o_order": "by_order", "o_": "rest"})
    return held.select(F.col("by_order.key").alias("o_orderkey"), F.concat_ws("|", "by_order.status", "by_order.priority").alias("of_order"), F.col("rest.custkey").alias("o_custkey"), F.round("rest.totalprice", 2).alias("price"))


@query("SELECT doc_id, length(text) AS n, 'none' AS title, source AS origin FROM documents")
def optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under the first of several names that the table has, or a default."""
    d = table(spark, sf_dir, "documents")
    body, title, origin = files.first_present(d, ["body", "text"]), files.first_present(d, ["title", "headline"], F.lit("none")), files.first_present(d, ["source", "lang"])
    return d.select("doc_id", F.length(body).cast("long").alias("n"), title.alias("title"), origin.alias("origin"))


@query("SELECT l_returnflag, CASE WHEN l_extendedprice / 10 < 100 THEN 'surface' WHEN l_extendedprice / 10 < 5000 THEN 'low' ELSE 'high' END AS tag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def height_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", scaling.height_tag(F.col("l_extendedprice") / 10).alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, bool_and(event_id % 3 > 0) AS created, count(*) FILTER (event_id % 3 = 0 OR NOT seen) AS written FROM (SELECT *, bool_or(event_id % 3 = 0) OVER (PARTITION BY user_id, event_type) AS seen FROM events) GROUP BY 1, 2")
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one place: the second creates the keys that the first, of every third record, had not, and skips the others."""
    path = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    e, keys = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"]
    sinks.write_new(e.filter("event_id % 3 = 0"), path, keys)
    second = sinks.write_new(e, path, keys).select(*keys, "created")
    there = sinks.read_written(spark, path).groupBy(*keys).agg(F.count("*").alias("written"))
    return second.join(there, keys)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of two runs, each of which reads only the files that it adds."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 100).cast("double").alias("pred"), (F.col("event_id") % 2 == 0).alias("masked"), "event_id")
    one = lambda rows, file: states.band_states(rows, ["event_type", file], "pred", "value", F.col("masked"))
    for part in ("event_id % 3 = 0", "event_id % 3 > 0"):
        e.filter(part).write.mode("append").parquet(f"{path}/rows")
        states.add_new_files(spark, f"{path}/rows", f"{path}/states", one)
    return states.merged(spark.read.parquet(f"{path}/states"), ["event_type"])


@query("""SELECT event_type, count(*) FILTER (m) AS masked_count, round(avg(e * e) FILTER (m), 5) AS masked_mse, round(avg(e) FILTER (m), 6) AS masked_bias, count(*) FILTER (NOT m) AS visible_count, round(avg(abs(e)) FILTER (NOT m), 6) AS visible_mae, round(sqrt(avg(e * e)), 6) AS full_rmse,
  round(10 * log10(1e4 / avg(e * e)), 6) AS full_psnr, round(avg(value), 6) AS target_mean, min(value) AS low, max(value) AS high FROM (SELECT *, event_id % 100 - value AS e, event_id % 2 = 0 AS m FROM events) GROUP BY 1""")
def incremental_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band metrics and extremes from the states of two runs, as one run over all rows gives them."""
    m = states.band_report(_runs(spark, sf_dir), ["event_type"], 100.0)
    return m.select("event_type", "masked_count", F.round("masked_mse", 5).alias("masked_mse"), r6("masked_bias").alias("masked_bias"), "visible_count", *[r6(c).alias(c) for c in ("visible_mae", "full_rmse", "full_psnr", "target_mean")], "low", "high")


@query("SELECT event_type, p AS share, count(*) AS n, true AS near FROM events, (SELECT unnest([2, 25, 50, 75, 98])::INTEGER AS p) GROUP BY 1, 2")
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from the merged sketches of two runs: whether the rank of each among all values is within twice the stated error."""
    shares = [2, 25, 50, 75, 98]
    found = _runs(spark, sf_dir).select("event_type", F.posexplode(F.array(*states.quantiles("sketch", [p / 100 for p in shares]))).alias("i", "q"))
    all_of = table(spark, sf_dir, "events").select("event_type", "value").join(F.broadcast(found), "event_type")  # five rows a type, and five types
    ranks = all_of.groupBy("event_type", "i").agg(F.count("*").alias("n"), F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    share = F.element_at(F.array(*[F.lit(p) for p in shares]), F.col("i") + 1)
    near = (F.col("below") <= share / 100 + 2 * states.RANK_ERROR) & (F.col("upto") >= share / 100 - 2 * states.RANK_ERROR)
    return ranks.select("event_type", share.alias("share"), "n", near.alias("near"))
