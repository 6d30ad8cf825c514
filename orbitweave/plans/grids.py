"""Queries on grids, rasters, tokens and arrays, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitweave.functions import scaling
from orbitweave.operators import arrays, metrics, spatial, tiles
from orbitweave.plans.registry import LAT, LON, query, table
from orbitweave.session import shared_dir
from orbitweave.sources import rasters

r6 = lambda c: F.round(c, 6)
#: A raster of 200 x 200 cells made from the events.
ROW, COL = "(event_id * 37) % 200", "(event_id * 91 + event_id // 200) % 200"
CELLS = f"SELECT {ROW} AS r, {COL} AS c, event_id, user_id, value, event_type FROM events"
LONG = "(SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda e: F.expr(e.replace("//", "DIV")).alias
    return table(spark, sf_dir, "events").select(at(ROW)("r"), at(COL)("c"), "event_id", "user_id", "value", "event_type")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x0")).select("vec_id", "i", F.col("x0").cast("double").alias("x"))


@query(f"SELECT r, c, event_id, value FROM ({CELLS}) WHERE r BETWEEN 40 AND 119 AND c BETWEEN 60 AND 99 AND event_type = 'click'")
def hyperslab_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of rows and columns of one slice: of a written raster the slice's folder, and there the window's tiles."""
    path = f"{shared_dir(spark)}/raster-{uuid.uuid4().hex}"
    rasters.write_raster(_cells(spark, sf_dir), path, ["event_type"])
    return rasters.read_raster(spark, path, (40, 119), (60, 99)).filter("event_type = 'click'").select("r", "c", "event_id", "value")


@query(f"SELECT r, c, count(*) AS n, max(value) AS top FROM ({CELLS}) WHERE r % 8 = 0 AND c % 8 = 0 GROUP BY 1, 2")
def coarse_strided_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth row and column, as a coarse search grid is defined: of a written raster the levels that hold them."""
    path = f"{shared_dir(spark)}/raster-{uuid.uuid4().hex}"
    rasters.write_raster(_cells(spark, sf_dir).select("r", "c", "value"), path)
    return rasters.read_raster(spark, path, (0, 199), (0, 199), 8).groupBy("r", "c").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND lower(trim(CASE WHEN event_id % 3 = 0 THEN ' TRUE' WHEN event_id % 3 = 1 THEN 'True ' ELSE 'no' END)) = 'true'")
def in_list_and_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 3 == 0, " TRUE").when(F.col("event_id") % 3 == 1, "True ").otherwise("no")
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error") & scaling.is_true(flag)).select("event_id", "event_type", "value")


@query(f"SELECT event_id, lat FROM (SELECT event_id, ({LAT})::DOUBLE AS lat FROM events) WHERE lat BETWEEN -23.5 AND 23.5")
def latitude_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(LAT).cast("double").alias("lat")).filter(F.col("lat").between(-23.5, 23.5))


@query(f"""SELECT channel, floor(r * scale)::BIGINT AS r, floor(c * scale)::BIGINT AS c, count(*) AS n FROM (SELECT *, (event_id % 16 + 1)::INTEGER AS channel FROM ({CELLS})) JOIN (SELECT unnest(generate_series(1, 16))::INTEGER AS ch, unnest([2, 4, 2, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]) * 0.5 AS scale) ON ch = channel GROUP BY 1, 2, 3""")
def index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a 1 km grid on each channel's own grid, by a table of 16 scales."""
    scales = spark.createDataFrame([(i + 1, 0.5 * f) for i, f in enumerate((2, 4, 2, 1, 2, *[1] * 11))], "channel int, scale double")
    cells = _cells(spark, sf_dir).withColumn("channel", (F.col("event_id") % 16 + 1).cast("int")).join(F.broadcast(scales), "channel")  # 16 rows
    at = lambda x: F.floor(F.col(x) * F.col("scale")).alias(x)
    return cells.groupBy("channel", at("r"), at("c")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT c_custkey // 40 AS r, c_custkey % 40 AS c, c_acctbal AS v FROM customer) SELECT 'up' AS way, r * 2 + i AS r, c * 2 + j AS c, v FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)
  UNION ALL SELECT 'down', r // 4, c // 4, v FROM p WHERE r % 4 = 0 AND c % 4 = 0""")
def resample_up_and_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as fine by repeating cells, four times as coarse by every fourth."""
    p = table(spark, sf_dir, "customer").select(F.expr("c_custkey DIV 40").alias("r"), (F.col("c_custkey") % 40).alias("c"), F.col("c_acctbal").alias("v"))
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    up = p.withColumn("i", two).withColumn("j", two).select(F.lit("up").alias("way"), (F.col("r") * 2 + F.col("i")).alias("r"), (F.col("c") * 2 + F.col("j")).alias("c"), "v")
    return up.unionByName(p.filter("r % 4 = 0 AND c % 4 = 0").select(F.lit("down").alias("way"), F.expr("r DIV 4").alias("r"), F.expr("c DIV 4").alias("c"), "v"))


@query(f"""WITH p AS (SELECT event_id, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE + 180 AS lon FROM events), q AS (SELECT *, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS n FROM p)
  SELECT event_id, round(n, 6) AS lon_norm, CASE WHEN n BETWEEN -147.4 AND -2.6022 AND lat BETWEEN -45.64 AND 45.64 THEN 'east' WHEN lon BETWEEN 150.425 AND 295.5748 AND lat BETWEEN -43.6826 AND 43.6826 THEN 'west' WHEN n BETWEEN -147.4 AND -2.6022 THEN 'east' WHEN lon BETWEEN 150.425 AND 295.5748 THEN 'west' ELSE 'None' END AS satellite,
  (n BETWEEN -147.4 AND -2.6022 AND lat BETWEEN -45.64 AND 45.64) OR (lon BETWEEN 150.425 AND 295.5748 AND lat BETWEEN -43.6826 AND 43.6826) AS inside FROM q""")
def satellite_by_two_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", F.expr(LAT).cast("double").alias("lat"), (F.expr(LON).cast("double") + 180).alias("lon"))
    satellite, inside, norm = scaling.satellite_of(F.col("lat"), F.col("lon"))
    return p.select("event_id", r6(norm).alias("lon_norm"), satellite.alias("satellite"), inside.alias("inside"))


@query(f"""WITH b AS (SELECT n_nationkey, n_nationkey * 9 % 200 AS br, n_nationkey * 17 % 200 AS bc FROM nation)
  SELECT n_nationkey, CASE WHEN br < 20 OR bc < 20 OR br + 20 > 200 OR bc + 20 > 200 THEN 0.0 ELSE round(coalesce(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0), 6) END AS fraction FROM b LEFT JOIN ({CELLS}) x ON x.r BETWEEN br - 20 AND br + 19 AND x.c BETWEEN bc - 20 AND bc + 19 GROUP BY n_nationkey, br, bc""")
def valid_fraction_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of valid cells in a box around each centre; 0 where the grid's edge clips it."""
    b = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 9 % 200).alias("br"), (F.col("n_nationkey") * 17 % 200).alias("bc"))
    whole = b.filter("br >= 20 AND bc >= 20 AND br + 20 <= 200 AND bc + 20 <= 200")
    boxes = whole.select("n_nationkey", (F.col("br") - 20).alias("lat_lo"), (F.col("br") + 19).alias("lat_hi"), (F.col("bc") - 20).alias("lon_lo"), (F.col("bc") + 19).alias("lon_hi"))
    points = _cells(spark, sf_dir).select(F.col("r").alias("lat"), F.col("c").alias("lon"), "value")
    found = spatial.in_boxes_2d(boxes, points, 40).groupBy("n_nationkey").agg(F.avg((F.col("value") > 50).cast("double")).alias("f"))
    return b.join(found, "n_nationkey", "left").select("n_nationkey", r6(F.coalesce("f", F.lit(0.0))).alias("fraction"))


@query(f"""WITH b AS (SELECT n_nationkey, n_nationkey * 5 - 70 AS lat_lo, n_nationkey * 5 - 61 AS lat_hi, n_nationkey * 12 - 150 AS lon_lo, n_nationkey * 12 - 131 AS lon_hi FROM nation),
  p AS (SELECT event_id, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon FROM events) SELECT n_nationkey, count(*) AS n, list(event_id ORDER BY event_id DESC)::VARCHAR AS inside FROM b JOIN p ON lat BETWEEN lat_lo AND lat_hi AND lon BETWEEN lon_lo AND lon_hi GROUP BY 1""")
def box_range_join_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points inside each box, last first; boxes without any are left out."""
    key = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select("n_nationkey", (key * 5 - 70).alias("lat_lo"), (key * 5 - 61).alias("lat_hi"), (key * 12 - 150).alias("lon_lo"), (key * 12 - 131).alias("lon_hi"))
    p = table(spark, sf_dir, "events").select("event_id", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    inside = F.concat(F.lit("["), F.array_join(F.reverse(F.array_sort(F.collect_list("event_id"))).cast("array<string>"), ", "), F.lit("]"))
    return spatial.in_boxes_2d(b, p, 20).groupBy("n_nationkey").agg(F.count("*").alias("n"), inside.alias("inside"))


@query(f"""SELECT event_id, least(greatest(ceil((lat + 90) / 0.5 - 0.5), 0), 360)::INTEGER AS i, (((ceil((lon + 180) / 0.625 - 0.5)::INTEGER % 576) + 576) % 576)::INTEGER AS j FROM (SELECT event_id, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon FROM events)""")
def nearest_on_regular_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes end, longitudes go round the earth; the lower point wins ties."""
    lat, lon = F.expr(LAT).cast("double"), F.expr(LON).cast("double")
    return table(spark, sf_dir, "events").select("event_id", spatial.regular_axis_index(lat, -90.0, 0.5, 361).alias("i"), spatial.regular_axis_index(lon, -180.0, 0.625, 576, wraps=True).alias("j"))


TRUTH = "SELECT c_custkey // 40 AS r, c_custkey % 40 AS c, max((c_custkey % 7)::INTEGER - 1) AS kind, max(c_acctbal) AS height FROM customer GROUP BY 1, 2"


@query(f"""WITH t AS ({TRUTH}), e AS (SELECT user_id, event_id, event_id * 3 % 45 AS r, event_id * 7 % 45 AS c FROM events), m AS (SELECT user_id, event_id, coalesce(CASE WHEN kind >= 0 THEN kind END, -9) AS kind, CASE WHEN kind > 0 THEN height END AS height FROM e LEFT JOIN t USING (r, c)),
  k AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, kind) AS nth FROM m WHERE kind > 0 GROUP BY 1, 2)
  SELECT user_id, count(*) AS n, count(*) FILTER (m.kind = -9) AS filled, round(coalesce(median(height), 0), 6) AS median_height, coalesce(any_value(k.kind), 0)::INTEGER AS mode_kind FROM m LEFT JOIN k USING (user_id) WHERE k.nth = 1 OR k.nth IS NULL GROUP BY 1""")
def truth_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth at mapped indices with a fill where there is none; by frame the median and the mode of what counts.

    Classes above 0 count; of equally frequent ones the smallest is the mode, and frames without any have 0.
    """
    truth = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey DIV 40").alias("r"), (F.col("c_custkey") % 40).alias("c")).agg(F.max((F.col("c_custkey") % 7).cast("int") - 1).alias("kind"), F.max("c_acctbal").alias("height"))
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 3 % 45).alias("r"), (F.col("event_id") * 7 % 45).alias("c"))
    at_cells = tiles.gathered(e, tiles.packed(truth, ["kind", "height"]), ["kind", "height"])
    kind = F.coalesce(F.when(F.col("kind") >= 0, F.col("kind")), F.lit(-9))
    m = at_cells.select("user_id", kind.alias("kind"), F.when(F.col("kind") > 0, F.col("height")).alias("height"))
    return m.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == -9).alias("filled"), r6(F.coalesce(F.median("height"), F.lit(0.0))).alias("median_height"),
        F.coalesce(F.mode(F.when(F.col("kind") > 0, F.col("kind")), True), F.lit(0)).alias("mode_kind"),
    )


@query(f"""WITH x AS ({CELLS}), b AS (SELECT user_id, min(r) AS r0, min(c) AS c0 FROM x GROUP BY 1), g AS (SELECT r, c, max(value) AS v FROM x WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT x.user_id, x.event_id, x.r - r0 AS i, x.c - c0 AS j, g.v FROM x JOIN b USING (user_id) JOIN g ON g.r = x.r AND g.c = x.c""")
def raster_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at scattered cells, with their places in the smallest box that holds a group's cells."""
    x = _cells(spark, sf_dir)
    corner = x.groupBy("user_id").agg(F.min("r").alias("r0"), F.min("c").alias("c0"))
    g = x.filter("event_type = 'click'").groupBy("r", "c").agg(F.max("value").alias("v"))
    met = tiles.gathered(x.select("user_id", "event_id", "r", "c"), tiles.packed(g, ["v"]), ["v"]).filter("v IS NOT NULL")
    return met.join(corner, "user_id").select("user_id", "event_id", (F.col("r") - F.col("r0")).alias("i"), (F.col("c") - F.col("c0")).alias("j"), "v")


@query(f"SELECT user_id, count(DISTINCT r * 200 + c) FILTER (value > 50) AS labels, min(r * 200 + c) FILTER (value > 50) AS least FROM ({CELLS}) GROUP BY 1")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("value") > 50, F.col("r") * 200 + F.col("c"))
    return _cells(spark, sf_dir).groupBy("user_id").agg(F.count_distinct(label).alias("labels"), F.min(label).alias("least"))


PROFILES = "SELECT l_orderkey, (l_orderkey % 5 - 1)::INTEGER AS n, list({'ord': l_linenumber * 1000000 + l_partkey, 'base': l_discount * 100 - 2, 'top': l_discount * 100 - 2 + l_quantity / 5, 'kind': (l_suppkey % 8 + 1)::INTEGER} ORDER BY l_linenumber * 1000000 + l_partkey, l_suppkey, l_quantity, l_discount) AS layers FROM lineitem GROUP BY 1, 2"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_discount") * 100 - 2
    layer = F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), "l_suppkey", "l_quantity", "l_discount", base.alias("base"), (base + F.col("l_quantity") / 5).alias("top"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("kind"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_orderkey") % 5 - 1).cast("int").alias("n")).agg(F.sort_array(F.collect_list(layer)).alias("layers"))


@query(f"""WITH p AS ({PROFILES}), b AS (SELECT l_orderkey, n, bin, list_filter(list_transform(list_filter(layers[1:greatest(n, 0)], lambda x: x.base >= 0), lambda x, i: {{'i': i, 'a': floor(x.base / 0.5), 'z': floor(x.top / 0.5), 'k': x.kind}}), lambda x: x.a <= bin AND bin <= x.z) AS hit FROM p, generate_series(0, 39) g(bin))
  SELECT l_orderkey, bin::INTEGER AS bin, k::INTEGER AS kind, CASE WHEN k < 0 THEN -1 WHEN k = 0 THEN 0 ELSE 1 END::INTEGER AS cloudy, k >= 0 AS valid FROM (SELECT *, CASE WHEN n < 0 THEN -1 WHEN len(hit) = 0 THEN 0 ELSE hit[-1].k END AS k FROM b)""")
def layer_mask_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, binary mask and validity of each bin: -1 missing, 0 clear, else the class."""
    mask = _profiles(spark, sf_dir).select("l_orderkey", F.posexplode(arrays.layer_mask(F.col("layers"), F.col("n"), 40, 0.5)).alias("bin", "kind"))
    return mask.select("l_orderkey", "bin", "kind", arrays.binary_mask(F.col("kind")).alias("cloudy"), (F.col("kind") >= 0).alias("valid"))


@query(f"""WITH p AS ({PROFILES}), q AS (SELECT l_orderkey, layers[1:coalesce(list_position(list_transform(layers, lambda x: x.base < 0), true), len(layers) + 1) - 1] AS layers FROM p),
  b AS (SELECT l_orderkey, bin, list_filter(list_transform(layers, lambda x: {{'a': floor(x.base / 0.5), 'z': floor(x.top / 0.5), 'k': x.kind}}), lambda x: x.a <= bin AND bin <= x.z) AS hit FROM q, generate_series(0, 39) g(bin))
  SELECT l_orderkey, bin::INTEGER AS bin, hit[-1].k::INTEGER AS kind FROM b WHERE len(hit) > 0""")
def legacy_layer_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule: layers end at the first without a base, and what is missing is clear."""
    mask = _profiles(spark, sf_dir).select("l_orderkey", F.posexplode(arrays.layer_mask(F.col("layers"), F.col("n"), 40, 0.5, clip=False)).alias("bin", "kind"))
    return mask.filter("kind <> 0")


@query("""WITH p AS (SELECT o_custkey, (epoch(o_orderdate) / 86400)::DOUBLE AS day, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), g AS (SELECT unnest([9200.0, 9900.0])::DOUBLE AS z),
  s AS (SELECT o_custkey, g.z, max(CASE WHEN p.day <= g.z THEN p.day END) AS x0, arg_max(y, CASE WHEN p.day <= g.z THEN p.day END) AS y0, min(CASE WHEN p.day >= g.z THEN p.day END) AS x1, arg_min(y, CASE WHEN p.day >= g.z THEN p.day END) AS y1 FROM p, g GROUP BY 1, 2)
  SELECT o_custkey, z AS day, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (z - x0) / (x1 - x0) END, 4) AS price FROM s""")
def legacy_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule: one point is enough, and holds everywhere."""
    points = table(spark, sf_dir, "orders").select("o_custkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400).alias("day"), F.col("o_totalprice").alias("price"))
    return arrays.interpolate(points, ["o_custkey"], "day", "price", [9200.0, 9900.0], least=1).withColumn("price", F.round("price", 4))


@query(f"SELECT r - 20 AS i, c - 30 AS j, event_id FROM ({CELLS}) WHERE r >= 20 AND r < 60 AND c >= 30 AND c < 70")
def crop_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).filter("r >= 20 AND r < 60 AND c >= 30 AND c < 70").select((F.col("r") - 20).alias("i"), (F.col("c") - 30).alias("j"), "event_id")


@query(f"SELECT vec_id, (i % 4 * 16 + i // 16 * 4 + i // 4 % 4)::INTEGER AS place, round(x, 6) AS x FROM {LONG}")
def permuted_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 4 x 4 x 4 with the last axis first."""
    turned = arrays.permuted(arrays.checked(F.col("embedding"), 64, "embedding"), (4, 4, 4), (2, 0, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(turned).alias("place", "x")).withColumn("x", r6(F.col("x").cast("double")))


@query(f"SELECT vec_id, i // 32 * 2 + i % 8 // 4 AS patch, i // 8 % 4 * 4 + i % 4 AS place, i // 8 AS r, i % 8 AS c, round(x, 6) AS x FROM {LONG}")
def patches_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 8 x 8 rasters by patches of 4 x 4, and where each came from, from its patch and place alone."""
    cells = _long(spark, sf_dir).select("vec_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).cast("long").alias("c"), r6("x").alias("x"))
    cut = arrays.patches(cells, "r", "c", 4, 8).select("vec_id", "patch", "place", "x")
    row, col = arrays.unpatched(F.col("patch"), F.col("place"), 4, 8)
    return cut.select("vec_id", "patch", "place", row.alias("r"), col.alias("c"), "x")


@query("""WITH k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY (vec_id * 64 + i) * 2654435761 % 4294967296, i) > 16 AS masked FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i FROM embeddings)),
  p AS (SELECT vec_id, t::INTEGER AS t, i // 8 * 4 + y AS r, i % 8 * 4 + x AS c, masked::INTEGER AS masked FROM k, generate_series(0, 1) a(t), generate_series(0, 3) b(y), generate_series(0, 3) d(x))
  SELECT vec_id, t, r, string_agg(masked::VARCHAR, '' ORDER BY c) AS pixels FROM p GROUP BY 1, 2, 3""")
def token_mask_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask of 8 x 8 tokens a sample, the same at all times, spread over the tokens' pixels; a row of pixels as text."""
    tokens = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    noise = F.struct(F.pmod((F.col("vec_id") * 64 + F.col("i")) * 2654435761, F.lit(4294967296)), "i")
    mask = arrays.rank_mask(tokens, ["vec_id"], noise, 0.75)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pixels = mask.withColumn("t", each(2)).withColumn("y", each(4)).withColumn("x", each(4))
    row, col = arrays.unpatched(F.col("i"), F.col("y") * 4 + F.col("x"), 4, 32)
    pixels = pixels.select("vec_id", "t", row.alias("r"), F.struct(col.alias("c"), "masked").alias("p"))
    return pixels.groupBy("vec_id", "t", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["masked"].cast("string")), "").alias("pixels"))


@query("""WITH t AS (SELECT user_id, event_type AS grp, event_id FROM events), n AS (SELECT *, event_id * 2654435761 % 4294967296 AS noise FROM t)
  SELECT user_id, grp, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY noise, event_id) > floor(count(*) OVER (PARTITION BY user_id) * 0.25))::INTEGER AS shared, (row_number() OVER (PARTITION BY user_id, grp ORDER BY noise, event_id) > floor(count(*) OVER (PARTITION BY user_id, grp) * 0.25))::INTEGER AS own FROM n""")
def masks_shared_and_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask over all of a sample, and independent ones by group."""
    t = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("grp"), "event_id")
    noise = F.struct(F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296)), "event_id")
    shared = arrays.rank_mask(t, ["user_id"], noise, 0.75).withColumnRenamed("masked", "shared")
    return arrays.rank_mask(shared, ["user_id", "grp"], noise, 0.75).withColumnRenamed("masked", "own")


@query(f"SELECT vec_id, i // 16 AS step, i % 16 AS channel, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM {LONG} WINDOW w AS (PARTITION BY vec_id, i % 16))")
def tile_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's channels to [0, 1] by their own extremes; constant ones to 0."""
    by = Window.partitionBy("vec_id", "channel")
    x = _long(spark, sf_dir).withColumn("channel", F.col("i") % 16)
    scaled = x.withColumn("scaled", r6(scaling.min_max(F.col("x"), F.min("x").over(by), F.max("x").over(by))))
    return scaled.select("vec_id", F.expr("i DIV 16").cast("int").alias("step"), "channel", "scaled")


@query(f"SELECT i AS dim, min(v) AS low, max(v) AS high, count(v) AS n FROM (SELECT i, CASE WHEN (vec_id + i) % 5 <> 0 THEN round(x, 6) END AS v FROM {LONG}) GROUP BY 1")
def extremes_without_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By channel, NaN left out; maxima of negative values stay negative."""
    v = F.when((F.col("vec_id") + F.col("i")) % 5 == 0, float("nan")).otherwise(r6("x"))
    x = _long(spark, sf_dir).select(F.col("i").alias("dim"), v.alias("v"))
    return x.groupBy("dim").agg(F.min(metrics.finite("v")).alias("low"), F.max(metrics.finite("v")).alias("high"), F.count(metrics.finite("v")).alias("n"))


@query("SELECT vec_id, i AS place, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT vec_id, unnest(generate_series(0, 31))::INTEGER AS i, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned arrays place by place; lengths that differ raise."""
    both = arrays.zipped(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), ("a", "b"))
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("place", "z"))
    return x.select("vec_id", "place", r6(F.col("z.a").cast("double")).alias("a"), r6(F.col("z.b").cast("double")).alias("b"))


@query("SELECT vec_id, 66 AS n, round(embedding[1]::DOUBLE, 6) AS first, vec_id % 10 AS added, label AS last FROM embeddings")
def concat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array((F.col("vec_id") % 10).cast("double"), F.col("label").cast("double")))
    x = table(spark, sf_dir, "embeddings").select("vec_id", both.alias("f"))
    return x.select("vec_id", F.size("f").alias("n"), r6(F.get("f", F.lit(0))).alias("first"), F.get("f", F.lit(64)).cast("long").alias("added"), F.get("f", F.lit(65)).cast("int").alias("last"))


@query("SELECT user_id, t::INTEGER AS t, n_name FROM (SELECT DISTINCT user_id FROM events), generate_series(0, 6) g(t), nation WHERE n_nationkey = user_id % 25")
def broadcast_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static field beside each of seven time steps."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    return users.join(table(spark, sf_dir, "nation"), "n_nationkey").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"), "n_name")


@query("""SELECT vec_id, [CASE WHEN x = 0 THEN 255 ELSE x END FOR x IN l[7:58]]::VARCHAR AS cut, len(l) AS n FROM (SELECT vec_id, [((vec_id + i) % 5)::INTEGER FOR i IN generate_series(0, 63)] AS l FROM embeddings)""")
def crop_and_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 52 labels, with 0 as the label to ignore."""
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("vec_id") + i) % 5).cast("int"))
    cut = F.transform(arrays.centred(labels, 52, F.lit(255)), lambda x: F.when(x == 0, 255).otherwise(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(cut.cast("array<string>"), ", "), F.lit("]")).alias("cut"), F.size(labels).cast("long").alias("n"))


@query(f"SELECT vec_id, i % 16 AS token, round(avg(x), 6) AS mean FROM {LONG} GROUP BY 1, 2")
def token_mean_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).groupBy("vec_id", (F.col("i") % 16).alias("token")).agg(r6(F.avg("x")).alias("mean"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, arg_min(n_name, CASE WHEN n_nationkey % 5 = 2 THEN n_nationkey END) AS second, count(*) + 1 AS entries FROM nation GROUP BY 1")
def map_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to names as a map: looked up, merged with another, and listed in order."""
    entry = F.struct((F.col("n_nationkey") % 5 + F.col("n_nationkey") * 10).alias("k"), F.col("n_name").alias("v"))
    m = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    merged = F.map_concat("m", F.create_map(F.lit(-1), F.lit("none")))
    second = F.get(F.filter(F.map_keys("m"), lambda k: k % 10 == 2), F.lit(0))
    return m.select("n_regionkey", F.array_join(F.map_values("m"), ",").alias("names"), F.try_element_at("m", second).alias("second"), F.size(merged).cast("long").alias("entries"))


def _scaled(x: Column) -> list[Column]:
    z = scaling.z_score(x, F.lit(25.0), F.lit(14.0))
    e = scaling.min_max(x, F.lit(5.0), F.lit(45.0))
    return [r6(z).alias("z"), r6(scaling.z_inverse(z, F.lit(25.0), F.lit(14.0))).alias("z_back"), r6(e).alias("emissive"), r6(scaling.min_max_inverse(e, F.lit(5.0), F.lit(45.0))).alias("emissive_back"), r6(scaling.min_max_eps(x, F.lit(1.0), F.lit(50.0))).alias("eps"),
            r6(F.log1p(x)).alias("logged"), r6(F.greatest(F.expm1(F.log1p(x) - 3.5), F.lit(0.0))).alias("grown"), r6(scaling.sigmoid(x / 10 - 2.5)).alias("chance"), scaling.sigmoid(x / 10 - 2.5) >= 0.5, r6(scaling.elevation(x * 100)).alias("metres")]


@query("""SELECT x AS quantity, round((x - 25) / 14, 6) AS z, round(x, 6) AS z_back, round(least(1, greatest(0, (x - 5) / 40)), 6) AS emissive, round(least(1, greatest(0, (x - 5) / 40)) * 40 + 5, 6) AS emissive_back, round(least(1, greatest(0, (x - 1) / (49 + 1e-8))), 6) AS eps, round(ln(1 + x), 6) AS logged,
  round(greatest(exp(ln(1 + x) - 3.5) - 1, 0), 6) AS grown, round(1 / (1 + exp(2.5 - x / 10)), 6) AS chance, 1 / (1 + exp(2.5 - x / 10)) >= 0.5 AS flag, round(x * 100 / 9.80665, 6) AS metres, n FROM (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1)""")
def scalings_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score and its way back, emissive scale and back, min-max with an epsilon, logs, sigmoid with a flag, heights."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("quantity")).agg(F.count("*").alias("n"))
    columns = _scaled(F.col("quantity"))
    return q.select("quantity", *columns[:8], columns[8].alias("flag"), columns[9], "n")


@query(f"""SELECT event_id, level, CASE WHEN level >= abs(cos(lat / 1.5)) * 20 THEN 1 WHEN level >= abs(cos(lat / 1.5)) * 14 THEN 2 WHEN level >= 5 THEN 3 ELSE 4 END AS tier FROM (SELECT event_id, (event_id % 40)::INTEGER AS level, ({LAT})::DOUBLE AS lat FROM events)""")
def latitude_level_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of a height level by thresholds that depend on latitude, which goes into the cosine as it is, in degrees."""
    level, k = (F.col("event_id") % 40).cast("int"), F.abs(F.cos(F.expr(LAT).cast("double") / 1.5))
    tier = F.when(level >= k * 20, 1).when(level >= k * 14, 2).when(level >= 5, 3).otherwise(4)
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"), tier.alias("tier"))


CHIPS = "SELECT vec_id, (vec_id % 4)::INTEGER AS kind, [[2, 4, 2, 4], [4, 2, 2, 4], [2, 8, 2, 2], [2, 2, 2, 8]][vec_id % 4 + 1] AS s, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"""SELECT vec_id, t * 4 + k AS t_channel, r, c, round(CASE WHEN kind IN (0, 2) THEN e[1 + ((t * s[2] + k) * s[3] + r) * s[4] + c] ELSE e[1 + ((t * s[2] + r) * s[3] + c) * s[4] + k] END, 6) AS x
  FROM (SELECT *, CASE WHEN kind IN (0, 2) THEN s[3] ELSE s[2] END AS rows, CASE WHEN kind IN (0, 2) THEN s[4] ELSE s[3] END AS cols FROM ({CHIPS})), generate_series(0, 3) a(t), generate_series(0, 3) b(k), generate_series(0, 3) d(r), generate_series(0, 3) f(c) WHERE t < s[1] AND r < rows AND c < cols""")
def chip_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips whose shape tells where the four channels are: second, last, first four of eight in either place; all with channels second."""
    shapes = F.array(*[F.array(*[F.lit(n) for n in s]) for s in ((2, 4, 2, 4), (4, 2, 2, 4), (2, 8, 2, 2), (2, 2, 2, 8))])
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.get(shapes, (F.col("vec_id") % 4).cast("int")).alias("s"))
    second = (F.col("vec_id") % 2 == 0)
    wide = F.when(second, F.get("s", F.lit(3))).otherwise(F.get("s", F.lit(2)))
    area = wide * F.when(second, F.get("s", F.lit(2))).otherwise(F.get("s", F.lit(1)))
    flat = e.select("vec_id", wide.alias("wide"), area.alias("area"), F.posexplode(arrays.channels_first(F.col("e"), F.col("s"), 4)).alias("i", "x"))
    at = lambda x: F.floor(x).cast("long")
    return flat.select("vec_id", at(F.col("i") / F.col("area")).alias("t_channel"), at(F.col("i") % F.col("area") / F.col("wide")).alias("r"), (F.col("i") % F.col("wide")).cast("long").alias("c"), r6("x").alias("x"))


@query("SELECT l_linenumber, round(min(k), 4) AS low, round(max(k), 4) AS high, count(k) AS n FROM (SELECT l_linenumber, CASE WHEN l_suppkey % 7 <> 0 THEN (1392.74 / ln(10803.3 / greatest(l_quantity, 1e-6) + 1) - 0.0755) / 0.99975 END AS k FROM lineitem) GROUP BY 1")
def calibrated_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest brightness temperature of a channel; readings of some sources are NaN and left out after calibration."""
    radiance = F.when(F.col("l_suppkey") % 7 == 0, float("nan")).otherwise(F.col("l_quantity"))
    k = F.when(~F.isnan(radiance), scaling.brightness_temperature(radiance, 10803.3, 1392.74, 0.0755, 0.99975))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.min(k), 4).alias("low"), F.round(F.max(k), 4).alias("high"), F.count(k).alias("n"))
