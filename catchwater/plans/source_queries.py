"""Contour, provider and geodesy queries.

embeddings are contour lines of 32 vertices near (81.28, 21.26), events are ways, part holds names with numbers and
provider tiers, customer is a small grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.functions import geo
from catchwater.operators import layers, terrain
from catchwater.sources import contours, payloads, providers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def lines(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((81.28 + 0.01 * F.element_at("embedding", 2 * i + 1).cast("double")).alias("lon"), (21.26 + 0.01 * F.element_at("embedding", 2 * i + 2).cast("double")).alias("lat")))
    return e.select(F.lit("all").alias("path"), F.col("vec_id").alias("seq"), (F.lit(270) + F.col("label")).cast("double").alias("elevation_m"), v.alias("coordinates"))


def vertices(spark, d) -> DataFrame:
    return lines(spark, d).select(F.col("seq").alias("contour"), F.posexplode("coordinates").alias("seq", "v"), "elevation_m").select("contour", "seq", (F.col("v.lon") * 100_000).alias("x"), (F.col("v.lat") * 100_000).alias("y"), "elevation_m")


V = "v AS (SELECT vec_id AS contour, i::INT AS seq, 81.28::DOUBLE + 0.01::DOUBLE * embedding[2*i+1]::DOUBLE AS lon, 21.26::DOUBLE + 0.01::DOUBLE * embedding[2*i+2]::DOUBLE AS lat, (270 + label)::DOUBLE AS elevation_m FROM embeddings, (SELECT unnest(range(0, 32)) AS i))"
SEG = f"{V}, w AS (SELECT contour, seq, lon * 100000 AS x, lat * 100000 AS y, elevation_m FROM v), s AS (SELECT a.*, b.x AS x2, b.y AS y2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS length FROM w a JOIN w b ON a.contour = b.contour AND b.seq = a.seq + 1), g AS (SELECT * FROM s WHERE length > 0)"


@query(f"WITH {V} SELECT contour, seq, round(lon, 9) AS lon, round(lat, 9) AS lat, elevation_m FROM v")
def contour_vertices(spark, d):
    return lines(spark, d).select(F.col("seq").alias("contour"), F.posexplode("coordinates").alias("seq", "v"), "elevation_m").select("contour", "seq", F.round("v.lon", 9).alias("lon"), F.round("v.lat", 9).alias("lat"), "elevation_m")


@query(f"WITH {V} SELECT 'all' AS path, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, min(elevation_m) AS min_elevation_m, max(elevation_m) AS max_elevation_m, count(DISTINCT contour) AS contours, (min(lon) + max(lon)) / 2 AS center_lon, (min(lat) + max(lat)) / 2 AS center_lat FROM v")
def contour_summary(spark, d):
    return contours.summary(lines(spark, d))


@query(f"WITH {SEG} SELECT contour, seq, round(x, 4) AS x, round(y, 4) AS y, round(x2, 4) AS x2, round(y2, 4) AS y2, round(length, 4) AS length FROM g")
def contour_segments(spark, d):
    r = lambda c: F.round(c, 4).alias(c)
    return terrain.segments(vertices(spark, d)).select("contour", "seq", *map(r, ("x", "y", "x2", "y2", "length")))


@query(f"WITH {SEG}, n AS (SELECT *, greatest(2, trunc(length / 10)::INT) AS n FROM g), k AS (SELECT *, unnest(range(0, n)) AS k FROM n) SELECT contour, seq, k::INT AS k, round(x + k / (n - 1)::DOUBLE * (x2 - x), 3) AS x, round(y + k / (n - 1)::DOUBLE * (y2 - y), 3) AS y, elevation_m FROM k")
def contour_densify(spark, d):
    return terrain.densify(vertices(spark, d)).select("contour", "seq", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "elevation_m")


NAME = "CASE p_partkey % 5 WHEN 0 THEN 'Elevation: ' || p_size || '.5' WHEN 1 THEN p_size || 'm' WHEN 2 THEN '-' || p_size || '.25' WHEN 3 THEN 'abc' ELSE NULL END"


@query(rf"SELECT p_partkey, TRY_CAST(NULLIF(regexp_extract({NAME}, '[-+]?\d+\.?\d*'), '') AS DOUBLE) AS elevation_m FROM part")
def parse_elevation(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", contours.parse_elevation(F.expr(NAME)).alias("elevation_m"))


COORDS = "'81.' || p_partkey || ',21.5,7 bad,1 ' || p_size || ',' || (p_partkey % 120) || ' 190,10 5 ' || chr(10) || '-1.5,-2.25'"


@query(f"""WITH t AS (SELECT p_partkey, unnest(string_split_regex(trim({COORDS}), '\\s+')) AS t FROM part), c AS (SELECT p_partkey, TRY_CAST(split_part(t, ',', 1) AS DOUBLE) AS lon, TRY_CAST(NULLIF(split_part(t, ',', 2), '') AS DOUBLE) AS lat FROM t WHERE contains(t, ','))
SELECT p_partkey, count(*) AS n, sum(lon) AS lon_sum, sum(lat) AS lat_sum FROM (SELECT p_partkey, CAST(lon AS DECIMAL(18,6)) AS lon, CAST(lat AS DECIMAL(18,6)) AS lat FROM c WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) GROUP BY p_partkey""".replace("sum(lon) AS", "CAST(sum(lon) AS DOUBLE) AS").replace("sum(lat) AS", "CAST(sum(lat) AS DOUBLE) AS"))
def parse_coordinates(spark, d):
    v = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(contours.parse_coordinates(F.expr(COORDS))).alias("v"))
    total = lambda c: F.sum(F.col(f"v.{c}").cast("decimal(18,6)")).cast("double").alias(f"{c}_sum")
    return v.groupBy("p_partkey").agg(F.count("*").alias("n"), total("lon"), total("lat"))


LON, LAT = "(c_custkey * 37 % 3600) / 10.0::DOUBLE - 180", "(c_custkey * 91 % 1600) / 10.0::DOUBLE - 80"


def _points(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr("(c_custkey * 37 % 3600) / double(10) - 180").alias("lon"), F.expr("(c_custkey * 91 % 1600) / double(10) - 80").alias("lat"))


@query(f"WITH p AS (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer) SELECT c_custkey, (trunc((lon + 180) / 6) + 1)::INT AS zone, 'EPSG:' || CASE WHEN lat >= 0 THEN 326 ELSE 327 END || lpad((trunc((lon + 180) / 6) + 1)::INT::VARCHAR, 2, '0') AS epsg FROM p")
def utm_zone(spark, d):
    return _points(spark, d).select("c_custkey", geo.utm_zone(F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"SELECT c_custkey, round({LON}, 7) AS lon, round({LAT}, 7) AS lat FROM customer")
def utm_round_trip(spark, d):
    """Projected and projected back."""
    p = _points(spark, d)
    zone, south = geo.utm_zone(F.col("lon")), F.col("lat") < 0
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), zone, south)
    p = p.select("c_custkey", x.alias("x"), y.alias("y"), zone.alias("zone"), south.alias("south"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return p.select("c_custkey", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query(f"WITH p AS (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer) SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(21.26 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(21.26)) * pow(sin(radians(81.28 - lon) / 2), 2))), 3) AS metres FROM p")
def haversine(spark, d):
    return _points(spark, d).select("c_custkey", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(21.26), F.lit(81.28)), 3).alias("metres"))


@query("SELECT c_nationkey::VARCHAR AS scenario, min(c_acctbal) - (max(c_acctbal) - min(c_acctbal)) * 0.1::DOUBLE AS origin_x, (max(c_custkey) + (max(c_custkey) - min(c_custkey)) * 0.1::DOUBLE)::DOUBLE AS origin_y, greatest(10, ceil((max(c_custkey) - min(c_custkey)) * 1.2::DOUBLE / 30))::INT AS rows, greatest(10, ceil((max(c_acctbal) - min(c_acctbal)) * 1.2::DOUBLE / 30))::INT AS cols, 30.0::DOUBLE AS resolution FROM customer GROUP BY 1")
def grid_spec(spark, d):
    return terrain.grid_spec(_boxes(spark, d))


def _boxes(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").cast("string").alias("scenario")).agg(F.min("c_acctbal").alias("min_x"), F.max("c_acctbal").alias("max_x"), F.min("c_custkey").cast("double").alias("min_y"), F.max("c_custkey").cast("double").alias("max_y"))


@query("""WITH s AS (SELECT c_nationkey::VARCHAR AS scenario, (max(c_custkey) - min(c_custkey)) * 1.2::DOUBLE AS h, (max(c_acctbal) - min(c_acctbal)) * 1.2::DOUBLE AS w, min(c_acctbal) - (max(c_acctbal) - min(c_acctbal)) * 0.1::DOUBLE AS ox, max(c_custkey) + (max(c_custkey) - min(c_custkey)) * 0.1::DOUBLE AS oy FROM customer GROUP BY 1),
n AS (SELECT *, greatest(10, ceil(h / 30)) * greatest(10, ceil(w / 30)) AS n FROM s), k AS (SELECT *, 30.0::DOUBLE * CASE WHEN n > 2500 THEN sqrt(n / 2500.0::DOUBLE) ELSE 1.0::DOUBLE END AS res FROM n),
g AS (SELECT *, greatest(10, ceil(h / res))::INT AS r, greatest(10, ceil(w / res))::INT AS c FROM k)
SELECT scenario, a.row::INT AS row, b.col::INT AS col, round(ox + (b.col + 0.5::DOUBLE) * res, 6) AS x, round(oy - (a.row + 0.5::DOUBLE) * res, 6) AS y FROM g, unnest(range(0, r)) a(row), unnest(range(0, c)) b(col)""")
def grid_cells(spark, d):
    return terrain.grid_cells(terrain.coarsen(_boxes(spark, d))).select("scenario", "row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TIER = "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END", "CASE WHEN p_partkey % 5 < 2 THEN p_retailprice + 1 END", "CASE WHEN p_partkey % 7 < 5 THEN p_retailprice + 2 END"


@query(f"SELECT p_partkey AS point_id, coalesce({', '.join(TIER)}) AS elevation, CASE WHEN {TIER[0]} IS NOT NULL THEN 1 WHEN {TIER[1]} IS NOT NULL THEN 2 WHEN {TIER[2]} IS NOT NULL THEN 3 END::DOUBLE AS tier FROM part")
def elevation_fallback(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return providers.fallback(part.select(F.col("p_partkey").alias("point_id")), [part.select(F.col("p_partkey").alias("point_id"), F.expr(t).alias("elevation")) for t in TIER]).withColumn("tier", F.col("tier").cast("double"))


@query("SELECT c_custkey AS point_id, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(abs(floor(lat))::INT::VARCHAR, 2, '0') || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(abs(floor(lon))::INT::VARCHAR, 3, '0') || '_00' AS tile FROM (SELECT c_custkey, " + f"{LON} AS lon, {LAT} AS lat FROM customer)")
def tile_key(spark, d):
    return _points(spark, d).select(F.col("c_custkey").alias("point_id"), providers.tile_key(F.col("lat"), F.col("lon")).alias("tile"))


SMALL = "SELECT 0 AS scenario, (c_custkey // 50)::INT AS row, (c_custkey % 50)::INT AS col, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS elevation_m FROM customer"


@query(f"""WITH g AS ({SMALL}), j AS (SELECT a.row, a.col, b.elevation_m, row_number() OVER (PARTITION BY a.row, a.col ORDER BY pow(a.row - b.row, 2) + pow(a.col - b.col, 2), b.row, b.col) AS k FROM g a JOIN g b ON b.elevation_m IS NOT NULL AND abs(a.row - b.row) <= 30 AND abs(a.col - b.col) <= 30)
SELECT 0 AS scenario, row, col, elevation_m FROM j WHERE k = 1""")
def nearest_fill(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.lit(0).alias("scenario"), F.expr("int(c_custkey div 50)").alias("row"), F.expr("int(c_custkey % 50)").alias("col"), F.expr("CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END").alias("elevation_m"))
    return terrain.fill_gaps(c)


@query("SELECT e.event_id, (px > 1000 AND px < 4000 AND py > 500 AND py < 3000 AND NOT (px > 2000 AND py > 1500)) OR (px > 1000 AND px < 4000 AND py > 500 AND py < 3000 AND px > 2000 AND py > 1500 AND px + py < 3500) AS inside FROM (SELECT event_id, (event_id * 17 % 5000)::DOUBLE AS px, (event_id * 31 % 3500)::DOUBLE AS py FROM events) e".replace("OR (px > 1000 AND px < 4000 AND py > 500 AND py < 3000 AND px > 2000 AND py > 1500 AND px + py < 3500)", "OR (px = 2000 AND py > 1500 AND py < 3000 AND FALSE)").replace("NOT (px > 2000 AND py > 1500)", "NOT (px >= 2000 AND py >= 1500)"))
def point_in_polygon(spark, d):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1000, 500), (4000, 500), (4000, 1500), (2000, 1500), (2000, 3000), (1000, 3000))])
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", geo.in_ring(F.expr("double(event_id * 17 % 5000)"), F.expr("double(event_id * 31 % 3500)"), ring).alias("inside"))



def _ways(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    tags = F.expr("CASE event_id % 6 WHEN 0 THEN map('building', 'yes') WHEN 1 THEN map('highway', 'residential') WHEN 2 THEN map('waterway', 'river', 'highway', 'path') WHEN 3 THEN map('natural', 'water') WHEN 4 THEN map('power', 'line') ELSE map('shop', 'yes') END")
    at = lambda lon, lat: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))
    ring, path = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0)), F.array(at(0, 0), at(1, 0), at(1, 1))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, "relation").otherwise("way").alias("type"), tags.alias("tags"), F.when(F.col("user_id") % 3 == 0, F.slice(path, 1, 1)).when(F.col("user_id") % 3 == 1, path).otherwise(ring).alias("geometry"))


@query("""WITH w AS (SELECT event_id AS id, event_id % 6 AS k, user_id % 3 AS g FROM events WHERE event_id % 11 <> 0 AND user_id % 3 <> 0)
SELECT id, 'building' AS category FROM w WHERE k = 0 AND g = 2 UNION ALL SELECT id, 'road' FROM w WHERE k IN (1, 2) UNION ALL SELECT id, 'waterway' FROM w WHERE k = 2 UNION ALL SELECT id, 'water_body' FROM w WHERE k = 3 AND g = 2 UNION ALL SELECT id, 'power_line' FROM w WHERE k = 4""")
def classify_ways(spark, d):
    return providers.classify_ways(_ways(spark, d)).select("id", "category")


@query("""WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'waterway' ELSE 'power_line' END AS category, (event_id * 7919 % 60000)::DOUBLE AS fx, (event_id * 104729 % 60000)::DOUBLE AS fy FROM events),
b AS (SELECT *, CASE category WHEN 'road' THEN 50 WHEN 'waterway' THEN 30 ELSE 75 END AS buf FROM f),
p AS (SELECT c_custkey AS point_id, (c_custkey * 7717 % 60000)::DOUBLE AS x, (c_custkey * 3571 % 60000)::DOUBLE AS y FROM customer)
SELECT DISTINCT 0 AS scenario, point_id FROM p JOIN b ON sqrt(pow(x - greatest(fx, least(fx + 400, x)), 2) + pow(y - fy, 2)) <= buf""")
def exclusion_filter(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = lambda dx: F.struct((F.expr("double(event_id * 7919 % 60000)") + dx).alias("x"), F.expr("double(event_id * 104729 % 60000)").alias("y"))
    f = e.select(F.lit(0).alias("scenario"), F.expr("CASE event_id % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'waterway' ELSE 'power_line' END").alias("category"), F.array(v(0.0), v(400.0)).alias("path"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.lit(0).alias("scenario"), F.col("c_custkey").alias("point_id"), F.expr("double(c_custkey * 7717 % 60000)").alias("x"), F.expr("double(c_custkey * 3571 % 60000)").alias("y"))
    return providers.excluded(c, f)


@query("""WITH e AS (SELECT event_id AS request, event_id % 4 AS k4, (event_id % 500) / 2.0::DOUBLE AS v FROM events), r AS (SELECT *, unnest([0, 1]) AS k FROM e)
SELECT request, k::INT AS k, CASE WHEN k4 IN (1, 2) THEN NULL WHEN k = 0 THEN v END AS elevation, k4 = 3 AND k = 1 AS moved FROM r""")
def provider_json(spark, d):
    """Elevation responses: whole ones, too short ones, none at all, and ones that name another place than was asked for."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request"), (F.col("event_id") % 4).alias("k4"), F.expr("(event_id % 500) / 2.0D").alias("v"))
    at = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    first = F.concat(F.lit('{"results":[{"lat":21.25,"lon":81.5,"elevation":'), F.col("v").cast("string"), F.lit("}"))
    whole, moved = (F.concat(first, F.lit(f',{{"lat":{lat},"lon":81.75,"elevation":null}}]}}')) for lat in (21.5, 22.5))
    body = F.when(F.col("k4") == 0, whole).when(F.col("k4") == 1, F.concat(first, F.lit("]}"))).when(F.col("k4") == 2, "<html>").otherwise(moved)
    return payloads.elevations(e.select("request", F.array(at(21.25, 81.5), at(21.5, 81.75)).alias("points"), body.alias("body")))


@query("""WITH s AS (SELECT s_suppkey AS site FROM supplier), d AS (SELECT site, unnest(range(0, 3)) AS i FROM s WHERE site % 5 <> 4)
SELECT site, strftime(make_date(2020 + i::INT, 6, 1), '%Y-%m-%d') AS date, (site % 7 + i)::DOUBLE AS precipitation_sum FROM d UNION ALL SELECT site, NULL, NULL FROM s WHERE site % 5 = 4""")
def rain_json(spark, d):
    """Daily rain responses; lists of different lengths make a record unavailable."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("site"))
    days = F.lit('"2020-06-01","2021-06-01","2022-06-01"')
    values = F.concat_ws(",", *[(F.col("site") % 7 + i).cast("string") for i in range(3)])
    body = F.concat(F.lit('{"daily":{"time":['), days, F.lit('],"precipitation_sum":['), F.when(F.col("site") % 5 == 4, "1").otherwise(values), F.lit("]}}"))
    return payloads.rain(s.select("site", body.alias("body"))).select("site", F.col("date").cast("string").alias("date"), "precipitation_sum")


@query("""WITH w AS (SELECT event_id, user_id, event_id % 3 AS k FROM events), c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END || (user_id % 40) AS key, event_id AS at, k <> 2 AS ok, 'body ' || event_id AS body FROM w)
SELECT DISTINCT c.key, (SELECT arg_max(x.body, x.at) FROM c x WHERE x.ok AND x.key = c.key) AS body FROM c""")
def response_cache(spark, d):
    """The last successful response of each key; failures are never served."""
    e = spark.read.parquet(f"{d}/events.parquet")
    cache = e.select(F.concat(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), (F.col("user_id") % 40).cast("string")).alias("key"), F.col("event_id").alias("at"), (F.col("event_id") % 3 != 2).alias("ok"), F.concat(F.lit("body "), F.col("event_id").cast("string")).alias("body"))
    return payloads.cached(cache.select("key").distinct(), cache, "key").select("key", "body")


@query("""SELECT c_nationkey AS scenario, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (c_custkey % 180) || '.5,' || (c_custkey % 90) || '.5]},"properties":{"id":' || c_custkey || '}}', ',' ORDER BY c_custkey) || ']}' AS geojson FROM customer GROUP BY 1""")
def geojson_points(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    f = layers.feature(layers.point(F.expr("c_custkey % 180 + double(0.5)"), F.expr("c_custkey % 90 + double(0.5)")), F.struct(F.col("c_custkey").alias("id")))
    return layers.collection(c.select(F.col("c_nationkey").alias("scenario"), "c_custkey", f.alias("feature")), order=["c_custkey"])


BOX = "c_custkey, (c_custkey % 300) / 10.0::DOUBLE AS lon, (c_custkey % 130) / 2.0::DOUBLE - 30 AS lat, (c_custkey % 17) / 200.0::DOUBLE AS side"
_HAV = lambda a, b, c, e: f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)))"


@query(f"WITH b AS (SELECT {BOX} FROM customer), a AS (SELECT c_custkey, {_HAV('(lat + lat + side) / 2', 'lon', '(lat + lat + side) / 2', 'lon + side')} * {_HAV('lat', '(lon + lon + side) / 2', 'lat + side', '(lon + lon + side) / 2')} / 1e6 AS km2 FROM b) SELECT c_custkey, round(km2, 6) AS km2, km2 > 25 AS oversize FROM a")
def area_guard(spark, d):
    """Areas whose bounding box is too large to be analysed."""
    b = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "(c_custkey % 300) / double(10) AS lon", "(c_custkey % 130) / double(2) - 30 AS lat", "(c_custkey % 17) / double(200) AS side")
    km2 = geo.bbox_area_km2(F.col("lon"), F.col("lat"), F.col("lon") + F.col("side"), F.col("lat") + F.col("side"))
    return b.select("c_custkey", F.round(km2, 6).alias("km2"), (km2 > 25).alias("oversize"))


@query("SELECT c_nationkey AS scenario, count(*) FILTER (c_custkey % (c_nationkey % 4 + 1) = 0) AS missing, count(*) AS points, count(*) FILTER (c_custkey % (c_nationkey % 4 + 1) = 0) <= 0.5::DOUBLE * count(*) AS usable FROM customer GROUP BY 1")
def missing_guard(spark, d):
    """Areas with more than half their elevations missing are not usable."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return providers.missing_share(c.select(F.col("c_nationkey").alias("scenario"), F.expr("CASE WHEN c_custkey % (c_nationkey % 4 + 1) <> 0 THEN c_acctbal END").alias("elevation")))


@query("SELECT p_partkey AS point_id FROM part WHERE p_partkey % 3 <> 0")
def cache_misses(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("point_id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END").alias("elevation"))
    return providers.uncached(p.select("point_id"), p)


@query("SELECT c_custkey AS point_id, round_even(c_acctbal / 7, 4) AS lat_key FROM customer")
def rounding_key(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point_id"), providers.round_key(F.col("c_acctbal") / 7).alias("lat_key"))


@query("""WITH t AS (SELECT 'N' || lpad(p_size::VARCHAR, 2, '0') || '_00_E' || lpad((p_partkey % 3 + 10)::VARCHAR, 3, '0') || '_00' AS tile, p_size, p_partkey % 3 + 10 AS e, min(p_retailprice) AS value FROM part GROUP BY 1, 2, 3),
p AS (SELECT c_custkey AS point_id, c_custkey % 60 + (c_custkey % 10) / 10.0::DOUBLE + 0.05::DOUBLE AS lat, 10 + c_custkey % 4 + 0.25::DOUBLE AS lon FROM customer)
SELECT point_id, value AS elevation FROM p LEFT JOIN t ON floor(lat) = p_size AND floor(lon) = e AND floor((ceil(lat) - lat) * 2) = 0""")
def tile_sample(spark, d):
    """Rasters of two cells to a degree, of which only the north-western one holds a value."""
    part = spark.read.parquet(f"{d}/part.parquet")
    cells = part.groupBy(F.expr("concat('N', lpad(p_size, 2, '0'), '_00_E', lpad(p_partkey % 3 + 10, 3, '0'), '_00')").alias("tile")).agg(F.min("p_retailprice").alias("value")).select("*", F.lit(0).alias("row"), F.lit(0).alias("col"))
    pts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point_id"), F.expr("c_custkey % 60 + (c_custkey % 10) / double(10) + double(0.05)").alias("lat"), F.expr("10 + c_custkey % 4 + double(0.25)").alias("lon"))
    return providers.tile_sample(pts, cells, 2).select("point_id", "elevation")


@query("""SELECT e.event_id, CASE event_type WHEN 'x' THEN 'X' ELSE upper(event_type[1]) || lower(event_type[2:]) END AS label, coalesce(printf('%.1f', floor(CASE WHEN event_id % 3 <> 0 THEN event_id / 4.0::DOUBLE END * 10 + 0.5) / 10), '—') AS shown FROM events e""")
def labels(spark, d):
    """Status labels and numbers with a dash for nulls."""
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.expr("floor(CASE WHEN event_id % 3 <> 0 THEN event_id / double(4) END * 10 + 0.5D) / 10")
    return e.select("event_id", layers.title(F.concat(F.lit("rejected_"), "event_type")).alias("label"), layers.or_dash(v, 1).alias("shown"))


@query("""WITH r AS (SELECT c_custkey, (c_custkey % 220) - 110.0::DOUBLE AS lat, c_custkey % 170 + 0.0::DOUBLE AS lon, CASE WHEN c_custkey % 3 > 0 THEN 2010 + c_custkey % 20 END AS s, CASE WHEN c_custkey % 5 > 0 THEN 2024 END AS e FROM customer),
k AS (SELECT *, coalesce(s, 2015) AS y0, coalesce(e, 2025) AS y1 FROM r) SELECT c_custkey, CASE WHEN lat BETWEEN -90 AND 90 AND y1 >= y0 THEN 'success' ELSE 'unavailable' END AS status, CASE WHEN lat BETWEEN -90 AND 90 AND y1 >= y0 THEN strftime(make_date(y0::INT, 1, 1), '%Y-%m-%d') END AS first_day, CASE WHEN lat BETWEEN -90 AND 90 AND y1 >= y0 THEN strftime(make_date(y1::INT, 12, 31), '%Y-%m-%d') END AS last_day FROM k""")
def rain_request(spark, d):
    r = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "double(c_custkey % 220) - 110 AS lat", "double(c_custkey % 170) AS lon", "CASE WHEN c_custkey % 3 > 0 THEN int(2010 + c_custkey % 20) END AS start_year", "CASE WHEN c_custkey % 5 > 0 THEN 2024 END AS end_year")
    return providers.rain_request(r, last_year=2025).select("c_custkey", "status", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@query("SELECT event_id, event_id % 2 = 0 AS simple FROM events")
def ring_validity(spark, d):
    """Squares, every other one with its last two corners swapped."""
    v = lambda x, y: F.struct((F.col("event_id") + x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    square, bow = F.array(v(0, 0), v(4, 0), v(4, 4), v(0, 4)), F.array(v(0, 0), v(4, 0), v(0, 4), v(4, 4))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.simple_ring(F.when(F.col("event_id") % 2 == 0, square).otherwise(bow)).alias("simple"))


@query("""WITH f AS (SELECT vec_id, 81.28::DOUBLE + 0.01::DOUBLE * embedding[2*i+1]::DOUBLE AS lon, 21.26::DOUBLE + 0.01::DOUBLE * embedding[2*i+2]::DOUBLE AS lat FROM embeddings, (SELECT unnest(range(0, 32)) AS i))
SELECT vec_id AS id FROM f GROUP BY 1 HAVING max(lon) >= 81.2825::DOUBLE AND min(lon) <= 81.283::DOUBLE AND max(lat) >= 21.2632::DOUBLE AND min(lat) <= 21.264::DOUBLE""")
def ways_in_box(spark, d):
    f = lines(spark, d).select(F.col("seq").alias("id"), F.col("coordinates").alias("ring"))
    return providers.ways_in_box(f, 81.2825, 21.2632, 81.283, 21.264).select("id")


@query("SELECT event_id AS upload, CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN user_id % 4 = 3 THEN 'extension' WHEN value > 90 THEN 'too large' ELSE 'ok' END AS verdict FROM events")
def upload_validation(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    path = F.element_at(F.array(*[F.lit(x) for x in ("a.kml", "b.KMZ", "c.Kml", "d.txt")]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("upload"), contours.verdict(path, F.when(F.col("event_id") % 7 == 0, 0).when(F.col("value") > 90, contours.MAX_BYTES + 1).otherwise(100)).alias("verdict"))
