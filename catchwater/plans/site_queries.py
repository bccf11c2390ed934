"""Grid, flow and site queries. orders are the cells of 24 grids of different sizes and resolutions: whole-number elevations with a slope to the south-east.

Each 300 orders are a row of all of them; scenario s has s + 1 columns. Topology is computed on whole numbers, so that both engines see the same ties; metres
come from them by division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.operators import flow, hydrology, layers, sites, terrain
from catchwater.params import Params
from catchwater.plans.hydro_queries import daily
from catchwater.scratch import written

# Ranks that can be null are given as doubles, which both engines return alike.
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
P = Params()
UNIT = 20_000.0  # of whole-number elevations to a metre


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


SCENARIO = "CAST(floor((sqrt(CAST(8 * (o_orderkey % 300) + 1 AS DOUBLE)) - 1) / 2) AS INT)"
RESOLUTION = "30.0D + 5 * (scenario % 4)"


def surface(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", F.expr(SCENARIO).alias("scenario"))
    at = o.select("scenario", F.expr("int(o_orderkey div 300)").alias("row"), F.expr("int(o_orderkey % 300 - scenario * (scenario + 1) div 2)").alias("col"), "o_totalprice", F.expr(RESOLUTION).alias("resolution"))
    return at.select("scenario", "row", "col", F.expr("cast(floor(o_totalprice) AS BIGINT) + 40000L * (row + col)").alias("z"), "resolution")


DEM = f"""o1 AS (SELECT o_orderkey, o_totalprice, {SCENARIO} AS scenario FROM orders), o2 AS (SELECT scenario, (o_orderkey // 300)::INT AS row, (o_orderkey % 300 - scenario * (scenario + 1) // 2)::INT AS col, o_totalprice FROM o1),
dem AS (SELECT scenario, row, col, floor(o_totalprice)::BIGINT + 40000 * (row + col) AS z, 30.0::DOUBLE + 5 * (scenario % 4) AS resolution FROM o2)"""
# Steps of the eight directions.
DIRS = "dirs AS (SELECT * FROM (VALUES (0,-1,0,1.0::DOUBLE),(1,-1,1,sqrt(2.0::DOUBLE)),(2,0,1,1.0::DOUBLE),(3,1,1,sqrt(2.0::DOUBLE)),(4,1,0,1.0::DOUBLE),(5,1,-1,sqrt(2.0::DOUBLE)),(6,0,-1,1.0::DOUBLE),(7,-1,-1,sqrt(2.0::DOUBLE))) t(k, dr, dc, dist))"


def steps(name: str, source: str, value: str) -> str:
    """CTEs of the direction of each cell of source: {name}."""
    return f"""{name}_g AS (SELECT a.scenario, a.row, a.col, d.k, (a.{value} - b.{value}) / (a.resolution * d.dist) AS g FROM {source} a CROSS JOIN dirs d JOIN {source} b ON b.scenario = a.scenario AND b.row = a.row + d.dr AND b.col = a.col + d.dc WHERE b.{value} < a.{value}),
{name}_b AS (SELECT scenario, row, col, k, row_number() OVER (PARTITION BY scenario, row, col ORDER BY g DESC, k) AS r FROM {name}_g),
{name} AS (SELECT a.scenario, a.row, a.col, coalesce(b.k, -1)::INT AS direction FROM {source} a LEFT JOIN {name}_b b ON a.scenario = b.scenario AND a.row = b.row AND a.col = b.col AND b.r = 1)"""


def ways(name: str, directions: str) -> str:
    """CTEs: {name}_e edges, {name} the number of cells upstream of each."""
    return f"""{name}_e AS (SELECT f.scenario, f.row, f.col, f.row + d.dr AS r2, f.col + d.dc AS c2 FROM {directions} f JOIN dirs d ON f.direction = d.k),
{name}_w(scenario, row, col, r, c) AS (SELECT scenario, row, col, r2, c2 FROM {name}_e UNION ALL SELECT w.scenario, w.row, w.col, e.r2, e.c2 FROM {name}_w w JOIN {name}_e e ON w.scenario = e.scenario AND w.r = e.row AND w.c = e.col),
{name} AS (SELECT f.scenario, f.row, f.col, coalesce(n.acc, 0) AS acc FROM {directions} f LEFT JOIN (SELECT scenario, r, c, count(*) AS acc FROM {name}_w GROUP BY 1, 2, 3) n ON f.scenario = n.scenario AND f.row = n.r AND f.col = n.c)"""


def fill(iterations: int = 220) -> str:
    return f"""around AS (SELECT a.scenario, a.row, a.col, count(*) AS n FROM dem a JOIN dem b ON a.scenario = b.scenario AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3),
it(i, scenario, row, col, z, resolution, w) AS (SELECT 0, scenario, row, col, z, resolution, CASE WHEN n < 9 THEN z ELSE 1000000000000 END FROM dem JOIN around USING (scenario, row, col)
 UNION ALL SELECT i + 1, scenario, row, col, z, resolution, greatest(z, min(m) OVER (PARTITION BY scenario, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) FROM (SELECT *, min(w) OVER (PARTITION BY scenario, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM it WHERE i < {iterations})),
filled AS (SELECT scenario, row, col, z, resolution, w AS filled FROM it WHERE i = {iterations})"""


_SIDE = "CASE WHEN {a}.h IS NULL AND {b}.h IS NULL THEN 0.0::DOUBLE WHEN {a}.h IS NULL THEN ({b}.h - a.h) / a.resolution WHEN {b}.h IS NULL THEN (a.h - {a}.h) / a.resolution ELSE ({b}.h - {a}.h) / (2 * a.resolution) END"
SLOPE = f"""sl AS (SELECT a.scenario, a.row, a.col, degrees(atan(sqrt(pow({_SIDE.format(a='w', b='e')}, 2) + pow({_SIDE.format(a='n', b='s')}, 2)))) AS slope_deg
FROM hf a LEFT JOIN hf w ON w.scenario = a.scenario AND w.row = a.row AND w.col = a.col - 1 LEFT JOIN hf e ON e.scenario = a.scenario AND e.row = a.row AND e.col = a.col + 1 LEFT JOIN hf n ON n.scenario = a.scenario AND n.col = a.col AND n.row = a.row - 1 LEFT JOIN hf s ON s.scenario = a.scenario AND s.col = a.col AND s.row = a.row + 1)"""


@query(f"WITH RECURSIVE {DEM}, hf AS (SELECT scenario, row, col, resolution, z / {UNIT}::DOUBLE AS h FROM dem), {SLOPE} SELECT scenario, row, col, round(slope_deg, 6) AS slope_deg FROM sl")
def slope(spark, d):
    c = surface(spark, d).withColumn("h", F.col("z") / UNIT)
    return terrain.slope(c, "h", "resolution").select("scenario", "row", "col", F.round("slope_deg", 6).alias("slope_deg"))


@query(f"WITH {DEM}, hf AS (SELECT scenario, row, col, resolution, z / {UNIT}::DOUBLE AS h FROM dem), {SLOPE} SELECT scenario, round(min(h), 6) AS min_elevation_m, round(max(h), 6) AS max_elevation_m, round(avg(h), 6) AS mean_elevation_m, round(max(h) - min(h), 6) AS relief_m, round(min(slope_deg), 6) AS min_slope_deg, round(max(slope_deg), 6) AS max_slope_deg, round(avg(slope_deg), 6) AS mean_slope_deg, count(*) AS cells FROM hf JOIN sl USING (scenario, row, col) GROUP BY scenario")
def terrain_stats(spark, d):
    c = terrain.slope(surface(spark, d).withColumn("elevation_m", F.col("z") / UNIT), "elevation_m", "resolution")
    s = terrain.terrain_stats(c)
    return s.select("scenario", *[F.round(x, 6).alias(x) for x in s.columns[1:-1]], "cells")


@query(f"WITH {DEM} SELECT a.scenario, a.row, a.col, min(b.z) AS low FROM dem a JOIN dem b ON a.scenario = b.scenario AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL")
def local_minimum(spark, d):
    return terrain.local_minimum(surface(spark, d)).select("scenario", "row", "col", "low")


@query(f"WITH RECURSIVE {DEM}, {fill()} SELECT scenario, row, col, z, filled FROM filled")
def fill_depressions(spark, d):
    return terrain.fill_depressions(surface(spark, d)).select("scenario", "row", "col", "z", "filled")


def directed(spark, d) -> DataFrame:
    return flow.direction(surface(spark, d), "z", "resolution")


@query(f"WITH {DEM}, {DIRS}, {steps('f', 'dem', 'z')} SELECT scenario, row, col, direction FROM f")
def flow_direction(spark, d):
    return directed(spark, d).select("scenario", "row", "col", "direction")


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')} SELECT f.scenario, f.row, f.col, count(e.row) AS inflows FROM f LEFT JOIN a_e e ON e.scenario = f.scenario AND e.r2 = f.row AND e.c2 = f.col GROUP BY ALL")
def flow_indegree(spark, d):
    return flow.indegree(directed(spark, d)).select("scenario", "row", "col", F.col("inflows").cast("long").alias("inflows"))


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')} SELECT scenario, row, col, acc FROM a")
def flow_accumulation(spark, d):
    return flow.accumulation(directed(spark, d)).select("scenario", "row", "col", "acc")


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')} SELECT scenario, row, col, round((acc + 1) * pow(30 + 5 * (scenario % 4), 2) / 1e6::DOUBLE, 6) AS area_km2 FROM a")
def catchment_area(spark, d):
    return flow.accumulation(directed(spark, d)).select("scenario", "row", "col", F.round(sites.area_km2(), 6).alias("area_km2"))


# Pour points: all cells that flow nowhere, so that each cell is in one catchment.
POURS = "direction = -1"
MEMBERS = "o AS (SELECT scenario, row AS r, col AS c FROM f WHERE direction = -1), m AS (SELECT scenario, (r::BIGINT << 32) + c AS pour, row, col FROM a_w JOIN o USING (scenario, r, c) UNION ALL SELECT scenario, (r::BIGINT << 32) + c, r, c FROM o)"


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')}, {MEMBERS} SELECT scenario, pour, row, col FROM m")
def catchment_cells(spark, d):
    f = written(directed(spark, d), "directed")
    return flow.catchments(f, f.where(POURS))


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')}, {MEMBERS}, s AS (SELECT * FROM (VALUES ('N',-1,0),('E',0,1),('S',1,0),('W',0,-1)) t(side, dr, dc)) SELECT m.scenario, m.pour, m.row, m.col, s.side FROM m CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.scenario = m.scenario AND x.pour = m.pour AND x.row = m.row + s.dr AND x.col = m.col + s.dc)")
def catchment_boundary(spark, d):
    f = written(directed(spark, d), "directed")
    return flow.boundary_edges(written(flow.catchments(f, f.where(POURS)), "members"))


# The chain that leads to sites: filled surface, slope and flow on it, seeds, thinning, filters, scores.
def grid(spark, d) -> DataFrame:
    """Cells with elevation_m, filled_m, slope_deg, low, acc and coordinates."""
    c = terrain.fill_depressions(surface(spark, d)).withColumn("elevation_m", F.col("z") / UNIT).withColumn("filled_m", F.col("filled") / UNIT)
    c = flow.direction(c, "filled", "resolution", terrain.gradients("filled_m", "resolution"), terrain.lowest_around("elevation_m"))
    c = flow.accumulation(written(c.select("scenario", "row", "col", "elevation_m", "filled_m", terrain.steepness().alias("slope_deg"), "low", "resolution", "direction"), "directed"))
    return written(c.select("scenario", "row", "col", "elevation_m", "filled_m", "slope_deg", "low", "acc", "resolution", (21.3 - F.col("row") * F.col("resolution") * 0.000009).alias("latitude"), (81.2 + F.col("scenario") + F.col("col") * F.col("resolution") * 0.0000097).alias("longitude")), "grid")


def all_seeds(spark, d) -> DataFrame:
    g = grid(spark, d)
    return sites.merge_seeds(sites.depression_seeds(g), sites.convergence_seeds(g))


def half(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE"


GRID = f"""{DEM}, {DIRS}, {fill()}, {steps('f', 'filled', 'filled')}, {ways('a', 'f')}, hf AS (SELECT scenario, row, col, resolution, filled / {UNIT}::DOUBLE AS h FROM filled), {SLOPE},
low AS (SELECT x.scenario, x.row, x.col, min(y.z) AS low FROM dem x JOIN dem y ON x.scenario = y.scenario AND y.row BETWEEN x.row - 2 AND x.row + 2 AND y.col BETWEEN x.col - 2 AND x.col + 2 GROUP BY 1, 2, 3),
grid AS (SELECT f.scenario, f.row, f.col, f.resolution, f.z / {UNIT}::DOUBLE AS elevation_m, f.filled / {UNIT}::DOUBLE AS filled_m, s.slope_deg, l.low / {UNIT}::DOUBLE AS low, a.acc, 21.3::DOUBLE - f.row * f.resolution * 0.000009::DOUBLE AS latitude, 81.2::DOUBLE + f.scenario + f.col * f.resolution * 0.0000097::DOUBLE AS longitude FROM filled f JOIN sl s USING (scenario, row, col) JOIN low l USING (scenario, row, col) JOIN a USING (scenario, row, col))"""
SEEDS = f"""{GRID}, dp AS (SELECT *, greatest(0, filled_m - elevation_m) AS depression_delta_m FROM grid), dl AS (SELECT *, 'depression' AS seed_type FROM dp WHERE depression_delta_m > 0.1::DOUBLE AND elevation_m = low),
qt AS (SELECT scenario, quantile_cont(acc, 0.99) AS cut FROM grid WHERE acc > 0 GROUP BY scenario), cv AS (SELECT dp.*, 'flow_convergence' AS seed_type FROM dp JOIN qt USING (scenario) WHERE acc >= cut),
dd AS (SELECT * FROM dl UNION ALL BY NAME SELECT * EXCLUDE k FROM (SELECT *, 'depression' AS seed_type, row_number() OVER (PARTITION BY scenario ORDER BY row, col) AS k FROM dp WHERE depression_delta_m > 0.1::DOUBLE AND scenario NOT IN (SELECT scenario FROM dl)) WHERE k <= 50),
seeds AS (SELECT * FROM dd UNION ALL BY NAME SELECT * FROM cv WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.scenario = cv.scenario AND dd.row = cv.row AND dd.col = cv.col)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY acc DESC, seed_type, row, col) AS o FROM seeds)"""
NEAR = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(s.latitude - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - k.lon) / 2), 2))) < 100"
NMS = f"""{SEEDS}, kept(scenario, o, ok, l) AS (SELECT DISTINCT scenario, 0::BIGINT, false, [] :: STRUCT(lat DOUBLE, lon DOUBLE)[] FROM ordered UNION ALL
 SELECT s.scenario, s.o, NOT x.hit, CASE WHEN x.hit THEN p.l ELSE list_append(p.l, {{'lat': s.latitude, 'lon': s.longitude}}) END FROM kept p JOIN ordered s ON s.scenario = p.scenario AND s.o = p.o + 1,
 LATERAL (SELECT len(list_filter(p.l, lambda k: {NEAR})) > 0 AS hit) x),
thin AS (SELECT s.*, row_number() OVER (PARTITION BY s.scenario ORDER BY s.o)::INT AS seq FROM ordered s JOIN kept USING (scenario, o) WHERE kept.ok)"""
CAND = f"{NMS}, cand AS (SELECT *, 'C' || seq AS candidate_id, (acc + 1) * (resolution * resolution) / 1e6::DOUBLE AS area FROM thin WHERE seq <= 15)"
CASCADE = f"""{CAND}, status AS (SELECT *, CASE WHEN slope_deg > 15 THEN 'rejected_slope' WHEN area < 0.005::DOUBLE THEN 'rejected_catchment' ELSE 'accepted' END AS status0,
 CASE WHEN slope_deg > 15 THEN 'Slope ' || printf('%.1f', {half('slope_deg', 1)}) || '° exceeds maximum 15.0°' WHEN area < 0.005::DOUBLE THEN 'Catchment ' || printf('%.4f', {half('area', 4)}) || ' km² < minimum 0.005 km²' END AS reason0, CASE WHEN slope_deg > 15 THEN 0 ELSE {half('area', 4)} END AS catchment_area_km2 FROM cand)"""
NORM = lambda c, inv: f"CASE WHEN max({c}) OVER p = min({c}) OVER p THEN 50.0::DOUBLE ELSE {'100.0::DOUBLE - ' if inv else ''}({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) * 100.0::DOUBLE END"
SCORE = f"""{CASCADE}, fac AS (SELECT *, {NORM('catchment_area_km2', 0)} AS c1, {NORM('acc::DOUBLE', 0)} AS c2, {NORM('slope_deg', 1)} AS c3, {NORM('elevation_m', 1)} AS c4, {NORM('depression_delta_m', 0)} AS c5 FROM status WHERE status0 = 'accepted' WINDOW p AS (PARTITION BY scenario)),
sc AS (SELECT *, {half('0.35::DOUBLE * c1 + 0.25::DOUBLE * c2 + 0.20::DOUBLE * c3 + 0.10::DOUBLE * c4 + 0.10::DOUBLE * c5', 1)} AS score FROM fac),
rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, seq)::INT AS rank, row_number() OVER (PARTITION BY scenario ORDER BY seq) AS nth FROM sc),
final AS (SELECT s.*, r.score, r.rank, r.c1, r.c2, r.c3, r.c4, r.c5, CASE WHEN r.nth > 5 THEN 'rejected_duplicate' ELSE s.status0 END AS status, CASE WHEN r.nth > 5 THEN 'Exceeds maximum candidate limit' ELSE s.reason0 END AS rejection_reason FROM status s LEFT JOIN rk r USING (scenario, seq))"""


@query(f"WITH RECURSIVE {SEEDS} SELECT scenario, row, col, round(depression_delta_m, 6) AS depression_delta_m FROM dd")
def depression_seeds(spark, d):
    return sites.depression_seeds(grid(spark, d)).select("scenario", "row", "col", F.round("depression_delta_m", 6).alias("depression_delta_m"))


@query(f"WITH RECURSIVE {SEEDS} SELECT scenario, row, col, acc FROM cv")
def convergence_seeds(spark, d):
    return sites.convergence_seeds(grid(spark, d)).select("scenario", "row", "col", "acc")


@query(f"WITH RECURSIVE {SEEDS} SELECT scenario, row, col, seed_type, acc FROM seeds")
def merge_seeds(spark, d):
    return all_seeds(spark, d).select("scenario", "row", "col", "seed_type", "acc")


@query(f"WITH RECURSIVE {NMS} SELECT scenario, row, col, seq FROM thin")
def nms(spark, d):
    return sites.thin(all_seeds(spark, d)).select("scenario", "row", "col", "seq")


def filtered(spark, d) -> DataFrame:
    return sites.cascade(sites.evaluated(sites.thin(all_seeds(spark, d))))


@query(f"WITH RECURSIVE {CASCADE} SELECT scenario, candidate_id, status0 AS status, reason0 AS rejection_reason, catchment_area_km2 FROM status")
def filter_cascade(spark, d):
    return filtered(spark, d).select("scenario", "candidate_id", "status", "rejection_reason", "catchment_area_km2")


@query(f"WITH RECURSIVE {SCORE} SELECT scenario, candidate_id, {half('c1', 1)} AS catchment_score, {half('c2', 1)} AS flow_score, {half('c3', 1)} AS slope_score, {half('c4', 1)} AS relief_score, {half('c5', 1)} AS depression_score, score, rank::DOUBLE AS rank FROM final")
def score_rank(spark, d):
    return sites.score(filtered(spark, d)).select("scenario", "candidate_id", "catchment_score", "flow_score", "slope_score", "relief_score", "depression_score", "score", F.col("rank").cast("double").alias("rank"))


@query(f"WITH RECURSIVE {SCORE} SELECT scenario, candidate_id, status, rejection_reason, score, rank::DOUBLE AS rank FROM final")
def cap_candidates(spark, d):
    return sites.cap(sites.score(filtered(spark, d))).select("scenario", "candidate_id", "status", "rejection_reason", "score", F.col("rank").cast("double").alias("rank"))


@query(f"WITH RECURSIVE {SCORE} SELECT scenario, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted') AS rejected, count(*) AS candidates FROM final GROUP BY scenario")
def status_counts(spark, d):
    return layers.status_counts(sites.cap(sites.score(filtered(spark, d))))


@query(f"""WITH RECURSIVE {SCORE} SELECT scenario, candidate_id, concat_ws('; ', CASE WHEN catchment_area_km2 >= 1 THEN 'Large' WHEN catchment_area_km2 >= 0.5 THEN 'Moderate' ELSE 'Small' END || printf(' contributing catchment (%.2f km²)', {half('catchment_area_km2', 2)}), CASE WHEN acc > 1000 THEN 'Strong drainage convergence point' WHEN acc > 200 THEN 'Moderate drainage convergence' END,
CASE WHEN slope_deg < 5 THEN printf('Very gentle slope (%.1f°) — well suited for pond construction', {half('slope_deg', 1)}) WHEN slope_deg < 10 THEN printf('Gentle slope (%.1f°) — suitable for construction', {half('slope_deg', 1)}) ELSE printf('Moderate slope (%.1f°) — construction feasible but requires assessment', {half('slope_deg', 1)}) END,
CASE WHEN depression_delta_m > 0.5 THEN printf('Terrain naturally forms a depression (depth ≈ %.1f m)', {half('depression_delta_m', 1)}) END, printf('Elevation: %.1f m above mean sea level', {half('elevation_m', 1)}), 'Candidate seed type: ' || replace(seed_type, '_', ' ')) AS reasoning FROM final""")
def reasoning(spark, d):
    return filtered(spark, d).select("scenario", "candidate_id", F.array_join(sites.reasoning(), "; ").alias("reasoning"))


@query(f"""WITH RECURSIVE {SCORE}, g AS (SELECT floor(CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(DISTINCT year(CAST(l_shipdate AS DATE))) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mm FROM lineitem GROUP BY l_suppkey), r AS (SELECT CAST(sum(CAST(mm AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mm FROM g),
q AS (SELECT *, CASE WHEN catchment_area_km2 > 0 THEN {half('0.35::DOUBLE * (mm / 1000) * (catchment_area_km2 * 1000000)', 2)} END AS m3, CASE WHEN slope_deg > 5 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS depth FROM final, r)
SELECT scenario, candidate_id, row, col, status, score, rank::DOUBLE AS rank, catchment_area_km2, m3 AS annual_runoff_m3, CASE WHEN m3 IS NOT NULL THEN depth END AS recommended_depth_m, {half('m3 * 0.8::DOUBLE', 2)} AS estimated_storage_m3, {half('m3 * 0.8::DOUBLE / depth', 2)} AS estimated_surface_area_m2 FROM q""")
def site_report(spark, d):
    """The flagship: ranked sites with runoff and pond size, rain the mean of all gauges."""
    out = reported(spark, d)
    return out.select("scenario", "candidate_id", "row", "col", "status", "score", F.col("rank").cast("double").alias("rank"), "catchment_area_km2", "annual_runoff_m3", "recommended_depth_m", "estimated_storage_m3", "estimated_surface_area_m2")


def reported(spark, d) -> DataFrame:
    found = sites.cap(sites.score(filtered(spark, d)))
    rain = hydrology.climatology(daily(spark, d)).agg((F.sum(F.col("annual_avg_mm").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("annual_avg_mm"))
    return hydrology.pond(hydrology.runoff(found.join(F.broadcast(rain))))


@query(f"""WITH RECURSIVE {SCORE} SELECT scenario, CASE WHEN count(*) FILTER (status = 'accepted') > 0 THEN 'success' ELSE 'partial' END AS status, max(CASE WHEN rank = 1 AND status = 'accepted' THEN candidate_id END) AS recommended, count(*) AS candidates,
string_agg(candidate_id || ' ' || status || ' ' || coalesce(printf('%.1f', score), '-'), ', ' ORDER BY status <> 'accepted', seq) AS sites FROM final GROUP BY scenario""")
def result_envelope(spark, d):
    """The result record of each area, and of it the status, the best site, the number of sites and the sites, accepted ones first."""
    e = layers.envelope(sites.cap(sites.score(filtered(spark, d))))
    each = F.from_json(F.get_json_object("result", "$.sites"), "array<struct<candidate_id:string,status:string,score:double>>")
    shown = F.transform(each, lambda x: F.concat_ws(" ", x["candidate_id"], x["status"], F.when(x["score"].isNull(), "-").otherwise(F.format_string("%.1f", x["score"]))))
    return e.select("scenario", "status", F.get_json_object("result", "$.recommended").alias("recommended"), F.get_json_object("result", "$.candidates").cast("long").alias("candidates"), F.array_join(shown, ", ").alias("sites"))


@query(f"""WITH RECURSIVE {SCORE} SELECT scenario, candidate_id, 'Point' AS kind, round(longitude, 9) AS lon, round(latitude, 9) AS lat, status, rank::DOUBLE AS rank, score, seed_type, rejection_reason FROM final""")
def candidate_layer(spark, d):
    """The GeoJSON layer of all sites, taken apart again."""
    fc = layers.collection(layers.candidate_features(reported(spark, d)), order=["seq"])
    f = fc.select("scenario", F.explode(F.from_json(F.get_json_object("geojson", "$.features"), "array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<id:string,status:string,rank:int,score:double,seed_type:string,rejection_reason:string>>>")).alias("f"))
    p, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    return f.select("scenario", p["id"].alias("candidate_id"), F.col("f.geometry.type").alias("kind"), F.round(at[0], 9).alias("lon"), F.round(at[1], 9).alias("lat"), p["status"].alias("status"), p["rank"].cast("double").alias("rank"), p["score"].alias("score"), p["seed_type"].alias("seed_type"), p["rejection_reason"].alias("rejection_reason"))


# Parts of a catchment whose cells share sides, by the smallest cell that is reached; and the largest part of each.
PARTS = "l(scenario, pour, row, col, root) AS (SELECT scenario, pour, row, col, (row::BIGINT << 32) + col FROM m UNION SELECT m.scenario, m.pour, m.row, m.col, l.root FROM l JOIN m ON m.scenario = l.scenario AND m.pour = l.pour AND abs(m.row - l.row) + abs(m.col - l.col) = 1 AND (m.row::BIGINT << 32) + m.col > l.root), part AS (SELECT scenario, pour, row, col, min(root) AS root FROM l GROUP BY ALL)"


@query(f"WITH RECURSIVE {DEM}, {DIRS}, {steps('f', 'dem', 'z')}, {ways('a', 'f')}, {MEMBERS}, {PARTS} SELECT scenario, pour, max(n) AS cells, max(n)::DOUBLE AS ring_cells FROM (SELECT scenario, pour, root, count(*) AS n FROM part GROUP BY ALL) GROUP BY scenario, pour")
def catchment_polygons(spark, d):
    """The largest part of each catchment as a GeoJSON polygon in metres; its area, in cells, is taken from the polygon that is read back."""
    f = written(directed(spark, d), "directed")
    rings = flow.boundary(written(flow.catchments(f, f.where(POURS)), "members"))
    corner = lambda v: F.struct((v["col"] * 30.0).alias("lon"), (v["row"] * -30.0).alias("lat"))
    shape = layers.as_json(layers.polygon(F.transform("rings", lambda r: F.transform(r, corner))))
    back = rings.select("scenario", "pour", F.col("cells").cast("long").alias("cells"), F.from_json(shape, "type string, coordinates array<array<array<double>>>").alias("g")).where("g.type = 'Polygon'")
    twice = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda x, y: x + y)
    areas = F.transform("g.coordinates", lambda r: F.abs(twice(r)) / 1800)
    return back.select("scenario", "pour", "cells", (2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda x, y: x + y)).alias("ring_cells"))


@query(f"""WITH RECURSIVE {SCORE}, s AS (SELECT DISTINCT scenario FROM dem), b AS (SELECT * FROM final WHERE rank = 1 AND status = 'accepted')
SELECT s.scenario, round(coalesce(latitude, 21.0), 6) AS latitude, round(coalesce(longitude, 81.0), 6) AS longitude FROM s LEFT JOIN b USING (scenario)""")
def reference_point(spark, d):
    box = surface(spark, d).select("scenario", F.lit(21.0).alias("center_lat"), F.lit(81.0).alias("center_lon")).distinct()
    r = layers.reference_point(sites.cap(sites.score(filtered(spark, d))), box)
    return r.select("scenario", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(f"""WITH RECURSIVE {CAND} SELECT scenario, candidate_id, CASE WHEN slope_deg > 15 THEN 'rejected_slope' WHEN col >= 12 THEN 'rejected_outside_selection' WHEN row % 3 = 0 THEN 'rejected_constraint' WHEN area < 0.005::DOUBLE THEN 'rejected_catchment' ELSE 'accepted' END AS status FROM cand""")
def selection_cascade(spark, d):
    """The order of the filters, with given verdicts on selection and land use; analysis_candidates has real ones."""
    s = sites.evaluated(sites.thin(all_seeds(spark, d)))
    return sites.cascade(s, outside=F.col("col") >= 12, excluded=F.col("row") % 3 == 0).select("scenario", "candidate_id", "status")
