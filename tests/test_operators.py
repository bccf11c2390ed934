"""Operators on small grids and records with known results."""

import heapq
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from catchwater.functions import geo
from catchwater.operators import flow, hydrology, layers, sites, terrain
from catchwater.params import Params
from catchwater.sources import contours, providers


def grid(spark, z, scenario=0):
    return spark.createDataFrame([(scenario, r, c, v) for r, row in enumerate(z) for c, v in enumerate(row)], "scenario int, row int, col int, z double")


def back(df, col):
    return {(r["row"], r["col"]): r[col] for r in df.collect()}


def flood(z):
    """Priority flood with a heap."""
    n, m = len(z), len(z[0])
    out, heap = {}, [(z[r][c], r, c) for r in range(n) for c in range(m) if r in (0, n - 1) or c in (0, m - 1)]
    seen = {(r, c) for _, r, c in heap}
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        out[r, c] = h
        for dr, dc in terrain.D8:
            p = r + dr, c + dc
            if 0 <= p[0] < n and 0 <= p[1] < m and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (max(h, z[p[0]][p[1]]), *p))
    return out


@pytest.mark.parametrize("seed,levels", [(1, 1000), (2, 5), (3, 2)])
def test_fill_equals_flood(spark, seed, levels):
    r = random.Random(seed)
    z = [[float(r.randrange(levels)) for _ in range(23)] for _ in range(17)]
    filled = back(terrain.fill_depressions(grid(spark, z)), "filled")
    assert filled == flood(z)
    assert all(filled[i, j] >= z[i][j] for i, j in filled)


def test_single_pit(spark):
    z = [[100.0] * 5 for _ in range(5)]
    z[2][2] = 95.0
    c = terrain.fill_depressions(grid(spark, z))
    assert set(back(c, "filled").values()) == {100.0}
    c = terrain.local_minimum(c.withColumn("elevation_m", F.col("z")).withColumn("filled_m", F.col("filled")), "elevation_m").withColumn("acc", F.lit(1))
    assert [(r["row"], r["col"]) for r in sites.depression_seeds(c).collect()] == [(2, 2)]


def test_plane_slope_and_flow(spark):
    z = [[10.0 * (6 - r) for _ in range(6)] for r in range(6)]
    s = back(terrain.slope(grid(spark, z), "z", 10.0), "slope_deg")
    assert all(abs(v - 45) < 1e-9 for v in s.values())
    f = flow.accumulation(flow.direction(grid(spark, z), "z"))
    assert {d for (r, c), d in back(f, "direction").items() if r < 5} == {4}
    assert all(v == r for (r, c), v in back(f, "acc").items())


def test_flow_invariants(spark):
    r = random.Random(5)
    z = [[float(r.randrange(50)) for _ in range(15)] for _ in range(15)]
    f = flow.accumulation(flow.direction(grid(spark, z), "z"))
    e = flow.edges(f)
    assert flow.indegree(f).agg(F.sum("inflows")).first()[0] == e.count()
    members = flow.catchments(f, f.where("row % 4 = 1"))
    n = {r["pour"]: r["n"] for r in members.groupBy("pour").agg(F.count("*").alias("n")).collect()}
    assert n == {(r["row"] << 32) + r["col"]: r["acc"] + 1 for r in f.where("row % 4 = 1").collect()}
    parts = flow.boundary(members).collect()
    assert len(parts) == len(n) and all(0 < p["cells"] <= n[p["pour"]] for p in parts)
    assert all(ring[0] == ring[-1] for p in parts for ring in p["rings"])


def test_boundary_of_a_ring_has_a_hole(spark):
    m = spark.createDataFrame([(0, 1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(0, 1, 5, 5)], "scenario int, pour long, row int, col int")
    b = flow.boundary(m).first()
    assert b["cells"] == 8 and len(b["rings"]) == 2


def test_flat_grid_has_no_convergence(spark):
    c = grid(spark, [[1.0] * 4] * 4).withColumn("acc", F.lit(0)).withColumn("elevation_m", F.col("z")).withColumn("filled_m", F.col("z"))
    assert sites.convergence_seeds(c).count() == 0


def test_thinning(spark):
    r = random.Random(4)
    pts = [(0, k, 0, r.randrange(9), "depression", 21.3 + r.random() * 0.01, 81.2 + r.random() * 0.01) for k in range(120)]
    s = spark.createDataFrame(pts, "scenario int, row int, col int, acc int, seed_type string, latitude double, longitude double")
    kept = sites.thin(s).orderBy("seq").collect()
    d = lambda a, b: 2 * geo.RADIUS_M * __import__("math").asin(((__import__("math").sin(__import__("math").radians(b[0] - a[0]) / 2)) ** 2 + __import__("math").cos(__import__("math").radians(a[0])) * __import__("math").cos(__import__("math").radians(b[0])) * __import__("math").sin(__import__("math").radians(b[1] - a[1]) / 2) ** 2) ** 0.5)
    at = [(k["latitude"], k["longitude"]) for k in kept]
    assert all(d(a, b) >= 100 for i, a in enumerate(at) for b in at[:i])
    assert all(any(d((p[5], p[6]), a) < 100 for a in at) for p in pts)


def scored(spark, rows):
    return sites.score(spark.createDataFrame(rows, "scenario int, seq int, candidate_id string, catchment_area_km2 double, acc long, slope_deg double, elevation_m double, depression_delta_m double, status string").withColumn("rejection_reason", F.lit(None).cast("string")))


def test_scores(spark):
    one = scored(spark, [(0, 1, "C1", 0.1, 5, 1.0, 9.0, 0.0, "accepted")]).first()
    assert one["score"] == 50.0 and one["rank"] == 1
    rows = [(0, k, f"C{k}", 0.1 * k, k, 5.0, 10.0, 0.0, "accepted") for k in range(1, 8)]
    out = {r["candidate_id"]: r for r in sites.cap(scored(spark, rows)).collect()}
    assert out["C7"]["rank"] == 1 and out["C7"]["status"] == "rejected_duplicate" and out["C1"]["status"] == "accepted"
    out = {r["candidate_id"]: r for r in sites.cap(scored(spark, rows), Params(cap_by="rank")).collect()}
    assert out["C7"]["status"] == "accepted"


def rain(spark, rows):
    return spark.createDataFrame(rows, "site string, d string, precipitation_sum double").withColumn("date", F.to_date("d"))


def test_climatology(spark):
    a = [("A", "2023-06-01", 10.0), ("A", "2023-07-01", 30.0), ("A", "2024-06-01", 20.0), ("A", "2024-07-01", 40.0), ("B", "2024-01-01", 1.0), ("B", "2024-06-01", 9.0), ("N", "2024-01-01", None), ("M", "2024-01-01", -1.0)]
    got = {r["site"]: r for r in hydrology.climatology(rain(spark, a)).collect()}
    assert (got["A"]["annual_avg_mm"], got["A"]["monsoon_mm"]) == (50.0, 50.0)
    assert got["A"]["monthly_avg_mm"]["Jun"] == 15.0 and got["A"]["monthly_avg_mm"]["Jul"] == 35.0 and got["A"]["monthly_avg_mm"]["Jan"] == 0.0
    assert got["B"]["annual_avg_mm"] == 10.0
    assert got["N"]["status"] == got["M"]["status"] == "unavailable" and got["N"]["annual_avg_mm"] is None


def test_runoff_and_pond(spark):
    df = spark.createDataFrame([(1000.0, 0.05, 0.4, 2.0), (None, 0.05, 0.4, 2.0), (1000.0, 0.0, 0.4, 2.0), (1000.0, 0.05, 1.01, 2.0), (1000.0, 0.03, 0.4, 6.0), (1000.0, 0.03, 0.4, 5.0)], "annual_avg_mm double, catchment_area_km2 double, c double, slope_deg double")
    got = hydrology.pond(hydrology.runoff(df, coefficient="c")).collect()
    assert got[0]["annual_runoff_m3"] == 20000.0
    assert [r["annual_runoff_m3"] for r in got[1:4]] == [None] * 3 and got[3]["runoff_message"] == hydrology.NO_COEFFICIENT
    assert (got[4]["recommended_depth_m"], got[4]["estimated_storage_m3"], got[4]["estimated_surface_area_m2"]) == (2.0, 9600.0, 4800.0)
    assert (got[5]["recommended_depth_m"], got[5]["estimated_surface_area_m2"]) == (3.0, 3200.0)


KML = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>{}</Folder></Document></kml>'
MARK = '<Placemark><name>{}</name><ExtendedData><SchemaData><SimpleData name="ID">0</SimpleData></SchemaData></ExtendedData><LineString><coordinates>{}</coordinates></LineString></Placemark>'


def test_uploads(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML.format(MARK.format("277.0", "81.1,21.2,5 81.2,21.3 x,1 200,1") + MARK.format("abc", "1,1 2,2") + MARK.format("-3.5", "1,1") + MARK.format("Elevation: 280", "1,1 2,2") + "<Placemark><name>1</name><Point/></Placemark>"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("other.kml", KML.format(MARK.format("5", "1,1 2,2")))
        z.writestr("doc.kml", KML.format(MARK.format("6m", "1,1 2,2")))
    (tmp_path / "b.kmz").write_bytes(buf.getvalue())
    (tmp_path / "c.kml").write_bytes(b"garbage")
    (tmp_path / "d.txt").write_text("x")
    (tmp_path / "e.kml").write_text("<kml/>")
    with zipfile.ZipFile(tmp_path / "f.kmz", "w") as z:
        z.writestr("x.txt", "x")
    marks = contours.read_uploads(spark, str(tmp_path)).cache()
    got = {(r["path"][-5:], r["elevation_m"]): r for r in contours.contours(marks).collect()}
    assert set(got) == {("a.kml", 277.0), ("a.kml", 280.0), ("b.kmz", 6.0)}
    assert [tuple(v) for v in got["a.kml", 277.0]["coordinates"]] == [(81.1, 21.2), (81.2, 21.3)] and got["a.kml", 277.0]["contour_id"] == "0"
    assert {r["path"][-5:] for r in marks.where("error IS NOT NULL").collect()} == {"c.kml", "d.txt", "e.kml", "f.kmz"}


def test_providers(spark):
    pts = spark.createDataFrame([(1, 21.26, 81.28), (2, 21.27, 81.29)], "point_id int, lat double, lon double")
    t0, t1 = (spark.createDataFrame(x, "point_id int, elevation double") for x in ([(1, 111.0), (2, None)], [(1, 5.0), (2, 222.0)]))
    assert [(r["elevation"], r["tier"]) for r in providers.fallback(pts, [t0, t1]).orderBy("point_id").collect()] == [(111.0, 1), (222.0, 2)]
    k = spark.range(1).select(providers.tile_key(F.lit(21.9), F.lit(81.28)), providers.tile_key(F.lit(-0.5), F.lit(-1.5))).first()
    assert tuple(k) == ("N21_00_E081_00", "S01_00_W002_00")
    assert providers.uncached(pts, t0).count() == 1


def test_geometry(spark):
    sq = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    got = spark.createDataFrame([(5.0, 5.0), (0.0, 5.0), (10.0, 10.0), (11.0, 5.0)], "x double, y double").select(geo.in_ring(F.col("x"), F.col("y"), sq)).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    x, y = geo.to_utm(F.lit(81.0), F.lit(21.0), F.lit(44), F.lit(False))
    r = spark.range(1).select(x, y).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1] - 2322137.6) < 60


def test_layers(spark):
    df = spark.createDataFrame([(0, 1, "C1", "rejected_slope", None, None, 1.0, 2.0, 0.1)], "scenario int, seq int, candidate_id string, status string, score double, rank int, longitude double, latitude double, catchment_area_km2 double")
    assert '"geometry":null' in layers.recommended(df).first()["geojson"]
    assert layers.envelope(df).first()["status"] == "partial"
    assert df.select(layers.title(F.col("status"))).first()[0] == "Slope"


def test_gap_fill_without_values(spark):
    c = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 5.0), (1, 0, 40, None)], "scenario int, row int, col int, elevation_m double")
    assert {(r["scenario"], r["col"]): r["elevation_m"] for r in terrain.fill_gaps(c).collect()} == {(0, 0): None, (1, 0): 5.0, (1, 40): 5.0}


def test_linear_surface_is_exact_on_a_plane(spark):
    from catchwater.operators import interpolate

    r = random.Random(8)
    plane = lambda x, y: 100 + 0.3 * x - 0.2 * y
    pts = [(0, x, y, plane(x, y)) for x, y in ((r.uniform(-50, 1050), r.uniform(-50, 1050)) for _ in range(400))] + [(0, x, y, plane(x, y)) for x in (-60.0, 1060.0) for y in (-60.0, 1060.0)]
    samples = spark.createDataFrame(pts, "scenario int, x double, y double, elevation_m double")
    spec = spark.createDataFrame([(0, 0.0, 1000.0, 20, 20, 50.0)], "scenario int, origin_x double, origin_y double, rows int, cols int, resolution double")
    cells = terrain.grid_cells(spec)
    got = interpolate.interpolate(cells, samples, tile_m=500.0, margin_m=400.0).join(cells, ["scenario", "row", "col"]).collect()
    assert len(got) == 400 and all(abs(g["elevation_m"] - plane(g["x"], g["y"])) < 1e-6 for g in got)
    few = interpolate.interpolate(cells, samples.limit(3)).where("elevation_m IS NOT NULL").count()
    assert few == 0
    near = interpolate.interpolate(cells, samples, "nearest").collect()
    assert min(p[3] for p in pts) <= min(g["elevation_m"] for g in near) and max(g["elevation_m"] for g in near) <= max(p[3] for p in pts)


@pytest.mark.parametrize("spread,n", [(8000, 6), (3000, 60)])
def test_interpolation_does_not_depend_on_tiles(spark, spread, n):
    from catchwater.operators import interpolate

    r = random.Random(n)
    pts = [(r.uniform(0, spread), r.uniform(0, spread)) for _ in range(n)]
    samples = spark.createDataFrame([(0, x, y, 100 + 0.3 * x - 0.2 * y) for x, y in pts], "scenario int, x double, y double, elevation_m double")
    spec = spark.createDataFrame([(0, spread * 0.2, spread * 0.8, 7, 7, spread * 0.6 / 7)], "scenario int, origin_x double, origin_y double, rows int, cols int, resolution double")
    cells = terrain.grid_cells(spec)
    tiled = {(g["row"], g["col"]): g["elevation_m"] for g in interpolate.interpolate(cells, samples, tile_m=500.0, margin_m=300.0).collect()}
    whole = {(g["row"], g["col"]): g["elevation_m"] for g in interpolate.interpolate(cells, samples, tile_m=1e5, margin_m=1e5).collect()}
    assert len(tiled) == 49 and all(abs(tiled[k] - whole[k]) < 1e-9 for k in whole)
    near = {(g["row"], g["col"]): g["elevation_m"] for g in interpolate.interpolate(cells, samples, "nearest", 500.0, 300.0).collect()}
    for c in cells.collect():
        best = min(pts, key=lambda p: (p[0] - c["x"]) ** 2 + (p[1] - c["y"]) ** 2)
        assert abs(near[c["row"], c["col"]] - (100 + 0.3 * best[0] - 0.2 * best[1])) < 1e-9


def test_entities_are_refused_wherever_they_stand():
    kml = b"<?xml version='1.0'?><!--" + b"x" * 5000 + b"--><!DOCTYPE kml [<!ENTITY a 'b'>]><kml><Placemark><name>5</name></Placemark></kml>"
    with pytest.raises(ValueError, match="entities"):
        list(contours.placemarks(kml))
    assert len(list(contours.placemarks(b"<kml><Placemark><name>5 &lt;!ENTITY</name></Placemark></kml>"))) == 1


def test_skipped_placemarks_are_counted(spark):
    marks = spark.createDataFrame([("a", 0, None, "5 m", "1,1 2,2", None), ("a", 1, None, "abc", "1,1 2,2", None), ("a", 2, None, "6", "1,1", None), ("a", 3, None, "6", None, None), ("b", None, None, None, None, "bad")], contours.SCHEMA)
    assert [tuple(r) for r in contours.skipped(marks).collect()] == [("a", 4, 1, 2, 1)]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    kind = "scenario string, status string, n int"
    one = lambda k, s: spark.createDataFrame([(k, s, 1)], kind)
    assert layers.stored_ids(spark, path) == []
    layers.save(one("1", "partial"), path)
    layers.save(one("a b/c=%", "success"), path)
    layers.save(one("1", "success"), path)
    assert layers.stored_ids(spark, path) == ["1", "a b/c=%"]
    assert {r["status"] for r in layers.stored(spark, path).collect()} == {"success"}
    found = layers.stored_one(spark, path, "a b/c=%", kind)
    assert [tuple(r) for r in found.select("scenario", "status").collect()] == [("a b/c=%", "success")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan and layers.stored_one(spark, path, "none", kind).count() == 0

    def fails(x):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        layers.save(one("1", "new").withColumn("n", F.udf(fails, "int")("n")), path)
    assert layers.stored_one(spark, path, "1", kind).first()["status"] == "success"
    layers.forget(spark, path, "a b/c=%")
    layers.forget(spark, path, "9")
    assert layers.stored_ids(spark, path) == ["1"]


RINGS = {  # ring, points strictly inside, points outside, whether it encloses nothing
    "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3.9, 2)], [(0, 2), (5, 1), (4, 4)], False),
    "closed and repeated": ([(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0), (0, 0)], [(1, 1)], [(-1, 1)], False),
    "clockwise": ([(0, 0), (0, 4), (4, 4), (4, 0)], [(1, 1)], [(5, 5)], False),
    "bow-tie": ([(0, 0), (4, 4), (4, 0), (0, 3)], [(3.5, 2)], [(0.2, 1), (2, 3)], False),  # the lobe with the highest corner
    "spike": ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)], [(1, 1), (3, 3)], [(2, 5), (3, 5)], False),
    "wound twice": ([(0, 0), (9, 0), (9, 9), (3, 9), (3, 3), (6, 3), (6, 8), (0, 8)], [(1, 1), (8, 8), (4, 5)], [(-1, 4), (10, 10), (2, 8.5)], False),
    "line": ([(0, 0), (2, 2), (4, 4)], [], [(1, 1)], True),
    "two places": ([(0, 0), (1, 0), (0, 0)], [], [], True),
    "there and back": ([(0, 0), (4, 0), (4, 4), (4, 0)], [], [(3, 1)], True),
    "one place": ([(1, 1), (1, 1), (1, 1)], [], [], True),
}


@pytest.mark.parametrize("name", RINGS)
def test_selection_rings(spark, name):
    ring, inside, outside, nothing = RINGS[name]
    rows = [([{"x": float(x), "y": float(y)} for x, y in ring], float(px), float(py)) for px, py in [*inside, *outside] or [(0, 0)]]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>, x double, y double")
    got = df.select(geo.in_selection(F.col("x"), F.col("y"), F.col("ring")).alias("i"), geo.no_area(F.col("ring")).alias("n")).collect()
    assert [bool(r["n"]) for r in got] == [nothing] * len(got)
    if not nothing:
        assert [r["i"] for r in got] == [True] * len(inside) + [False] * len(outside)


def test_simple_rings_agree_with_parity(spark):
    r = random.Random(3)
    rows = []
    for k in range(40):
        n, turn = r.randrange(3, 12), r.choice((-1, 1))
        from math import cos, pi, sin

        ring = [{"x": (2 + r.random()) * cos(turn * 2 * pi * i / n), "y": (2 + r.random()) * sin(turn * 2 * pi * i / n)} for i in range(n)]
        rows += [(ring, r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(20)]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>, x double, y double")
    assert df.where(geo.in_selection(F.col("x"), F.col("y"), F.col("ring")) != geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).count() == 0
    assert df.where(geo.no_area(F.col("ring"))).count() == 0


def test_areas_of_rings(spark):
    ring = lambda *v: [{"lon": float(a), "lat": float(b)} for a, b in v]
    rows = [("octant", ring((0, 0), (90, 0), (0, 90))), ("small", ring((10, 50), (10.01, 50), (10.01, 50.01), (10, 50.01))), ("over 180", ring((179.995, -0.005), (-179.995, -0.005), (-179.995, 0.005), (179.995, 0.005))), ("at 0", ring((-0.005, -0.005), (0.005, -0.005), (0.005, 0.005), (-0.005, 0.005))), ("two", ring((0, 0), (1, 1))), ("reverse", ring((0, 90), (90, 0), (0, 0)))]
    got = {r["k"]: r for r in spark.createDataFrame(rows, "k string, ring array<struct<lon:double,lat:double>>").select("k", geo.drawn_area_m2(F.col("ring")).alias("d"), geo.spherical_area_m2(F.col("ring")).alias("s")).collect()}
    from math import cos, pi, radians

    assert abs(got["octant"]["s"] / (pi / 2 * geo.RADIUS_M**2) - 1) < 1e-9 and abs(got["reverse"]["s"] / got["octant"]["s"] - 1) < 1e-9
    flat = (radians(0.01) * geo.RADIUS_M) ** 2 * cos(radians(50.005))
    assert abs(got["small"]["s"] / flat - 1) < 1e-6 and abs(got["small"]["d"] / (flat * (geo.A / geo.RADIUS_M) ** 2) - 1) < 1e-6
    assert abs(got["over 180"]["s"] / got["at 0"]["s"] - 1) < 1e-6 and abs(got["over 180"]["d"] / got["at 0"]["d"] - 1) < 1e-6 and got["two"]["s"] == got["two"]["d"] == 0


def test_assumptions_and_warnings(spark):
    r = spark.range(1).select(layers.assumptions(Params()).alias("a"), layers.warnings(F.lit("x"), F.lit(None).cast("string")).alias("w")).first()
    assert r["a"]["score_weights"]["catchment"] == 0.35 and r["w"] == ["x"]
