"""The whole analysis: drawn areas and contour uploads, with providers given as tables."""

import json

import pytest
from pyspark.sql import functions as F

from catchwater.operators import analysis
from catchwater.params import Params
from catchwater.sources import contours, payloads

LAT, LON = 21.2632, 81.2828


def bowl(points):
    d = F.pow(F.col("latitude") - LAT, 2) + F.pow(F.col("longitude") - LON, 2)
    return points.select("scenario", "row", "col", (100 + d * 300000).alias("elevation"))


def rainy(spark):
    days = spark.createDataFrame([("2023-06-01", 200.0), ("2023-07-01", 250.0), ("2024-06-01", 210.0), ("2024-07-01", 240.0)], "d string, precipitation_sum double").withColumn("date", F.to_date("d"))
    return lambda at: at.select(F.col("scenario").alias("site")).crossJoin(days).select("site", "date", "precipitation_sum")


def square(half, lon=LON, lat=LAT):
    return [[lon - half, lat - half], [lon + half, lat - half], [lon + half, lat + half], [lon - half, lat + half]]


def test_areas(spark):
    areas = spark.createDataFrame([("bowl", square(0.003)), ("wide", square(0.012)), ("huge", square(0.5)), ("bad", square(0.003)[:2]), ("dry", square(0.003, 10.0, -5.0)), ("twice", square(0.003)), ("twice", square(0.004))], "scenario string, polygon array<array<double>>")

    def elevation(points):
        e = bowl(points)
        return e.withColumn("elevation", F.when((F.col("scenario") == "dry") | ((F.col("scenario") == "wide") & (F.col("col") % 10 == 0)), None).otherwise(F.col("elevation")))

    got = {r["scenario"]: r for r in analysis.analyze_areas(areas, elevation, rainy(spark)).collect()}
    assert set(got) == {"bowl", "wide", "huge", "bad", "dry", "twice"}
    assert {k for k, r in got.items() if r["status"] == "error"} == {"huge", "bad", "dry", "twice"} and got["twice"]["error"] == analysis.REPEATED
    assert "exceeds the maximum" in got["huge"]["error"] and "unavailable for" in got["dry"]["error"]
    r = json.loads(got["bowl"]["response"])
    assert got["bowl"]["status"] == r["status"] == "success" and r["recommended"]["rank"] == 1
    assert r["terrain"]["dem_resolution_m"] == 30 == r["assumptions"]["dem_resolution_m"] and r["rainfall"]["annual_avg_mm"] == 450.0
    assert r["runoff"]["annual_runoff_m3"] == got["bowl"]["annual_runoff_m3"] > 0 and r["pond"]["status"] == "success"
    at = r["recommended"]["location"]
    assert abs(at["latitude"] - LAT) < 0.003 and abs(at["longitude"] - LON) < 0.003
    ring = r["geojson_layers"]["catchment_boundaries"]["features"][0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and all(abs(x - LON) < 0.01 and abs(y - LAT) < 0.01 for x, y in ring)
    assert len(r["candidates"]) == r["all_candidates_count"] == len(r["geojson_layers"]["candidates"]["features"])
    assert r["geojson_layers"]["recommended_location"]["properties"]["volume_status"] == "success"
    assert r["geojson_layers"]["contour_lines"]["features"] == [] and any("skipped" in w for w in r["warnings"])
    w = json.loads(got["wide"]["response"])
    assert w["terrain"]["dem_resolution_m"] > 30 and w["terrain"]["grid_rows"] * w["terrain"]["grid_cols"] < 2800
    assert any("coarsening" in x for x in w["warnings"]) and any("nearest-neighbour" in x for x in w["warnings"])


def test_selection_and_ways(spark):
    areas = spark.createDataFrame([("a", square(0.003))], "scenario string, polygon array<array<double>>")
    road = {"elements": [{"type": "way", "id": 1, "tags": {"highway": "x"}, "geometry": [{"lat": LAT, "lon": LON - 0.01}, {"lat": LAT, "lon": LON + 0.01}]}, {"type": "relation", "id": 2}]}
    ways = lambda boxes: boxes.select("scenario", F.lit(json.dumps(road)).alias("body"))
    got = json.loads(analysis.analyze_areas(areas, bowl, rainy(spark), ways=ways).first()["response"])
    near = [c for c in got["candidates"] if abs(c["location"]["latitude"] - LAT) < 0.0003]
    assert near and all(c["status"] in ("rejected_constraint", "rejected_slope") for c in near) and not any("skipped" in w for w in got["warnings"])
    broken = lambda boxes: boxes.select("scenario", F.lit("<html>").alias("body"))
    got = json.loads(analysis.analyze_areas(areas, bowl, lambda at: rainy(spark)(at).limit(0), ways=broken).first()["response"])
    assert any("skipped" in w for w in got["warnings"]) and any("rainfall is unavailable" in w for w in got["warnings"]) and got["runoff"]["annual_runoff_m3"] is None


def test_contour_uploads(spark):
    import math

    marks = [("bowl.kml", None, None, None, None, None)][:0]
    for k, r in enumerate((0.0004, 0.0009, 0.0014, 0.002, 0.0026, 0.003)):
        ring = " ".join(f"{LON + r * math.cos(t / 12 * math.pi)},{LAT + r * math.sin(t / 12 * math.pi)}" for t in range(25))
        marks.append(("bowl.kml", k, str(k), f"{100 + r * r * 300000:.3f} m", ring, None))
    marks += [("text.kml", 0, None, "abc", "1,1 2,2", None), ("bad.kml", None, None, None, None, "ParseError: x")]
    df = spark.createDataFrame(marks, contours.SCHEMA)
    got = {r["scenario"]: r for r in analysis.analyze_contours(df, rainy(spark), Params(min_catchment_km2=0.0005)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"bowl.kml": "success", "text.kml": "error", "bad.kml": "error"}
    r = json.loads(got["bowl.kml"]["response"])
    assert r["input"]["contour_count"] == 6 and len(r["geojson_layers"]["contour_lines"]["features"]) == 6
    at = r["recommended"]["location"]
    assert abs(at["latitude"] - LAT) < 0.004 and abs(at["longitude"] - LON) < 0.004


def test_payloads(spark):
    pts = [(21.0, 81.0), (21.5, 81.5)]
    rows = [(1, pts, '{"results":[{"lat":21.0,"lon":81.0,"elevation":111.0},{"lat":22.0,"lon":81.5,"elevation":null}]}'), (2, pts, '{"results":[{"elevation":1}]}'), (3, pts, "no json"), (4, pts, None)]
    df = spark.createDataFrame(rows, "request int, points array<struct<lat:double,lon:double>>, body string")
    got = sorted((r["request"], r["k"], r["elevation"], r["moved"]) for r in payloads.elevations(df).collect() if r["request"] < 2)
    assert got == [(1, 0, 111.0, False), (1, 1, None, True)]
    assert {r["elevation"] for r in payloads.elevations(df).where("request > 1").collect()} == {None} and payloads.elevations(df).count() == 8
    rain = spark.createDataFrame([("a", '{"daily":{"time":["2023-06-01","2024-06-02"],"precipitation_sum":[10,20.5]}}'), ("b", '{"daily":{"time":["2023-06-01"],"precipitation_sum":[]}}'), ("c", "{}")], "site string, body string")
    assert [(r["site"], str(r["date"]), r["precipitation_sum"]) for r in payloads.rain(rain).orderBy("site", "date").collect()] == [("a", "2023-06-01", 10.0), ("a", "2024-06-02", 20.5), ("b", "None", None), ("c", "None", None)]
    cache = spark.createDataFrame([("k", 1, True, "old"), ("k", 2, True, "new"), ("k", 3, False, "bad")], "key string, at int, ok boolean, body string")
    assert payloads.cached(spark.createDataFrame([("k",), ("m",)], "key string"), cache, "key").orderBy("key").collect()[0]["body"] == "new"


def test_projection_is_that_of_published_values(spark):
    """Eastings on the central meridian and a meridian arc of published length (0 to 45 degrees: 4,984,944.378 m on WGS84)."""
    from catchwater.functions import geo

    one = lambda lon, lat: spark.range(1).select(*geo.to_utm(F.lit(lon), F.lit(lat), F.lit(31), F.lit(False))).first()
    x, y = one(3.0, 45.0)
    assert abs(x - 500000) < 1e-6 and abs(y - 0.9996 * 4984944.378) < 1e-3
    x, y = one(3.0, 90.0 - 1e-9)
    assert abs(y - 0.9996 * 10001965.729) < 2e-3


@pytest.mark.parametrize("cells", [100, 2500])
def test_grids_are_coarsened_to_a_bound(spark, cells):
    from catchwater.operators import terrain

    box = analysis.placed(spark.createDataFrame([(1, 81.0, 21.0, 81.05, 21.04), (2, -60.01, -10.01, -60.0, -10.0)], "scenario int, min_lon double, min_lat double, max_lon double, max_lat double"))
    for r in terrain.coarsen(box, Params(max_cells=cells)).collect():
        assert r["rows"] * r["cols"] <= cells * 1.3 + 60 and r["resolution"] >= 30 and r["asked"] == 30
