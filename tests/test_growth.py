"""Steps whose cost grew faster than their input, or with copies of it."""

import time

from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from catchwater.operators import terrain
from catchwater.sources import providers, raster


def test_equal_features_and_points_are_compared_once(spark):
    """20,000 copies of a road and 20,000 points at one place aren't 400 million pairs."""
    at = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(100.0).alias("x"), F.lit(0.0).alias("y")))
    features = spark.range(20_000).select(F.lit(0).alias("scenario"), F.lit("road").alias("category"), at.alias("path"))
    points = spark.range(20_001).select(F.lit(0).alias("scenario"), F.col("id").alias("point_id"), F.lit(50.0).alias("x"), F.when(F.col("id") < 20_000, 50.0).otherwise(50.5).alias("y"))
    began = time.time()
    assert {r["point_id"] for r in providers.excluded(points, features).collect()} == set(range(20_000))
    assert time.time() - began < 40


def test_gaps_are_filled_without_windows_to_the_far_end(spark):
    """A frame that ends at the last row is read again for each row, so its cost is the square of a column."""
    cells = spark.range(60).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "CASE WHEN id % 7 = 0 THEN double(id) END AS elevation_m")
    filled = terrain.fill_gaps(cells)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower() and filled.where("elevation_m IS NULL").count() == 0


def test_cells_of_a_raster_are_merged_before_they_are_written(spark, tmp_path, monkeypatch):
    """A group holds a row for each cell of its raster, however many values there are."""
    held, old = [], GroupedData.applyInPandas

    def counted(self, *args):
        held.append(self._df.count())
        return old(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    values = spark.range(4_000).selectExpr("10 + (id % 10 + 0.5D) / 10 AS lon", "(id div 10 % 10 + 0.5D) / 10 AS lat", "CASE WHEN id % 100 <> 7 THEN double(id div 100) + 1 END AS value")
    raster.write_tiles(values, str(tmp_path), 10, 8)
    assert held == [100]
    got = raster.read(spark, str(tmp_path)).collect()
    assert len(got) == 100 and sorted(r["value"] or 0.0 for r in got) == [0.0] + [1.0] * 99


def test_catchments_share_a_batch(spark):
    """Outlines of small catchments, of which there are as many as cells allow, aren't a Python group each."""
    from catchwater.operators import flow

    members = spark.range(400).selectExpr("0 AS scenario", "id div 2 AS pour", "int(id div 2 * 3) AS row", "int(id % 2) AS col")
    got = flow.boundary(members)
    assert "flatmapgroups" not in got._jdf.queryExecution().toString().lower()
    rows = got.collect()
    assert len(rows) == 200 and all(r["cells"] == 2 and len(r["rings"]) == 1 and len(r["rings"][0]) == 7 for r in rows)


def test_a_drawn_ring_is_built_once(spark):
    """What is asked of a ring takes its vertices many times."""
    from catchwater.plans import registry

    plan = registry.QUERIES["drawn_areas"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS ring#") == 1 and plan.count("* 37") == 12  # three for each vertex


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_directions_are_found_once(spark):
    """Accumulation reads directions three times and more; they are written, not found anew each time."""
    from catchwater.operators import flow

    cells = spark.range(30).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "double(id) AS z")
    found = flow.direction(cells, "z")
    acc = flow.accumulation(found)
    assert "Window" in optimized(found) and "Window" not in optimized(acc)
    assert acc.where("row = 0 AND col = 0").first()["acc"] == 29  # all flow to the only lowest cell


def test_directions_slopes_and_lowest_cells_share_two_shuffles(spark):
    from catchwater.operators import flow

    cells = spark.range(30).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "double(id * 7 % 30) AS z")
    both = flow.direction(cells, "z", 30.0, terrain.gradients("z", 30.0), terrain.lowest_around("z")).withColumn("slope_deg", terrain.steepness()).select(*cells.columns, "direction", "slope_deg", "low")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    apart = terrain.local_minimum(terrain.slope(flow.direction(cells, "z"), "z", 30.0), "z")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.select(both.columns).collect()))


def test_filled_cells_are_not_joined_with_what_they_were_made_of(spark):
    """Only spill heights are joined; what runs off to the border, a third of this grid, meets in no task."""
    cells = spark.range(60).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "CASE WHEN id <> 20 THEN double(id * 7 % 30) END AS z", "id AS tag")
    filled = terrain.fill_depressions(cells)
    plan = optimized(filled)
    assert plan.count("Join") == 1 and "Window" not in plan
    assert filled.count() == 60 and filled.where("filled < z OR (z IS NULL) <> (filled IS NULL)").isEmpty() and filled.columns == [*cells.columns, "filled"]


def test_sides_of_catchments_are_not_exploded_into_a_join(spark):
    """Four rows for each cell went through a shuffle; repeated members count as before."""
    from catchwater.operators import flow

    members = spark.createDataFrame([(0, p, r, c) for p in (1, 2) for r, c in [(0, 0), (0, 1), (1, 1), (1, 1), (3, 0)]], "scenario int, pour long, row int, col int")
    got = flow.boundary_edges(members)
    assert "Join" not in optimized(got)
    here = [(0, 0), (0, 1), (1, 1), (1, 1), (3, 0)]
    want = [(0, p, r, c, s) for p in (1, 2) for r, c in here for s, dr, dc in (("N", -1, 0), ("E", 0, 1), ("S", 1, 0), ("W", 0, -1)) if (r + dr, c + dc) not in here]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_tour_takes_sizes_along(spark):
    """Neither its start nor its result is joined with sizes once more."""
    from catchwater.operators import flow

    cells = spark.range(30).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "double(id) AS z")
    tour = flow.tour(flow.accumulation(flow.direction(cells, "z")))
    assert "Join" not in optimized(tour)
    assert tour.count() == 30 and tour.agg(F.max("cells")).first()[0] == tour.groupBy("root").count().agg(F.max("count")).first()[0]


def test_heights_of_long_grids_are_no_ints(spark, tmp_path):
    """At 6 GB a grid has 180,000 rows; 40000 * row passes 2^31 from row 53,687 on."""
    from catchwater.plans import registry, site_queries

    spark.range(300 * 180_000, 300 * 180_012).selectExpr("id AS o_orderkey", "double(id * 7919 % 500000) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 10.0, "2020-01-01"), (2, 20.0, "2021-01-01")], "l_suppkey long, l_quantity double, d string").select("l_suppkey", "l_quantity", F.to_timestamp("d").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["scenario"], r["row"], r["col"]): r["z"] for r in site_queries.surface(spark, str(tmp_path)).collect()}
    want = {(s, r, c): (300 * r + s * (s + 1) // 2 + c) * 7919 % 500000 + 40000 * (r + c) for r in range(180_000, 180_012) for s in range(24) for c in range(s + 1)}
    assert got == want
    counts = {r["scenario"]: r["candidates"] for r in registry.QUERIES["status_counts"](spark, str(tmp_path)).collect()}
    layer = registry.QUERIES["candidate_layer"](spark, str(tmp_path)).groupBy("scenario").count().collect()
    assert counts and counts == {r["scenario"]: r["count"] for r in layer}


def test_a_model_finds_slopes_with_directions(spark, monkeypatch):
    """Four more shuffles of all cells found slopes and lowest cells after accumulation."""
    from catchwater.operators import analysis

    plans, old = {}, analysis.written
    monkeypatch.setattr(analysis, "written", lambda df, name: plans.setdefault(name, optimized(df)) and old(df, name))
    cells = spark.range(60).selectExpr("0 AS scenario", "int(id div 6) AS row", "int(id % 6) AS col", "double(id * 7 % 30) AS elevation_m", "30.0D AS resolution")
    got = analysis.model(cells)
    assert set(plans) == {"directed", "terrain"} and "Window" not in plans["terrain"]
    want = terrain.local_minimum(terrain.slope(terrain.fill_depressions(cells, "elevation_m").withColumnRenamed("filled", "filled_m"), "filled_m", "resolution"), "elevation_m")
    assert sorted(map(tuple, got.select("row", "col", "filled_m", "slope_deg", "low").collect())) == sorted(map(tuple, want.select("row", "col", "filled_m", "slope_deg", "low").collect()))


def test_cells_of_a_grid_are_dealt_to_tasks(spark):
    """A specification stands in one task, and so did all its cells."""
    spec = spark.createDataFrame([(0, 0.0, 0.0, 40, 5, 30.0)], "scenario int, origin_x double, origin_y double, rows int, cols int, resolution double").coalesce(1)
    cells = terrain.grid_cells(spec)
    assert cells.rdd.getNumPartitions() > 1 and cells.count() == 200
