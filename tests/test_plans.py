"""Plans: pruned scans, pushed filters, no Python in native operators, no nested-loop joins over tables."""

import re

from pyspark.sql import functions as F

from catchwater.operators import hydrology, terrain
from catchwater.plans import hydro_queries, registry, site_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan(registry.QUERIES["slope"](spark, SF)))
    assert "l_extendedprice" not in plan(registry.QUERIES["rainfall_monthly"](spark, SF))


def test_filters_reach_the_scan(spark):
    p = plan(hydrology.annual(hydro_queries.daily(spark, SF).where("site = 3")))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_suppkey,3\)", p)


def test_stencils_take_two_shuffles(spark):
    p = plan(terrain.with_neighbours(site_queries.surface(spark, SF)))
    assert p.count("Exchange hashpartitioning") == 2 and not re.search("Python|Pandas|Arrow", p)


def test_no_nested_loops(spark):
    for name in ("exclusion_filter", "elevation_fallback", "rainfall_monthly", "flow_direction", "classify_ways"):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.QUERIES[name](spark, SF))), name


def test_repartitioned_input_gives_the_same(spark):
    s = site_queries.surface(spark, SF)
    a = terrain.fill_depressions(s).groupBy().agg(F.sum(F.xxhash64("row", "col", "filled").cast("decimal(38,0)"))).first()
    b = terrain.fill_depressions(s.repartition(7).orderBy(F.desc("z"))).groupBy().agg(F.sum(F.xxhash64("row", "col", "filled").cast("decimal(38,0)"))).first()
    assert a == b
