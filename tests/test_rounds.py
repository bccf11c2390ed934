"""Steps that work by rounds of joins against their plain forms: spill heights, thinning, catchments, gaps."""

import random

import pytest
from pyspark.sql import functions as F

from catchwater.operators import flow, sites, terrain
from catchwater.params import Params
from tests.test_operators import back, flood, grid


@pytest.mark.parametrize("seed,levels,most", [(1, 1000, 0), (2, 5, 10)])
def test_contracted_fill_equals_flood(spark, seed, levels, most):
    r = random.Random(seed)
    zs = [[[float(r.randrange(levels)) for _ in range(19)] for _ in range(14)] for _ in range(2)]
    both = terrain.fill_depressions(grid(spark, zs[0], 0).union(grid(spark, zs[1], 1)), most=most)
    for k in (0, 1):
        assert back(both.where(F.col("scenario") == k), "filled") == flood(zs[k])


def test_contraction_halves_basins(spark):
    r = random.Random(9)
    z = [[float(r.randrange(1000)) for _ in range(30)] for _ in range(30)]
    passes = {}
    for i in range(28):
        for j in range(28):
            a, b = i * 28 + j, (i * 28 + j + 1) if j < 27 else -1
            passes[min(a, b), max(a, b)] = z[i][j]
            if i < 27:
                passes[a, a + 28] = z[j][i]
    df = spark.createDataFrame([(0, a, b, h) for (a, b), h in passes.items()], "scenario int, a long, b long, height double")
    sizes = [t.count() for t in terrain.lowest_ways(df, 0)]
    assert sizes[-1] == 0 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:])) and sum(sizes) <= 2 * 784
    want = {r["basin"]: r["spill"] for r in terrain.spills(df).collect()}
    assert len(want) == 784 and {r["basin"]: r["spill"] for r in terrain.spills(df, 0).collect()} == want


@pytest.mark.parametrize("lat,lon,spread", [(21.3, 81.2, 0.02), (89.995, 0.0, 180.0), (-0.001, 179.999, 0.02), (60.0, 10.0, 0.0)])
def test_thinning_in_rounds_equals_greedy(spark, lat, lon, spread):
    r = random.Random(4)
    pts = [(s, k // 20, k % 20, r.randrange(5), r.choice(["depression", "flow_convergence"]), min(90.0, lat + r.random() * min(spread, 0.02)), (lon + (r.random() - 0.5) * 2 * spread + 180) % 360 - 180) for s in range(2) for k in range(300)]
    seeds = spark.createDataFrame(pts, "scenario int, row int, col int, acc int, seed_type string, latitude double, longitude double")
    rows = lambda most: sorted(map(tuple, sites.thin(seeds, Params(), most).select("scenario", "seq", "row", "col").collect()))
    got = rows(0)
    kept, by = [], {}
    for p in sorted(pts, key=lambda p: (p[0], -p[3], p[4], p[1], p[2])):
        from math import asin, cos, radians, sin, sqrt

        near = lambda q: 2 * 6371000.0 * asin(min(1, sqrt(sin(radians(p[5] - q[5]) / 2) ** 2 + cos(radians(p[5])) * cos(radians(q[5])) * sin(radians(p[6] - q[6]) / 2) ** 2))) < 100
        if not any(near(q) for q in kept if q[0] == p[0]):
            kept.append(p)
            by[p[0]] = by.get(p[0], 0) + 1
    want = []
    for s in (0, 1):
        want += [(s, k, p[1], p[2]) for k, p in enumerate((p for p in kept if p[0] == s), 1)]
    assert got == sorted(want)
    assert rows(10**6) == got


@pytest.mark.parametrize("block", [1024, 3])
def test_catchments_are_what_flows_through(spark, block):
    r = random.Random(5)
    z = [[float(r.randrange(60)) + 0.3 * (i + j) for j in range(16)] for i in range(13)]
    f = flow.direction(grid(spark, z).union(grid(spark, [[float(i + j) for j in range(6)] for i in range(6)], 1)), "z")
    step = {(x["scenario"], x["row"], x["col"]): x["direction"] for x in f.collect()}
    members = {}
    for (s, i, j) in step:
        at = (s, i, j)
        while at:
            members.setdefault((s, (at[1] << 32) + at[2]), set()).add((i, j))
            d = step[at]
            at = (s, at[1] + terrain.D8[d][0], at[2] + terrain.D8[d][1]) if d >= 0 else None
    points = f.select("scenario", "row", "col")
    got = {}
    rows = flow.catchments(f, points.union(points), block).collect()
    for x in rows:
        got.setdefault((x["scenario"], x["pour"]), set()).add((x["row"], x["col"]))
    assert got == members and len(rows) == sum(map(len, members.values()))
    tour = flow.tour(flow.accumulation(f)).collect()
    assert len(tour) == len(step) and all(0 <= x["first"] for x in tour)


@pytest.mark.parametrize("seed,share", [(1, 0.5), (2, 0.9), (3, 0.99), (4, 0.05)])
def test_gaps_take_the_nearest(spark, seed, share):
    r = random.Random(seed)
    z = {(s, i, j): None if r.random() < share else float(r.randrange(100)) for s in range(2) for i in range(17) for j in range(23)}
    z[0, 3, 4] = 7.0
    df = spark.createDataFrame([(*k, v) for k, v in z.items()], "scenario int, row int, col int, elevation_m double")
    for x in terrain.fill_gaps(df).collect():
        k = x["scenario"], x["row"], x["col"]
        known = [q for q, v in z.items() if v is not None and q[0] == k[0]]
        want = z[k] if z[k] is not None else z[min(known, key=lambda q: ((q[1] - k[1]) ** 2 + (q[2] - k[2]) ** 2, q[1], q[2]))] if known else None
        assert x["elevation_m"] == want, k


def test_nearest_in_row_is_linear_and_exact():
    r = random.Random(6)
    for _ in range(300):
        cols = sorted(r.sample(range(40), r.randrange(1, 12)))
        far = [r.randrange(6) for _ in cols]
        rows = [10 + f * r.choice([-1, 1]) for f in far]
        got = terrain.nearest_in_row(cols, far, rows, list(range(40)))
        assert got == [min(range(len(cols)), key=lambda k: ((c - cols[k]) ** 2 + far[k] ** 2, rows[k], cols[k])) for c in range(40)]
