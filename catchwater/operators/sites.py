"""Candidate sites: seeds, thinning, the filter cascade, scores, ranks, the cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.functions.geo import RADIUS_M, haversine
from catchwater.operators.hydrology import half_up
from catchwater.operators.terrain import CELL, cell_id
from catchwater.params import Params
from catchwater.scratch import written

# The status names and their texts.
ACCEPTED = "accepted"
OUTSIDE_TEXT = "Falls in the DEM's padding margin, outside the area you selected on the map"
CONSTRAINT_TEXT = "Location falls within a buffered building, road, waterway, or power line (OpenStreetMap)"
CAP_TEXT = "Exceeds maximum candidate limit"


def depression_seeds(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Cells more than depression_m below the filled surface that are the lowest of their 5x5 square; where a scenario has none, its first depressed cells in row order.

    cells: elevation_m, filled_m, low (see local_minimum) and acc.
    """
    delta = F.greatest(F.lit(0.0), F.col("filled_m") - F.col("elevation_m"))
    deep = cells.withColumn("depression_delta_m", delta).where(F.col("depression_delta_m") > p.depression_m).withColumn("_low", F.col("elevation_m") == F.col("low"))
    any_low = deep.groupBy("scenario").agg(F.bool_or("_low").alias("_any"))
    first = F.row_number().over(Window.partitionBy("scenario").orderBy("row", "col"))
    fallback = deep.join(any_low.where("NOT _any").select("scenario"), "scenario", "left_semi").withColumn("_k", first).where(F.col("_k") <= p.fallback_seeds).drop("_k")
    return deep.where("_low").unionByName(fallback).drop("_low").withColumn("seed_type", F.lit("depression"))


def convergence_seeds(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Cells whose accumulation reaches the exact percentile of positive ones. A scenario without positive accumulation has none."""
    cut = cells.where("acc > 0").groupBy("scenario").agg(F.percentile("acc", F.lit(p.flow_percentile / 100)).alias("_cut"))
    out = cells.join(cut, "scenario").where("acc >= _cut").drop("_cut")
    return out.withColumn("depression_delta_m", F.greatest(F.lit(0.0), F.col("filled_m") - F.col("elevation_m"))).withColumn("seed_type", F.lit("flow_convergence"))


def merge_seeds(first: DataFrame, then: DataFrame) -> DataFrame:
    """Both; a cell that is in both counts as the first's."""
    return first.unionByName(then.join(first.select(*CELL), CELL, "left_anti"))


def seed_order() -> list[Column]:
    """Most accumulation first; of equals depressions first, each in row order."""
    return [F.col("acc").desc(), F.col("seed_type").asc(), F.col("row").asc(), F.col("col").asc()]


def thin(seeds: DataFrame, p: Params = Params(), most: int = 20_000) -> DataFrame:
    """Greedy thinning in seed order: a seed stays if no kept one is nearer than min_distance_m. With seq from 1.

    Scenarios of up to `most` seeds are a group each, in which kept seeds are looked up in bins; larger ones are thinned by rounds of joins.
    """
    from math import asin, cos, radians, sin, sqrt

    def f(pdf):
        pdf = pdf.sort_values(["acc", "seed_type", "row", "col"], ascending=[False, True, True, True])
        size = p.min_distance_m * 1.001
        kept, bins = [], {}
        for i, (lat, lon) in enumerate(zip(pdf["latitude"], pdf["longitude"])):
            phi, lam = radians(lat), radians(lon)
            x, y, z = (int(RADIUS_M * v // size) for v in (cos(phi) * cos(lam), cos(phi) * sin(lam), sin(phi)))  # cubes of that size, so poles and the antimeridian are places like others
            near = (o for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for c in (z - 1, z, z + 1) for o in bins.get((a, b, c), ()))
            if all(2 * RADIUS_M * asin(sqrt(sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(phi) * sin(radians(lon - lo) / 2) ** 2)) >= p.min_distance_m for la, lo in near):
                kept.append(i)
                bins.setdefault((x, y, z), []).append((lat, lon))
        return pdf.iloc[kept].copy()

    seeds = written(seeds, "seeds")
    large = written(seeds.groupBy("scenario").count().where(F.col("count") > most).select("scenario"), "large")
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in seeds.schema)
    if large.isEmpty():
        kept = seeds.groupBy("scenario").applyInPandas(f, schema)
    else:
        kept = seeds.join(large, "scenario", "left_anti").groupBy("scenario").applyInPandas(f, schema)
        kept = kept.unionByName(thin_in_rounds(written(seeds.join(large, "scenario", "left_semi"), "many"), p))
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("scenario").orderBy(*seed_order())))


def thin_in_rounds(seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """The seeds that greedy thinning keeps, without a group by scenario. seeds: a written table with a row for each cell.

    Seeds nearer than min_distance_m are found once, by points on the sphere in cubes of that size. Each round keeps the seeds before which no undecided one near them
    comes, and drops those near a kept one; pairs with a decided seed leave.
    """
    size = p.min_distance_m
    rank = F.struct((-F.col("acc")).alias("acc"), "seed_type", "row", "col")
    lat, lon = F.radians("latitude"), F.radians("longitude")
    place = {"px": F.cos(lat) * F.cos(lon), "py": F.cos(lat) * F.sin(lon), "pz": F.sin(lat)}
    at = seeds.select("scenario", cell_id().alias("id"), rank.alias("rank"), "latitude", "longitude", *[F.floor(RADIUS_M * v / (size * 1.001)).alias(k) for k, v in place.items()])
    around = F.array(*[F.struct((F.col("px") + i).alias("px"), (F.col("py") + j).alias("py"), (F.col("pz") + k).alias("pz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    later = at.select("scenario", F.col("id").alias("id2"), F.col("rank").alias("rank2"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), F.explode(around).alias("c")).select("*", "c.px", "c.py", "c.pz").drop("c")
    pairs = at.join(later, ["scenario", "px", "py", "pz"]).where(F.col("rank") < F.col("rank2"))
    pairs = written(pairs.where(haversine(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) < size).select("scenario", F.col("id").alias("first"), F.col("id2").alias("then")), "near")
    undecided, kept = at.select("scenario", "id"), []
    while not undecided.isEmpty():
        late = pairs.select("scenario", F.col("then").alias("id")).distinct()
        stay = written(undecided.join(late, ["scenario", "id"], "left_anti"), "kept")
        kept.append(stay)
        gone = pairs.join(stay.withColumnRenamed("id", "first"), ["scenario", "first"], "left_semi").select("scenario", F.col("then").alias("id")).distinct()
        decided = written(stay.union(gone), "decided")
        undecided = written(undecided.join(decided, ["scenario", "id"], "left_anti"), "undecided")
        pairs = written(pairs.join(decided.withColumnRenamed("id", "first"), ["scenario", "first"], "left_anti").join(decided.withColumnRenamed("id", "then"), ["scenario", "then"], "left_anti").select("scenario", "first", "then"), "near")
    ids = reduce(DataFrame.union, kept) if kept else at.select("scenario", "id")
    return seeds.withColumn("id", cell_id()).join(ids, ["scenario", "id"], "left_semi").drop("id")


def evaluated(thinned: DataFrame, p: Params = Params()) -> DataFrame:
    """The first three times max_candidates seeds, numbered C1, C2, ..."""
    return thinned.where(F.col("seq") <= 3 * p.max_candidates).withColumn("candidate_id", F.concat(F.lit("C"), F.col("seq").cast("string")))


def area_km2() -> Column:
    """The catchment of a cell with acc, in a grid whose cells have the side `resolution`."""
    return (F.col("acc") + 1) * (F.col("resolution") * F.col("resolution")) / 1e6


def cascade(sites: DataFrame, p: Params = Params(), outside: Column | None = None, excluded: Column | None = None) -> DataFrame:
    """sites with catchment_area_km2, status and rejection_reason: the first filter that fails wins (slope, selection, land use, catchment)."""
    area = area_km2() if "resolution" in sites.columns else (F.col("acc") + 1) * (p.resolution_m * p.resolution_m) / 1e6
    no = F.lit(False)
    tests = [
        (F.col("slope_deg") > p.max_slope_deg, "rejected_slope", F.concat(F.lit("Slope "), fixed(F.col("slope_deg"), 1), F.lit(f"° exceeds maximum {p.max_slope_deg}°"))),
        (F.coalesce(outside, no) if outside is not None else no, "rejected_outside_selection", F.lit(OUTSIDE_TEXT)),
        (F.coalesce(excluded, no) if excluded is not None else no, "rejected_constraint", F.lit(CONSTRAINT_TEXT)),
        (area < p.min_catchment_km2, "rejected_catchment", F.concat(F.lit("Catchment "), fixed(area, 4), F.lit(f" km² < minimum {p.min_catchment_km2} km²"))),
    ]
    status, reason = F.lit(ACCEPTED), F.lit(None).cast("string")
    for test, name, text in reversed(tests):
        status, reason = F.when(test, name).otherwise(status), F.when(test, text).otherwise(reason)
    out = sites.withColumn("status", status).withColumn("rejection_reason", reason)
    return out.withColumn("catchment_area_km2", F.when(F.col("status").isin(ACCEPTED, "rejected_catchment"), half_up(area, 4)).otherwise(F.lit(0.0)))


def fixed(x: Column, digits: int) -> Column:
    """x as text, rounded half up once, so that engines agree."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))


FACTORS = {"catchment": ("catchment_area_km2", False), "flow": ("acc", False), "slope": ("slope_deg", True), "relief": ("elevation_m", True), "depression": ("depression_delta_m", False)}


def normalised(value: Column, invert: bool, over: Window) -> Column:
    """0 to 100 between the smallest and the largest; 50 for all if they are equal."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    x = (value - lo) / (hi - lo) * 100.0
    return F.when(hi == lo, F.lit(50.0)).otherwise(100.0 - x if invert else x)


def score(sites: DataFrame, p: Params = Params()) -> DataFrame:
    """sites with five factor scores, score and rank; only accepted ones have them, and are held against accepted ones alone."""
    over = Window.partitionBy("scenario", F.col("status") == ACCEPTED)
    ok = F.col("status") == ACCEPTED
    out = sites
    for name, (col, invert) in FACTORS.items():
        out = out.withColumn(f"_{name}", normalised(F.col(col).cast("double"), invert, over))
    total = sum((p.weights[n] * F.col(f"_{n}") for n in list(FACTORS)[1:]), p.weights["catchment"] * F.col("_catchment"))
    out = out.withColumn("score", F.when(ok, half_up(total, 1)))
    for name in FACTORS:
        out = out.withColumn(f"{name}_score", F.when(ok, half_up(F.col(f"_{name}"), 1))).drop(f"_{name}")
    return out.withColumn("rank", F.when(ok, F.row_number().over(over.orderBy(F.col("score").desc(), "seq"))))


def reasoning() -> Column:
    """The texts that explain a site."""
    area, acc, slope, deep = F.col("catchment_area_km2"), F.col("acc"), F.col("slope_deg"), F.col("depression_delta_m")
    fmt = lambda a, c, b: F.concat(F.lit(a), fixed(c, 1), F.lit(b))
    # The texts and their thresholds.
    return F.array_compact(F.array(
        F.concat(F.when(area >= 1.0, "Large").when(area >= 0.5, "Moderate").otherwise("Small"), F.lit(" contributing catchment ("), fixed(area, 2), F.lit(" km²)")),
        F.when(acc > 1000, "Strong drainage convergence point").when(acc > 200, "Moderate drainage convergence"),
        F.when(slope < 5, fmt("Very gentle slope (", slope, "°) — well suited for pond construction")).when(slope < 10, fmt("Gentle slope (", slope, "°) — suitable for construction")).otherwise(fmt("Moderate slope (", slope, "°) — construction feasible but requires assessment")),
        F.when(deep > 0.5, fmt("Terrain naturally forms a depression (depth ≈ ", deep, " m)")),
        fmt("Elevation: ", F.col("elevation_m"), " m above mean sea level"),
        F.concat(F.lit("Candidate seed type: "), F.regexp_replace("seed_type", "_", " ")),
    ))


def cap(sites: DataFrame, p: Params = Params()) -> DataFrame:
    """Accepted sites beyond max_candidates, in candidate order (cap_by "rank": in rank order), become rejected_duplicate; they keep score and rank."""
    ok = F.col("status") == ACCEPTED
    k = F.row_number().over(Window.partitionBy("scenario", ok).orderBy("seq" if p.cap_by == "seq" else "rank"))
    out = sites.withColumn("_over", ok & (k > p.max_candidates))
    return out.withColumn("status", F.when(F.col("_over"), "rejected_duplicate").otherwise(F.col("status"))).withColumn("rejection_reason", F.when(F.col("_over"), CAP_TEXT).otherwise(F.col("rejection_reason"))).drop("_over")

