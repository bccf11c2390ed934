"""The whole analysis of many areas in one job: from contour uploads or drawn areas and provider tables to the response of each.

Every step keeps `scenario` in its key and each grid's own resolution in a column. Providers are given as functions from the
points, boxes or places that are asked for to tables, so executors read tables and call nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.functions.geo import bbox_area_km2, from_utm, in_selection, no_area, to_utm, turn_at_top, utm_zone
from catchwater.operators import flow, hydrology, interpolate, layers, sites, terrain
from catchwater.params import Params
from catchwater.scratch import written
from catchwater.sources import contours, payloads, providers

Provider = Callable[[DataFrame], DataFrame]
# Texts of warnings and errors.
NO_SITES = "No valid pond candidates found after applying terrain/catchment filters. Consider adjusting MAX_SLOPE_DEG or MIN_CATCHMENT_KM2 in settings."
NO_RAIN = "Historical rainfall is unavailable, so expected water volume and pond storage could not be estimated. "
NO_WAYS = "Land-use constraint checking (buildings/roads/rivers) was skipped: Land-use constraint data is temporarily unavailable (could not reach Overpass)."
TOO_LARGE = "Selected area (~%.1f km²) exceeds the maximum allowed ({most} km²). Please draw a smaller area."
NO_HEIGHTS = "Elevation data unavailable for %d/%d grid cells. The elevation provider may be down; try again shortly or draw a smaller area."
COARSENED = "Selected area required coarsening DEM resolution from %.0f m to %.0f m to bound elevation API usage (%d → %d cells)."
FILLED = "%d of %d elevation samples were unavailable and were filled using nearest-neighbour interpolation."

REPEATED, FEW_POINTS = "several areas have this scenario", "a polygon needs three or more pairs of longitude and latitude"
BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def placed(boxes: DataFrame) -> DataFrame:
    """boxes (scenario, min_lon, min_lat, max_lon, max_lat) with center_lon, center_lat, the UTM zone of the centre, and the box in metres: its south-western and north-eastern corners projected."""
    out = boxes.withColumns({"center_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2})
    out = out.withColumns({"zone": utm_zone(F.col("center_lon")), "south": F.col("center_lat") < 0})
    for name, lon, lat in (("min", "min_lon", "min_lat"), ("max", "max_lon", "max_lat")):
        x, y = to_utm(F.col(lon), F.col(lat), F.col("zone"), F.col("south"))
        out = out.withColumns({f"{name}_x": x, f"{name}_y": y})
    return out


def located(cells: DataFrame) -> DataFrame:
    """Cells (x, y, zone, south) with longitude and latitude."""
    lon, lat = from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return cells.withColumns({"longitude": lon, "latitude": lat})


def projected(points: Column, zone: Column, south: Column) -> Column:
    """An array of structs lon and lat as one of structs x and y."""

    def one(v: Column) -> Column:
        x, y = to_utm(v["lon"], v["lat"], zone, south)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def grid_box(spec: DataFrame) -> DataFrame:
    """(scenario, min_lon, ...) of whole grids: their north-western and south-eastern corners projected back."""
    corner = lambda x, y: from_utm(x, y, F.col("zone"), F.col("south"))
    (lon0, lat1), (lon1, lat0) = corner(F.col("origin_x"), F.col("origin_y")), corner(F.col("origin_x") + F.col("cols") * F.col("resolution"), F.col("origin_y") - F.col("rows") * F.col("resolution"))
    return spec.select("scenario", F.least(lon0, lon1).alias("min_lon"), F.least(lat0, lat1).alias("min_lat"), F.greatest(lon0, lon1).alias("max_lon"), F.greatest(lat0, lat1).alias("max_lat"))


def contour_terrain(lines: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spec, cells with elevation_m, info) of contour lines (scenario, seq, elevation_m, coordinates array<struct<lon,lat>>): densified, projected and interpolated; gaps take the nearest value."""
    box = contours.summary(lines, "scenario")
    spec = written(terrain.grid_spec(placed(box), p), "spec")
    vertex = lines.join(spec.select("scenario", "zone", "south"), "scenario").select("scenario", "seq", "elevation_m", F.posexplode(projected(F.col("coordinates"), F.col("zone"), F.col("south"))).alias("place", "v"))
    samples = terrain.densify(vertex.select(F.struct("scenario", "seq").alias("contour"), F.col("place").alias("seq"), "v.x", "v.y", "elevation_m"), p.densify_m)
    cells = located(terrain.grid_cells(spec))
    surface = interpolate.interpolate(cells, samples.select("contour.scenario", "x", "y", "elevation_m"), p.method)
    cells = terrain.fill_gaps(written(cells.join(surface, terrain.CELL, "left"), "cells"))
    info = box.select("scenario", F.lit("contour_upload").alias("source_type"), *BOX, F.col("contours").alias("contour_count"), "min_elevation_m", "max_elevation_m", F.array().cast("array<string>").alias("warnings"))
    return spec, cells, info


def area_errors(areas: DataFrame, p: Params = Params()) -> DataFrame:
    """areas (scenario, polygon array<array<double>>) with their box and error: why one can't be analysed, or null. Areas that share a scenario are all errors, for their cells could not be told apart."""
    box = contours.polygon_box(F.col("polygon"))
    out = areas.withColumn("_ok", F.coalesce(contours.valid_polygon(F.col("polygon")), F.lit(False))).withColumn("_box", F.when(F.col("_ok"), box)).select(*areas.columns, "_ok", "_box.*")
    km2 = bbox_area_km2(*[F.col(c) for c in BOX])
    text = F.format_string(TOO_LARGE.replace("{most}", f"{p.max_area_km2:.1f}"), km2)
    out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scenario")))
    return out.withColumn("error", F.when(F.col("_n") > 1, REPEATED).when(~F.col("_ok"), FEW_POINTS).when(km2 > p.max_area_km2, text)).drop("_ok", "_n")


def area_terrain(areas: DataFrame, elevation: Provider, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(spec, cells with elevation_m, info, errors) of drawn areas (scenario, polygon, and resolution, if they ask for one).

    elevation: from points (scenario, row, col, longitude, latitude) to (scenario, row, col, elevation), with null or no rows where nothing is
    known. Areas with more than half of their points missing are errors; else gaps take the nearest value.
    """
    checked = written(area_errors(areas, p), "areas")
    spec = written(terrain.coarsen(placed(checked.where("error IS NULL")), p), "spec")
    cells = written(located(terrain.grid_cells(spec)), "points")
    got = elevation(cells.select(*terrain.CELL, "longitude", "latitude"))
    cells = written(cells.join(got.select(*terrain.CELL, F.col("elevation").alias("elevation_m")), terrain.CELL, "left"), "sampled")
    share = written(providers.missing_share(cells.withColumnRenamed("elevation_m", "elevation")), "missing")
    few = F.format_string(NO_HEIGHTS, "missing", "points")
    errors = checked.where("error IS NOT NULL").select("scenario", "error").union(share.where("NOT usable").select("scenario", few.alias("error")))
    usable = share.where("usable")
    cells = terrain.fill_gaps(cells.join(usable.select("scenario"), "scenario", "left_semi"))
    spec = spec.join(usable.select("scenario"), "scenario", "left_semi")
    coarser = F.when(F.col("resolution") > F.col("asked"), F.format_string(COARSENED, "asked", "resolution", "asked_cells", F.col("rows") * F.col("cols")))
    filled = F.when(F.col("missing") > 0, F.format_string(FILLED, "missing", "points"))
    info = spec.join(usable, "scenario").join(grid_box(spec), "scenario")
    none = lambda t: F.lit(None).cast(t)
    info = info.select("scenario", F.lit("selected_area").alias("source_type"), *BOX, none("long").alias("contour_count"), none("double").alias("min_elevation_m"), none("double").alias("max_elevation_m"), layers.warnings(coarser, filled).alias("warnings"))
    return spec, cells, info, errors


def model(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Cells with filled_m, slope_deg, direction, acc and low, written. Directions, slopes and lowest cells share their shuffles."""
    c = terrain.fill_depressions(cells, "elevation_m").withColumnRenamed("filled", "filled_m")
    c = flow.direction(c, "filled_m", "resolution", terrain.gradients("filled_m", "resolution"), terrain.lowest_around("elevation_m"))
    c = written(c.withColumn("slope_deg", terrain.steepness()).drop("_gx", "_gy", "_low"), "directed")
    return written(flow.accumulation(c), "terrain")


def candidates(grid: DataFrame, p: Params = Params(), polygons: DataFrame | None = None, ways: DataFrame | None = None) -> DataFrame:
    """All sites that were looked at, with status, scores and rank, written. polygons: (scenario, polygon) outside which sites are rejected; ways: (scenario, id, type, tags, geometry)."""
    seeds = sites.merge_seeds(sites.depression_seeds(grid, p), sites.convergence_seeds(grid, p))
    found = written(sites.evaluated(sites.thin(seeds, p), p), "candidates")
    outside = banned = None
    zones = grid.groupBy("scenario").agg(F.first("zone").alias("zone"), F.first("south").alias("south"))
    if polygons is not None:  # rings are projected and written once: what is asked of them takes them many times
        ring = projected(F.transform("polygon", lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat"))), F.col("zone"), F.col("south"))
        rings = written(polygons.select("scenario", "polygon").join(zones, "scenario").select("scenario", ring.alias("ring")), "rings")
        rings = written(rings.select("scenario", "ring", turn_at_top(F.col("ring")).alias("turn"), no_area(F.col("ring")).alias("free")), "selections")
        found = found.join(rings, "scenario", "left")
        outside = ~F.col("free") & ~in_selection(F.col("x"), F.col("y"), F.col("ring"), F.col("turn"))
    if ways is not None:
        shapes = providers.classify_ways(ways, by=("scenario",)).join(zones, "scenario").select("scenario", "category", projected(F.col("ring"), F.col("zone"), F.col("south")).alias("path"))
        points = found.select("scenario", F.col("seq").cast("long").alias("point_id"), "x", "y")
        hit = providers.excluded(points, shapes, p).select("scenario", F.col("point_id").cast("int").alias("seq"), F.lit(True).alias("banned"))
        found, banned = found.join(hit, ["scenario", "seq"], "left"), F.col("banned")
    out = sites.cap(sites.score(sites.cascade(found, p, outside, banned), p), p)
    return written(out.withColumn("reasoning", F.when(F.col("score").isNotNull(), sites.reasoning())).drop("ring", "turn", "free", "banned"), "sites")


def catchment_shapes(grid: DataFrame, spec: DataFrame, found: DataFrame) -> DataFrame:
    """(scenario, row, col, shape): the largest part of each accepted site's catchment as a GeoJSON polygon of longitudes and latitudes."""
    points = found.where("status = 'accepted'").select("scenario", "row", "col")
    rings = flow.boundary(written(flow.catchments(grid, points), "members")).join(spec, "scenario")

    def corner(v: Column) -> Column:
        lon, lat = from_utm(F.col("origin_x") + v["col"] * F.col("resolution"), F.col("origin_y") - v["row"] * F.col("resolution"), F.col("zone"), F.col("south"))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    shape = layers.polygon(F.transform("rings", lambda r: F.transform(r, corner)))
    return rings.select("scenario", F.shiftright("pour", 32).cast("int").alias("row"), F.col("pour").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("col"), shape.alias("shape"))


def respond(spec: DataFrame, grid: DataFrame, found: DataFrame, info: DataFrame, rain: Provider, p: Params = Params(), lines: DataFrame | None = None, landuse: DataFrame | None = None) -> DataFrame:
    """(scenario, status, error, best, runoff and pond fields, warnings, response): a row for each area, with its whole response as JSON.

    rain: from places (scenario, latitude, longitude) to days (site, date, precipitation_sum), site being the scenario. landuse: (scenario,
    usable), where ways were asked for.
    """
    area = written(info.join(spec.select("scenario", "rows", "cols", "resolution"), "scenario").withColumns({"center_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2}), "areas")
    shapes = written(catchment_shapes(grid, spec, found), "shapes")
    full = written(found.join(shapes, ["scenario", "row", "col"], "left"), "shaped")
    at = layers.reference_point(found, area)
    climate = hydrology.climatology(rain(at)).select(F.col("site").alias("scenario"), F.struct("status", F.lit(p.rain_source).alias("source"), "annual_avg_mm", "monthly_avg_mm", F.create_map(F.lit("monsoon_jun_sep"), F.col("monsoon_mm")).alias("seasonal_mm"), "message").alias("rainfall"))
    best = full.where("rank = 1 AND status = 'accepted'").select("scenario", F.struct("candidate_id", F.struct("latitude", "longitude").alias("location"), "elevation_m", "slope_deg", "catchment_area_km2", F.col("shape").alias("catchment_boundary"), "score", "rank", "reasoning").alias("b"))
    nothing = F.struct(F.lit("unavailable").alias("status"), F.lit(p.rain_source).alias("source"), F.lit(None).cast("double").alias("annual_avg_mm"), F.lit(None).cast("map<string,double>").alias("monthly_avg_mm"), F.lit(None).cast("map<string,double>").alias("seasonal_mm"), F.lit("Historical rainfall data could not be retrieved.").alias("message"))
    one = area.join(best, "scenario", "left").join(climate, "scenario", "left").withColumn("rainfall", F.coalesce("rainfall", nothing))
    one = one.withColumns({"annual_avg_mm": F.col("rainfall.annual_avg_mm"), "catchment_area_km2": F.coalesce("b.catchment_area_km2", F.lit(0.0)), "slope_deg": F.col("b.slope_deg")})
    one = written(hydrology.pond(hydrology.runoff(one, p), p), "runoff")
    volumes = one.select("scenario", "annual_runoff_m3", "estimated_storage_m3", "pond_status")
    features = layers.candidate_features(full.join(volumes, "scenario"))
    shape_of = layers.feature(F.col("shape"), F.struct("candidate_id", "rank", F.col("catchment_area_km2").alias("area_km2"), (F.col("rank") == 1).alias("is_recommended")))
    whole = [layers.features_of(features, "feature", ["seq"], "candidates_json"), layers.features_of(full.where("status = 'accepted' AND shape IS NOT NULL").withColumn("feature", shape_of), "feature", ["seq"], "catchments")]
    if lines is not None:
        whole.append(layers.features_of(lines.withColumn("feature", layers.feature(layers.line(F.col("coordinates")), F.struct("elevation_m", "contour_id"))), "feature", ["seq"], "contours"))
    listed = layers.listed(full)
    stats = terrain.terrain_stats(grid)
    for t in (*whole, listed, layers.status_counts(found).drop("candidates"), stats.withColumnsRenamed({"min_elevation_m": "z_min", "max_elevation_m": "z_max"})):
        one = one.join(t, "scenario", "left")
    if landuse is not None:
        one = one.join(landuse.select("scenario", F.coalesce("usable", F.lit(False)).alias("ways_usable")), "scenario", "left")
    has = F.coalesce("accepted", F.lit(0)) > 0
    texts = F.concat("warnings", layers.warnings(
        F.when(~F.coalesce("ways_usable", F.lit(False)), NO_WAYS) if landuse is not None else F.lit(NO_WAYS), F.when(~has, NO_SITES), F.when(F.col("rainfall.status") != "success", F.concat(F.lit(NO_RAIN), F.col("rainfall.message")))))
    one = one.withColumn("warnings", texts).withColumn("status", F.when(has, "success").otherwise("partial"))
    return one.select("scenario", "status", F.lit(None).cast("string").alias("error"), "rows", "cols", "resolution", F.coalesce("candidates_n", F.lit(0)).cast("long").alias("candidates"), F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), F.col("b.candidate_id").alias("recommended"),
                      F.col("b.location.latitude").alias("latitude"), F.col("b.location.longitude").alias("longitude"), "annual_runoff_m3", "estimated_storage_m3", "warnings", layers.response(p, lines is not None).alias("response"))


def failed(errors: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of areas that can't be analysed, in the columns of a response."""
    return errors.select("scenario", F.lit("error").alias("status"), "error", *[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields[3:]])


def analyze_contours(marks: DataFrame, rain: Provider, p: Params = Params(), ways: Provider | None = None) -> DataFrame:
    """The responses of uploads (see contours.read_uploads), one for each file; files that can't be read are rows with an error. skipped: how many placemarks of a file are no contours.

    ways: from boxes (scenario, min_lon, ...) to (scenario, body) as the provider responds.
    """
    lines = written(contours.contours(marks).withColumnRenamed("path", "scenario"), "lines")
    spec, cells, info = contour_terrain(lines, p)
    grid = model(cells, p)
    bodies = written(ways(info.select("scenario", *BOX)), "bodies") if ways else None
    found = candidates(grid, p, None, payloads.ways(bodies) if ways else None)
    out = respond(spec, grid, found, info, rain, p, lines, payloads.usable(bodies) if ways else None)
    bad = marks.where("error IS NOT NULL").select(F.col("path").alias("scenario"), "error")
    none = marks.where("error IS NULL").select(F.col("path").alias("scenario")).distinct().join(lines.select("scenario").distinct(), "scenario", "left_anti").select("scenario", F.lit("no contour with an elevation and two vertices").alias("error"))
    skipped = contours.skipped(marks).select(F.col("path").alias("scenario"), (F.col("placemarks") - F.col("used")).alias("skipped"))
    return out.unionByName(failed(bad.union(none), out)).join(skipped, "scenario", "left")


def analyze_areas(areas: DataFrame, elevation: Provider, rain: Provider, p: Params = Params(), ways: Provider | None = None) -> DataFrame:
    """The responses of drawn areas (scenario, polygon, and resolution, if they ask for one); areas that can't be analysed are rows with an error."""
    spec, cells, info, errors = area_terrain(areas, elevation, p)
    grid = model(cells, p)
    drawn = area_errors(areas, p).where("error IS NULL")
    bodies = written(ways(drawn.select("scenario", *BOX)), "bodies") if ways else None
    found = candidates(grid, p, areas, payloads.ways(bodies) if ways else None)
    out = respond(spec, grid, found, info, rain, p, None, payloads.usable(bodies) if ways else None)
    return out.unionByName(failed(errors, out))
