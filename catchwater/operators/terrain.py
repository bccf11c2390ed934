"""Grids: specification, cells, stencils, slope, statistics, depression filling, densified contours, gap filling.

A grid is a table of cells (scenario, row, col, ...); row 0 is the northern edge. `scenario` leads every key, so many
areas are one job, and stencils are windows over rows and columns: a task holds single grid lines, never a grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.params import Params
from catchwater.scratch import written

# The eight directions from north clockwise, as (row, col) steps.
D8 = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
CELL = ["scenario", "row", "col"]


def grid_spec(boxes: DataFrame, p: Params = Params()) -> DataFrame:
    """scenario, min_x, min_y, max_x, max_y in metres -> origin_x, origin_y, rows, cols, resolution, and the boxes' zone and south, if they have them.

    Each side is padded by a share of the width or height; ten rows and columns at least. Boxes can ask for a resolution of their own.
    """
    asked = F.coalesce(F.col("resolution"), F.lit(p.resolution_m)) if "resolution" in boxes.columns else F.lit(p.resolution_m)
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    n = lambda side: F.greatest(F.lit(10), F.ceil(side * (1 + 2 * p.padding) / asked)).cast("int")
    own = [c for c in ("zone", "south") if c in boxes.columns]
    return boxes.select("scenario", (F.col("min_x") - w * p.padding).alias("origin_x"), (F.col("max_y") + h * p.padding).alias("origin_y"), n(h).alias("rows"), n(w).alias("cols"), asked.alias("resolution"), *own)


def coarsen(boxes: DataFrame, p: Params = Params()) -> DataFrame:
    """The grid of each box; where it would have more than max_cells cells, one of a coarser resolution: one pass, so it can still slightly exceed that. asked is the resolution before."""
    first = grid_spec(boxes, p)
    total = F.col("rows") * F.col("cols")
    k = F.when(total > p.max_cells, F.sqrt(total / F.lit(float(p.max_cells)))).otherwise(F.lit(1.0))
    finer = first.select("scenario", F.col("resolution").alias("asked"), total.alias("asked_cells"), (F.col("resolution") * k).alias("resolution"))
    return grid_spec(boxes.drop("resolution").join(finer, "scenario"), p).join(finer.drop("resolution"), "scenario")


def grid_cells(spec: DataFrame) -> DataFrame:
    """A row for each cell with its centre, and what the grid's cells share: resolution, zone and south."""
    rows = spec.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    rows = rows.repartition(int(spec.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scenario", "row")  # specifications are few and stand in one task
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    own = [c for c in ("resolution", "zone", "south") if c in spec.columns]
    return cells.select(*CELL, (F.col("origin_x") + (F.col("col") + 0.5) * F.col("resolution")).alias("x"), (F.col("origin_y") - (F.col("row") + 0.5) * F.col("resolution")).alias("y"), *own)


def _along(line: str, place: str) -> Window:
    return Window.partitionBy(line, "scenario").orderBy(place)


def _step(value: Column, place: str, k: int, w: Window) -> Column:
    """value k places on, null where that cell is missing."""
    at = F.lead if k > 0 else F.lag
    return F.when(at(place, abs(k)).over(w) == F.col(place) + k, at(value, abs(k)).over(w))


def stencils(cells: DataFrame, *each: tuple[dict[str, Column], dict[str, Column]]) -> DataFrame:
    """cells with the columns of each stencil: those that look along rows, and from these those that look along columns. Two shuffles, however many stencils there are."""
    out = cells
    for k in (0, 1):
        for s in each:
            out = out.withColumns(s[k])
    return out


def neighbours(value: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Stencil: n0..n7, the values of the eight neighbours; null at edges."""
    w = _along("row", "col")
    sides = {"_w": _step(F.col(value), "col", -1, w), "_e": _step(F.col(value), "col", 1, w)}
    side = {-1: "_w", 0: value, 1: "_e"}
    w = _along("col", "row")
    return sides, {f"n{k}": F.col(side[dc]) if dr == 0 else _step(F.col(side[dc]), "row", dr, w) for k, (dr, dc) in enumerate(D8)}


def with_neighbours(cells: DataFrame, value: str = "z") -> DataFrame:
    """cells with n0..n7, the values of the eight neighbours; null at edges. A grid has a row for each cell, also for one without a value. Two shuffles."""
    return stencils(cells, neighbours(value)).drop("_w", "_e")


def metres(resolution: float | str) -> Column:
    """The side of a cell: a number for all grids, or the name of the column that has each grid's own."""
    return F.col(resolution) if isinstance(resolution, str) else F.lit(float(resolution))


def gradients(value: str, resolution: float | str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Stencil: _gx and _gy, central differences, one-sided at edges; null where a needed value is null."""
    resolution = metres(resolution)

    def gradient(line: str, place: str) -> Column:
        w = _along(line, place)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return F.when(first & last, F.lit(0.0)).when(first, (after - here) / resolution).when(last, (here - before) / resolution).otherwise((after - before) / (2 * resolution))

    return {"_gx": gradient("row", "col")}, {"_gy": gradient("col", "row")}


def steepness() -> Column:
    """Degrees, of gradients."""
    return F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))


def slope(cells: DataFrame, value: str = "z", resolution: float | str = 30.0) -> DataFrame:
    """cells with slope_deg: central differences, one-sided at edges; null where a needed value is null."""
    return stencils(cells, gradients(value, resolution)).withColumn("slope_deg", steepness()).drop("_gx", "_gy")


def lowest_around(value: str, radius: int = 2) -> tuple[dict[str, Column], dict[str, Column]]:
    """Stencil: low, the smallest value in a square around each cell, clipped at edges."""
    along = lambda line, place: _along(line, place).rowsBetween(-radius, radius)
    return {"_low": F.min(value).over(along("row", "col"))}, {"low": F.min("_low").over(along("col", "row"))}


def local_minimum(cells: DataFrame, value: str = "z", radius: int = 2) -> DataFrame:
    """cells with low: the smallest value in a square around each, clipped at edges. Two passes of one dimension."""
    return stencils(cells, lowest_around(value, radius)).drop("_low")


def terrain_stats(cells: DataFrame) -> DataFrame:
    """Elevation statistics of the raw surface, slope statistics of the filled one; nulls are left out."""
    return cells.groupBy("scenario").agg(
        F.min("elevation_m").alias("min_elevation_m"), F.max("elevation_m").alias("max_elevation_m"), F.avg("elevation_m").alias("mean_elevation_m"), (F.max("elevation_m") - F.min("elevation_m")).alias("relief_m"),
        F.min("slope_deg").alias("min_slope_deg"), F.max("slope_deg").alias("max_slope_deg"), F.avg("slope_deg").alias("mean_slope_deg"), F.count("*").alias("cells"),
    )


def cell_id() -> Column:
    return F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")


def labelled(pointers: DataFrame) -> DataFrame:
    """(scenario, id, basin) of the ends of pointers (scenario, id, basin), which are -1 or point to themselves.

    Each round a cell points twice as far. One that has found its end leaves the rounds, so these shrink, and neither -1 nor
    a basin's lowest cell gathers pointers.
    """
    state = pointers.withColumn("done", (F.col("basin") == -1) | (F.col("basin") == F.col("id")))
    settled, active = [state.where("done")], state.where("NOT done")
    while not active.isEmpty():
        to = reduce(DataFrame.union, settled).union(active).select("scenario", F.col("id").alias("basin"), F.col("basin").alias("next"), F.col("done").alias("ended"))
        new = written(active.drop("done").join(to, ["basin", "scenario"]).select("scenario", "id", F.col("next").alias("basin"), F.col("ended").alias("done")), "basins")
        settled.append(new.where("done"))
        active = new.where("NOT done")
    return reduce(DataFrame.union, settled).drop("done")


def lowest_ways(passes: DataFrame, most: int) -> list[DataFrame]:
    """Rounds that contract a graph of passes (scenario, a, b, height; b > a, a of -1: the border), until no scenario has more than `most` of them. Tables (scenario, id, height, up), one of each round, and the passes that are left.

    Each basin takes its lowest pass, ties in order of the basins. Along such ways heights never rise, so those that lead to the border
    (up: -1) spill at their own height, and the others become one basin, named by the lower one of the two that take the same pass; what is in
    it spills at its own height or the whole's, whichever is higher.
    """
    rounds = []
    while True:
        large = passes.groupBy("scenario").count().where(F.col("count") > most).select("scenario")
        large = written(large, "large")
        if large.isEmpty():
            return [*rounds, passes]
        active = passes.join(large, "scenario", "left_semi")
        ends = active.select("scenario", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "a", "b", "height").where("e.id != -1")
        pick = written(ends.groupBy("scenario", F.col("e.id").alias("id")).agg(F.min(F.struct("height", "a", "b", F.col("e.other").alias("other"))).alias("m")).select("scenario", "id", "m.height", "m.other"), "picked")
        back = pick.select("scenario", F.col("id").alias("other"), F.col("other").alias("again"))
        name = F.when((F.col("again") == F.col("id")) & (F.col("id") < F.col("other")), F.col("id")).otherwise(F.col("other"))
        way = written(pick.join(back, ["scenario", "other"], "left").select("scenario", "id", name.alias("basin")), "ways")
        up = written(pick.join(labelled(way), ["scenario", "id"]).select("scenario", "id", "height", F.col("basin").alias("up")), "up")
        rounds.append(up)
        of = lambda end: up.select("scenario", F.col("id").alias(end), F.col("up").alias(f"up_{end}"))
        moved = active.join(of("a"), ["scenario", "a"], "left").join(of("b"), ["scenario", "b"], "left").select("scenario", F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"), "height")
        moved = moved.where("a != b").groupBy("scenario", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("height").alias("height"))
        passes = written(passes.join(large, "scenario", "left_anti").select(moved.columns).union(moved), "passes")


def spills(passes: DataFrame, most: int = 200_000) -> DataFrame:
    """(scenario, basin, spill): the height at which each basin of a graph of passes runs over to the border.

    Graphs of up to `most` passes are a group each, solved with a heap; larger ones are first contracted by rounds of joins until they are no larger.
    """
    kinds = dict(passes.dtypes)

    def spill(pdf):
        import heapq

        import pandas as pd

        near: dict = {}
        for a, b, h in zip(pdf["a"], pdf["b"], pdf["height"]):
            near.setdefault(a, []).append((b, h))
            near.setdefault(b, []).append((a, h))
        done, heap = {}, [(pdf["height"].min(), -1)]
        while heap:
            h, a = heapq.heappop(heap)
            if a in done:
                continue
            done[a] = h
            for b, pass_height in near.get(a, ()):
                if b not in done:
                    heapq.heappush(heap, (max(h, pass_height), b))
        out = pd.DataFrame({"basin": list(done), "spill": list(done.values())})
        out.insert(0, "scenario", pdf["scenario"].iloc[0])
        return out[out["basin"] != -1]

    *rounds, last = lowest_ways(written(passes, "passes"), most)
    found = last.groupBy("scenario").applyInPandas(spill, f"scenario {kinds['scenario']}, basin long, spill {kinds['height']}")
    for up in reversed(rounds):
        whole = found.select("scenario", F.col("basin").alias("up"), "spill")
        inner = up.join(whole, ["scenario", "up"], "left").select("scenario", F.col("id").alias("basin"), F.greatest("height", "spill").alias("spill"))
        found = inner.union(found.join(inner.select("scenario", "basin"), ["scenario", "basin"], "left_anti"))
    return found


def fill_depressions(cells: DataFrame, value: str = "z", most: int = 200_000) -> DataFrame:
    """cells with filled: the lowest surface above value from which every cell has a way to the border that never rises.

    Each inner cell points to its lowest neighbour or itself; pointer jumping finds basins. The lowest pass between
    two basins gives a small graph, of which `spills` gives each basin's spill height.
    Cells without a value keep none and are border to their neighbours.
    """
    near = with_neighbours(cells, value)
    z = F.col(value)
    outside = reduce(lambda a, b: a | b, [F.col(f"n{k}").isNull() for k in range(8)]) | z.isNull()
    near = near.withColumn("_m", F.least(value, *[f"n{k}" for k in range(8)]))
    order = sorted([*enumerate(D8), (None, (0, 0))], key=lambda k: k[1])  # of the lowest the first in row order
    lowest = F.coalesce(*[F.when((z if k is None else F.col(f"n{k}")) == F.col("_m"), F.shiftleft((F.col("row") + dr).cast("long"), 32) + F.col("col") + dc) for k, (dr, dc) in order])
    other = {k: F.when(F.col(f"n{k}").isNotNull() & z.isNotNull(), F.greatest(value, f"n{k}")) for k in range(4)}
    start = near.select(*cells.columns, cell_id().alias("_id"), outside.alias("_border"), F.when(outside, F.lit(-1)).otherwise(lowest).alias("_basin"), *[h.alias(f"_h{k}") for k, h in other.items()])
    start = written(start, "surface")
    at = labelled(start.select("scenario", F.col("_id").alias("id"), F.col("_basin").alias("basin")))
    base = written(start.drop("_basin").join(at.select("scenario", F.col("id").alias("_id"), F.col("basin").alias("_root")), ["_id", "scenario"]), "based")
    near = with_neighbours(base.select(*CELL, "_root", *[f"_h{k}" for k in range(4)]), "_root")
    steps = F.array(*[F.struct(F.least("_root", f"n{k}").alias("a"), F.greatest("_root", f"n{k}").alias("b"), F.col(f"_h{k}").alias("height")) for k in range(4)])
    passes = near.select("scenario", F.inline(steps)).where("height IS NOT NULL AND a != b").groupBy("scenario", "a", "b").agg(F.min("height").alias("height"))
    levels = spills(passes, most).select("scenario", F.col("basin").alias("_root"), F.col("spill").alias("_spill"))
    filled = F.when(F.col("_border") | F.col("_spill").isNull(), F.col(value)).otherwise(F.greatest(value, "_spill"))
    inner = base.where("_root != -1").join(levels, ["_root", "scenario"], "left").select(*cells.columns, filled.alias("filled"))
    return inner.union(base.where("_root = -1").select(*cells.columns, F.col(value).alias("filled")))  # what runs off to the border is in no basin, and would meet in one task


def nearest_in_row(cols: list[int], far: list[int], rows: list[int], wanted: list[int]) -> list[int]:
    """For each wanted column the index of the nearest candidate: candidate k stands in column cols[k], rising, and row rows[k], `far` rows away. Of those equally far the one with the smaller row, then column.

    Squared distances of a candidate are a parabola along the row; those that are lowest somewhere, even at one place, are kept from left to right, and wanted columns pass along them.
    """
    key = [c * c + f * f for c, f in zip(cols, far)]
    hull: list[int] = []
    for k in range(len(cols)):
        while len(hull) > 1:
            i, j = hull[-2:]
            # j is nowhere lowest if k takes over from it strictly before it takes over from i
            if (key[k] - key[j]) * (cols[j] - cols[i]) >= (key[j] - key[i]) * (cols[k] - cols[j]):
                break
            hull.pop()
        hull.append(k)
    out, h = [], 0
    for c in wanted:
        d = lambda k: (c - cols[k]) ** 2 + far[k] * far[k]
        while h + 1 < len(hull) and d(hull[h + 1]) < d(hull[h]):
            h += 1
        g, best = h, hull[h]
        while g + 1 < len(hull) and d(hull[g + 1]) == d(best):
            g += 1
            best = min(best, hull[g], key=lambda k: (rows[k], cols[k]))
        out.append(best)
    return out


def fill_gaps(cells: DataFrame, value: str = "elevation_m") -> DataFrame:
    """Null values get that of the nearest cell with one (ties: the smaller row, then col); a scenario without any keeps its nulls.

    Two passes: windows along columns, each read from both ends, find the nearest value above and below each cell; then the rows that have gaps are a group each, in which every column's nearest
    is weighed, in a time that is linear in the row.
    """
    kind = dict(cells.dtypes)
    above = Window.partitionBy("scenario", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("scenario", "col").orderBy(F.col("row").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one to the far end would be read again for each row
    known = F.when(F.col(value).isNotNull(), F.struct("row", F.col(value).alias("v")))
    near = cells.select(*CELL, value, F.last(known, True).over(above).alias("up"), F.last(known, True).over(below).alias("down"))
    up, down = F.col("row") - F.col("up.row"), F.col("down.row") - F.col("row")
    near = near.select(*CELL, value, F.when(F.col("down").isNull() | (up <= down), F.col("up")).otherwise(F.col("down")).alias("at"))
    gappy = near.where(F.col(value).isNull()).select("scenario", "row").distinct()
    rows = near.select(*CELL, F.col(value).isNull().alias("gap"), F.col("at.row").alias("r"), F.col("at.v").alias("v")).join(gappy, ["scenario", "row"], "left_semi")

    def row(pdf):
        pdf = pdf.sort_values("col")
        have, gap = pdf[pdf["r"].notna()], pdf[pdf["gap"]]
        if not len(have):
            return pdf.iloc[:0][[*CELL, "v"]]
        at = have["r"].astype("int64").tolist()
        here = int(pdf["row"].iloc[0])
        best = nearest_in_row(have["col"].tolist(), [abs(r - here) for r in at], at, gap["col"].tolist())
        return gap[CELL].assign(v=have["v"].to_numpy()[best])

    found = rows.groupBy("scenario", "row").applyInPandas(row, f"scenario {kind['scenario']}, row int, col int, v {kind[value]}").withColumnRenamed("v", "_near")
    return cells.join(found, CELL, "left").withColumn(value, F.coalesce(value, "_near")).select(cells.columns)


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices (contour, seq, x, y, elevation_m) as segments; those without length are left out."""
    w = Window.partitionBy("contour").orderBy("seq")
    pairs = vertices.select("contour", "seq", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), "elevation_m")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    return pairs.where("x2 IS NOT NULL").withColumn("length", length).where("length > 0")


def densify(vertices: DataFrame, step: float = 10.0) -> DataFrame:
    """Samples along each segment, both ends included: max(2, int(length / step)) of them."""
    n = F.greatest(F.lit(2), (F.col("length") / step).cast("int"))
    out = segments(vertices).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    t = F.col("k") / (F.col("n") - 1)
    return out.select("contour", "seq", "k", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), "elevation_m")
