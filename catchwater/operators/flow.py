"""Flow over a grid: direction, edges, in-degree, accumulation, catchments and their boundaries.

Flow is a forest, since a receiver is strictly lower. Accumulation and catchments double their reach each round,
so rounds grow with the logarithm of the longest way.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.operators.terrain import D8, cell_id, metres, neighbours, stencils
from catchwater.scratch import dropped, kept, written


def direction(cells: DataFrame, value: str = "filled", resolution: float | str = 30.0, *more: tuple) -> DataFrame:
    """cells with direction: the steepest of eight drops, the first in order of those equally steep; -1 where nothing is lower. more: stencils that share its shuffles, and whose columns stay."""
    out = stencils(cells, neighbours(value), *more)
    own = [*cells.columns, *[c for s in more for part in s for c in part]]
    far = [metres(resolution) * F.lit(sqrt(2.0) if k % 2 else 1.0) for k in range(8)]
    drop = [F.coalesce(F.when(F.col(f"n{k}") < F.col(value), (F.col(value) - F.col(f"n{k}")) / far[k]), F.lit(0.0)) for k in range(8)]
    out = out.select(*own, *[drop[k].alias(f"_g{k}") for k in range(8)])
    out = out.select("*", F.greatest(*[f"_g{k}" for k in range(8)]).alias("_best"))  # numbers, not structs of drop and direction: those cost several times the windows
    first = F.coalesce(*[F.when(F.col(f"_g{k}") == F.col("_best"), F.lit(k)) for k in range(8)])
    return out.select(*own, F.when(F.col("_best") > 0, first).otherwise(-1).cast("int").alias("direction"))


def edges(flow: DataFrame, *more: Column) -> DataFrame:
    """(scenario, src, dst): a row for each cell that flows on, with more columns of it."""
    dr, dc = (F.element_at(F.array(*[F.lit(d[k]) for d in D8]), F.col("direction") + 1) for k in (0, 1))
    moved = flow.where("direction >= 0").select("scenario", cell_id().alias("src"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), *more)
    return moved.select("scenario", "src", cell_id().alias("dst"), *moved.columns[4:])


def indegree(flow: DataFrame) -> DataFrame:
    """flow with inflows, the number of cells that flow right into each."""
    n = edges(flow).groupBy("scenario", F.col("dst").alias("_id")).agg(F.count("*").alias("n"))
    return flow.withColumn("_id", cell_id()).join(n, ["scenario", "_id"], "left").select(*flow.columns, F.coalesce("n", F.lit(0)).alias("inflows"))


def accumulation(flow: DataFrame) -> DataFrame:
    """flow with acc, the number of cells upstream of each.

    A cell hands what it has gathered to the cell it points to, and then points twice as far. Cells that point to the end of
    a way hand on once more and leave, so rounds shrink, and no outlet gathers pointers in a join. Directions are found once and written.
    """
    flow = kept(flow, "directed")
    e = edges(flow).select("scenario", F.col("src").alias("id"), F.col("dst").alias("next"))
    on = e.select("scenario", F.col("id").alias("next"), F.lit(False).alias("end"))
    active = written(e.join(on, ["next", "scenario"], "left").select("scenario", "id", "next", F.coalesce("end", F.lit(True)).alias("end"), F.lit(1).cast("long").alias("n")), "flow")
    given = []
    while not active.isEmpty():
        got = written(active.groupBy("scenario", F.col("next").alias("id")).agg(F.sum("n").alias("more")), "gathered")
        given.append(got)
        jump = active.select("scenario", F.col("id").alias("next"), F.col("next").alias("after"), F.col("end").alias("after_end"))
        left = active.where("NOT end").join(jump, ["next", "scenario"]).join(got, ["id", "scenario"], "left")
        new = written(left.select("scenario", "id", F.col("after").alias("next"), F.col("after_end").alias("end"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "flow")
        dropped(active)
        active = new
    if not given:
        return flow.withColumn("acc", F.lit(0).cast("long"))
    total = reduce(DataFrame.union, given).groupBy(F.col("id").alias("_id"), "scenario").agg(F.sum("more").alias("acc"))
    return flow.withColumn("_id", cell_id()).join(total, ["_id", "scenario"], "left").select(*flow.columns, F.coalesce("acc", F.lit(0)).alias("acc"))


def tour(flow: DataFrame) -> DataFrame:
    """(scenario, id, root, first, cells): each cell's place in a walk of its outlet's tree and how many cells follow from there that flow through it, itself included. flow: with acc.

    So a catchment is a range of places. A cell stands after its receiver and those of the receiver's other inflows that come before it, with all of theirs; its place adds
    up such steps on its way down. Each round a cell's pointer goes twice as far, and cells whose pointer has met one that is placed leave.
    """
    flow = kept(flow, "accumulated")
    cells = (F.col("acc") + 1).alias("cells")
    outlets = flow.where("direction < 0").select("scenario", cell_id().alias("id"), cells)
    before = Window.partitionBy("up", "scenario").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    step = edges(flow, cells).withColumnsRenamed({"src": "id", "dst": "up"})
    step = step.select("scenario", "id", "up", "cells", (F.coalesce(F.sum("cells").over(before), F.lit(0)) + 1).alias("first"))
    ends = outlets.select("scenario", F.col("id").alias("up"), F.lit(True).alias("ends"))
    state = written(step.join(ends, ["up", "scenario"], "left").select("scenario", "id", "up", "cells", "first", F.coalesce("ends", F.lit(False)).alias("done")), "tour")
    settled, active = [state.where("done")], state.where("NOT done")
    while not active.isEmpty():
        to = reduce(DataFrame.union, settled).union(active).select("scenario", F.col("id").alias("up"), F.col("up").alias("next"), F.col("first").alias("more"), F.col("done").alias("ended"))
        new = written(active.join(to, ["up", "scenario"]).select("scenario", "id", F.col("next").alias("up"), "cells", (F.col("first") + F.col("more")).alias("first"), F.col("ended").alias("done")), "tour")
        settled.append(new.where("done"))
        active = new.where("NOT done")
    placed = reduce(DataFrame.union, settled).select("scenario", "id", F.col("up").alias("root"), "first", "cells")
    return placed.union(outlets.select("scenario", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("first"), "cells"))


def catchments(flow: DataFrame, points: DataFrame, block: int = 1024) -> DataFrame:
    """(scenario, pour, row, col) of each cell that flows through a pour point, and of the point itself. points: (scenario, row, col), nested ones too.

    A catchment is a range in the tour of its outlet's tree, so members come from one join of blocks of places, whatever the catchments' sizes; repeated points count once.
    """
    place = written(tour(flow if "acc" in flow.columns else accumulation(flow)), "places")
    at = points.select("scenario", cell_id().alias("id")).distinct().join(place, ["id", "scenario"])
    block_of = lambda c: F.floor(c / block)
    ranges = at.select("scenario", "root", F.col("id").alias("pour"), F.col("first").alias("lo"), (F.col("first") + F.col("cells")).alias("hi"), F.explode(F.sequence(block_of(F.col("first")), block_of(F.col("first") + F.col("cells") - 1))).alias("block"))
    cells = place.select("scenario", "root", "id", "first", block_of(F.col("first")).alias("block"))
    found = cells.join(ranges, ["root", "block", "scenario"]).where("first >= lo AND first < hi")
    return found.select("scenario", "pour", F.shiftright("id", 32).cast("int").alias("row"), F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("col"))


def boundary_edges(members: DataFrame) -> DataFrame:
    """(scenario, pour, row, col, side) of each cell side between a catchment and what is outside. Sides: N, E, S, W. Cells are looked for along the lines of each catchment's grid, in two shuffles of the cells as they are."""
    step = lambda line, place, k: F.count(F.lit(1)).over(Window.partitionBy("pour", line, "scenario").orderBy(place).rangeBetween(k, k)) > 0
    inner = members.select("scenario", "pour", "row", "col").withColumns({"W": step("row", "col", -1), "E": step("row", "col", 1)}).withColumns({"N": step("col", "row", -1), "S": step("col", "row", 1)})
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("inside")) for s in "NESW"]))
    return inner.select("scenario", "pour", "row", "col", sides).where("NOT inside").drop("inside")


def boundary(members: DataFrame) -> DataFrame:
    """(scenario, pour, rings, cells): the rings of the largest part of each catchment, parts joined by sides; outer ring first, then holes.

    A ring is an array of corner structs (row, col), closed; corners are stitched for one catchment at a time, many catchments in a batch.
    """
    sides = boundary_edges(members).groupBy("scenario", "pour").agg(*[F.collect_list(c).alias(c) for c in ("row", "col", "side")])

    def stitch(row, col, side):
        after: dict = {}
        corner = {"N": ((0, 0), (0, 1)), "E": ((0, 1), (1, 1)), "S": ((1, 1), (1, 0)), "W": ((1, 0), (0, 0))}
        for r, c, s in sorted(zip(row.tolist(), col.tolist(), side.tolist())):
            (a, b), (d, e) = corner[s]
            after.setdefault((r + a, c + b), []).append((r + d, c + e))
        rings = []
        while after:
            start = min(after)
            ring, here, came = [start], start, None
            while True:
                out = after[here]
                step = out[0]
                if len(out) > 1 and came is not None:  # two parts touch in a corner: turn right, so that parts stay apart
                    right = (here[0] + came[1], here[1] - came[0])
                    step = right if right in out else out[0]
                out.remove(step)
                if not out:
                    del after[here]
                came = (step[0] - here[0], step[1] - here[1])
                here = step
                ring.append(here)
                if here == start:
                    break
            rings.append(ring)
        area = lambda ring: sum(b[0] * a[1] - a[0] * b[1] for a, b in zip(ring, ring[1:])) / 2
        outer = [r for r in rings if area(r) > 0]
        best = max(outer, key=lambda r: (area(r), [-x for x in r[0]]))

        def holds(p):
            y, x = p[0] + 0.5, p[1] + 0.5
            return sum((a[0] > y) != (b[0] > y) and a[1] > x for a, b in zip(best, best[1:])) % 2 == 1

        holes = [r for r in rings if area(r) < 0 and holds(min(r))]
        cells = int(area(best) + sum(map(area, holes)))
        return [[{"row": a, "col": b} for a, b in r] for r in (best, *holes)], cells

    def each(batches):
        for pdf in batches:
            rings, cells = zip(*map(stitch, pdf["row"], pdf["col"], pdf["side"])) if len(pdf) else ((), ())
            yield pdf[["scenario", "pour"]].assign(rings=list(rings), cells=list(cells))

    kind = dict(members.dtypes)["scenario"]
    return sides.mapInPandas(each, f"scenario {kind}, pour long, rings array<array<struct<row:int,col:int>>>, cells long")
