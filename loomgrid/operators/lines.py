"""Polylines: runs of clipped segments, and the line nearest to a point."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.scalars import EPS
from loomgrid.functions.segments import clip_open, nearest_on
from loomgrid.operators.grid_join import FINEST, with_cells
from loomgrid.operators.noding import nested
from loomgrid.operators.shared import cut


def clip_runs(segments: DataFrame, keys: list[str], seq: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Clipped segments with `piece`, the run of segments that follow each other without leaving the bounds; pieces of a key count
    from 1. A run never joins across a part that is out of view."""
    ends = [F.col(n) for n in ("ax", "az", "bx", "bz")]
    told = segments.withColumn("c", clip_open(*ends, *bounds)).where("c is not null")
    along = Window.partitionBy(*keys).orderBy(seq)
    whole_start = (F.col("c.ax") == F.col("ax")) & (F.col("c.az") == F.col("az"))
    whole_end = (F.col("c.bx") == F.col("bx")) & (F.col("c.bz") == F.col("bz"))
    told = told.withColumn("s", whole_start).withColumn("e", whole_end)
    joins = (F.lag(seq).over(along) == F.col(seq) - 1) & F.lag("e").over(along) & F.col("s")
    told = told.withColumn("gap", F.when(joins, 0).otherwise(1))
    return told.withColumn("piece", F.sum("gap").over(along)).select(*keys, seq, "piece", "c.*")


def run_points(runs: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a piece with its points in order."""
    grouped = runs.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct(seq, "ax", "az", "bx", "bz"))).alias("s"))
    first = F.transform(F.slice("s", 1, 1), lambda s: F.struct(s["ax"].alias("x"), s["az"].alias("z")))
    return grouped.select(*keys, "piece", F.concat(first, F.transform("s", lambda s: F.struct(s["bx"].alias("x"), s["bz"].alias("z")))).alias("pts"))


def nearest_lines(points: DataFrame, lines: DataFrame, reach: float, growth: float = 3.0) -> DataFrame:
    """(pid, line, d) of points (pid, px, pz): the nearest of lines (line, ax, az, bx, bz), of equals the smallest. Points that find
    nothing within reach look further in the next round, `growth` times as far, until all have found a line; the first round looks as
    far as a few lines lie. Without lines, and for points whose coordinates aren't finite numbers, there are no rows; lines with such
    coordinates take no part. Of lines that lie in each other the longest is looked for; those in the nearest of them then decide."""
    finite = lambda *names: reduce(and_, ((F.abs(n) < float("inf")) & ~F.isnan(n) for n in names))
    points, lines = points.where(finite("px", "pz")), lines.where(finite("ax", "az", "bx", "bz"))
    longest, members = nested(lines.select(F.col("line").alias("sid"), F.lit(0).alias("level"), "ax", "az", "bx", "bz"))
    members = members.select("cid", F.col("sid").alias("line"), "ax", "az", "bx", "bz")
    ends = longest.selectExpr("stack(2, ax, az, bx, bz) as (x, z)").unionAll(points.select("px", "pz"))
    span = ends.agg(F.max("x") - F.min("x"), F.max("z") - F.min("z")).first()
    farthest = sum(s or 0.0 for s in span)  # no two ends lie further apart
    total = longest.agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")))).first()[0] or 0.0
    # as far as a few lines lie, if that is nearer
    few = 2 * (span[0] or 0.0) * (span[1] or 0.0) / total if total else reach
    reach = max(min(reach, few), reach / 2**FINEST)
    found = []
    left = points
    while True:
        cells = _walked(longest, reach)
        around = with_cells(left, F.col("px") - reach, F.col("pz") - reach, F.col("px") + reach, F.col("pz") + reach, reach, "l__").drop("l__x0", "l__z0")
        met = around.join(cells.hint("merge"), ["cx__", "cz__"]).withColumn("d", nearest_on(*(F.col(n) for n in ("px", "pz", "ax", "az", "bx", "bz")))["d"]).where(F.col("d") <= reach)
        met = cut(met.select("pid", "px", "pz", "cid", "d").distinct())
        least = met.groupBy("pid").agg(F.min("d").alias("least"))
        near = met.join(least.hint("merge"), "pid").where(F.col("d") <= F.col("least") + EPS).select("pid", "px", "pz", "cid")
        own = near.join(members.hint("merge"), "cid").withColumn("d", nearest_on(*(F.col(n) for n in ("px", "pz", "ax", "az", "bx", "bz")))["d"])
        best = cut(own.groupBy("pid").agg(F.min(F.struct("d", "line")).alias("b")).select("pid", F.col("b.line").alias("line"), F.col("b.d").alias("d")))
        found.append(best)
        left = cut(left.join(best.select("pid").hint("merge"), "pid", "left_anti"))
        if reach > farthest or left.isEmpty():
            return reduce(DataFrame.unionAll, found)
        reach *= growth


def _walked(lines: DataFrame, cell: float) -> DataFrame:
    """lines (ax, az, bx, bz, ...) with the cells cx__, cz__ that they pass, and some beside them."""
    box = (F.least("ax", "bx"), F.least("az", "bz"), F.greatest("ax", "bx"), F.greatest("az", "bz"))
    middle = lambda c: (F.col(c) + 0.5) * cell
    off = nearest_on(middle("cx__"), middle("cz__"), *map(F.col, ("ax", "az", "bx", "bz")))["d"]
    return with_cells(lines, *box, cell, "r__").drop("r__x0", "r__z0").where(off <= cell * 0.75)


def without_spans(extents: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth, start, stop): what the spans (keys, start, stop) leave of each extent (keys, start, stop), in order. Spans may
    overlap, touch, reach beyond the extent or run backwards, in which case they cover nothing; nulls take no part.

    A sweep: with the ends of all spans before it known, a span leaves what lies between the furthest of them and its own start."""
    real = lambda df: df.where("start is not null and stop is not null and start < stop").select(*keys, F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    whole = real(extents).withColumnsRenamed({"start": "low", "stop": "high"})
    inside = real(spans).join(whole, keys).where((F.col("stop") > F.col("low")) & (F.col("start") < F.col("high")))
    # the end of an extent is a span that begins where nothing is left
    marks = inside.select(*keys, "low", "high", "start", "stop").unionByName(whole.select(*keys, "low", "high", F.col("high").alias("start"), F.col("high").alias("stop")))
    before = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    swept = marks.withColumn("free", F.coalesce(F.greatest(F.max("stop").over(before), F.col("low")), F.col("low")))
    left = swept.where(F.col("free") < F.col("start")).select(*keys, F.col("free").alias("start"), F.least("start", "high").alias("stop"))
    return left.withColumn("nth", (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).cast("long")).select(*keys, "nth", "start", "stop")
