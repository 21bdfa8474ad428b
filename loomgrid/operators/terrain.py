"""Heights of what stands on the terrain: ground under footprints, decks of bridges and rails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.functions.fields import Field
from loomgrid.operators.components import connected_components
from loomgrid.operators.grid_join import grid_join

# Reach of the smoothing towards a shore, clearances and steps of sampling.
SHORE_REACH = 36.0
DECK_CLEAR, DECK_LEAST, DECK_STEP, RAIL_CLEAR, RAIL_LEAST = 2.8 + 0.25, 3.4, 2.0, 8.0, 15.0
DRAPE_LEVELS, DRAPE_MOST, DRAPE_TARGET = 2, 6, 32.0
RUN_REACH = 0.5
BANK_STATIONS = SHORE_REACH / 4


def ground(elevation: Field, water: Field, datum: float = 0.0) -> Field:
    """Terrain that runs down to the datum at the shore."""

    def at(x: Column, z: Column) -> Column:
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), water(x, z) / SHORE_REACH))
        return F.lit(datum) + elevation(x, z) * u * u * (3 - 2 * u)

    return at


def samples(ring: Column, step: float = 8.0) -> Column:
    """Corners, points along the edges at most a step apart, a grid inside the ring, and its middle."""
    def along(e: Column) -> Column:
        dx, dz = e["q"]["x"] - e["p"]["x"], e["q"]["z"] - e["p"]["z"]
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dz * dz) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((e["p"]["x"] + dx * k / n).alias("x"), (e["p"]["z"] + dz * k / n).alias("z")))

    box = rings.bounds(ring)
    cells = lambda size: F.greatest(F.lit(1), F.ceil(size / step).cast("int"))
    nx, nz = cells(box["w"]), cells(box["d"])
    row = lambda i: F.transform(F.sequence(F.lit(0), nz - 1), lambda j: F.struct((box["x"] + box["w"] * (i + 0.5) / nx).alias("x"), (box["z"] + box["d"] * (j + 0.5) / nz).alias("z")))
    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), nx - 1), row)), lambda p: rings.contains(ring, p["x"], p["z"]))
    return F.concat(F.flatten(F.transform(rings.edges(ring), along)), inner, F.array(rings.centroid(ring)))


def anchors(items: DataFrame, height: Field, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, low and high: the lowest and highest ground under each item's ring. One row a sample, so that the height is compiled."""
    each = items.select(*keys, F.explode(samples(F.col(ring))).alias("p")).select(*keys, height(F.col("p.x"), F.col("p.z")).alias("h"))
    return each.groupBy(*keys).agg(F.min("h").alias("low"), F.max("h").alias("high"))


def _steps(segments: DataFrame, step: float, first: int) -> DataFrame:
    """segments with k__ from first to n__, the number of steps along them."""
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    told = segments.withColumn("run__", F.sqrt(dx * dx + dz * dz)).withColumn("n__", F.greatest(F.lit(1), F.ceil(F.col("run__") / step).cast("int")))
    return told.withColumn("k__", F.explode(F.sequence(F.lit(first), F.col("n__"))))


def _along(height: Field, k: Column) -> Column:
    return height(F.col("ax") + (F.col("bx") - F.col("ax")) * k / F.col("n__"), F.col("az") + (F.col("bz") - F.col("az")) * k / F.col("n__"))


def bank_tops(points: DataFrame, height: Field, water: Field, keys: list[str], step: float = DECK_STEP) -> DataFrame:
    """(keys, h): the highest ground on the way up the bank from each of points (keys, x, z): along the gradient of the distance to the
    shore, a step at a time, until the bank is at its full height or the distance grows no more. Points beyond the reach of a
    bank have null. A way has a fixed number of steps, so it is an expression of its point."""
    half = step / 2
    near = water(F.col("x"), F.col("z"))
    begun = F.coalesce(near.between(-SHORE_REACH, SHORE_REACH) & (near < SHORE_REACH), F.lit(False))

    def up(w: Column, _) -> Column:
        gx = water(w["x"] + half, w["z"]) - water(w["x"] - half, w["z"])
        gz = water(w["x"], w["z"] + half) - water(w["x"], w["z"] - half)
        g = F.sqrt(gx * gx + gz * gz)
        steep = w["on"] & (g > 1e-9)
        x, z = w["x"] + F.when(steep, gx / g * step).otherwise(0.0), w["z"] + F.when(steep, gz / g * step).otherwise(0.0)
        further = F.coalesce(steep & (water(x, z) > w["s"]), F.lit(False))
        h = F.when(further & (water(x, z) > 0), height(x, z))
        return F.struct(x.alias("x"), z.alias("z"), F.when(further, water(x, z)).otherwise(w["s"]).alias("s"), F.greatest(w["h"], h).alias("h"), (further & (water(x, z) < SHORE_REACH)).alias("on"))

    most = math.ceil(2 * SHORE_REACH / step) + 2
    start = F.struct(F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), F.coalesce(near, F.lit(0.0)).cast("double").alias("s"), F.lit(None).cast("double").alias("h"), begun.alias("on"))
    return points.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, up)["h"].alias("h"))


def deck_heights(bridges: DataFrame, height: Field, clearance: float = DECK_CLEAR, step: float = DECK_STEP, width: float | Column = 0.0, water: Field | None = None, least: float = DECK_LEAST) -> DataFrame:
    """bridges (bridge, ax, az, bx, bz, ...) with deck: above the highest ground below it, sampled along the axis and across the width, and
    never below `least`; and, with the distance to the shore given, above the banks that rise from either end and from both sides of long spans."""
    own = bridges.columns
    wide = F.greatest(F.lit(0.0), width if isinstance(width, Column) else F.lit(float(width)))
    told = _steps(bridges.withColumn("wide__", wide).withColumn("across__", F.greatest(F.lit(1), F.ceil(F.col("wide__") / step).cast("int"))), step, 0)
    run = F.when(F.col("run__") > 0, F.col("run__"))
    nx, nz = (F.coalesce(v / run, F.lit(0.0)) for v in (F.col("az") - F.col("bz"), F.col("bx") - F.col("ax")))

    def spots(rows: DataFrame, share: Column) -> DataFrame:
        """Points beside the axis at a share of its length, at offset o__."""
        along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * share
        return rows.select(*own, (along("ax", "bx") + nx * F.col("o__")).alias("x"), (along("az", "bz") + nz * F.col("o__")).alias("z"))

    offsets = F.transform(F.sequence(F.lit(0), F.col("across__")), lambda j: F.col("wide__") * (j / F.col("across__") - 0.5))
    below = spots(told.withColumn("o__", F.explode(offsets)), F.col("k__") / F.col("n__"))
    high = below.select(*own, height(F.col("x"), F.col("z")).alias("h"))
    if water is not None:
        ends = told.where("k__ = 0 or k__ = n__").withColumn("o__", F.explode(offsets))
        stations = F.greatest(F.lit(1), F.ceil(F.col("run__") / BANK_STATIONS).cast("int"))
        inner = told.where("k__ = 0").withColumn("m__", stations).where("m__ > 1").withColumn("i__", F.explode(F.sequence(F.lit(1), F.col("m__") - 1))).withColumn("o__", F.explode(F.array_distinct(F.array(-F.col("wide__") / 2, F.col("wide__") / 2))))
        landings = spots(ends, F.col("k__") / F.col("n__")).unionAll(spots(inner, F.col("i__") / F.col("m__")))
        high = high.unionAll(bank_tops(landings, height, water, own, step))
    return high.groupBy(*own).agg(F.greatest(F.lit(float(least)), F.max("h") + clearance).alias("deck"))


def run_decks(bridges: DataFrame, reach: float = RUN_REACH) -> DataFrame:
    """bridges (bridge, ax, az, bx, bz, deck) where those that meet end to end share the highest deck of their run."""
    ends = bridges.select("bridge", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("az").alias("z")), F.struct(F.col("bx").alias("x"), F.col("bz").alias("z")))).alias("e")).select("bridge", "e.x", "e.z")
    other = ends.toDF("bridge2", "x2", "z2")
    near = grid_join(ends, other, (F.col("x") - reach, F.col("z") - reach, F.col("x") + reach, F.col("z") + reach), tuple(map(F.col, ("x2", "z2", "x2", "z2"))), 8.0)
    met = near.where((F.col("bridge") < F.col("bridge2")) & (F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("z") - F.col("z2")) ** 2) <= reach))
    runs = connected_components(met.select(F.col("bridge").alias("src"), F.col("bridge2").alias("dst")))
    told = bridges.join(runs, bridges["bridge"] == runs["node"], "left").drop("node").withColumn("run", F.coalesce("component", "bridge")).drop("component")
    most = told.groupBy("run").agg(F.max("deck").alias("most"))
    return told.join(most, "run").drop("deck").withColumnRenamed("most", "deck")


def rail_height(height: Field, upright: bool, offset: float, start: float, stop: float, clearance: float = RAIL_CLEAR, step: float = 12.0) -> Column:
    """One height for an elevated line: above the highest ground below it, and never below RAIL_LEAST."""
    n = max(1, math.ceil((stop - start) / step))
    at = [start + (stop - start) * k / n for k in range(n + 1)]
    spots = [height(F.lit(offset), F.lit(v)) if upright else height(F.lit(v), F.lit(offset)) for v in at]
    return F.greatest(F.lit(RAIL_LEAST), F.greatest(*spots) + clearance)


def max_grade(segments: DataFrame, height: Field, step: float = 4.0) -> DataFrame:
    """segments (ax, az, bx, bz and a key) with the steepest of their sampled parts."""
    rise = F.abs(_along(height, F.col("k__")) - _along(height, F.col("k__") - 1)) / F.when(F.col("run__") > 0, F.col("run__") / F.col("n__"))
    each = _steps(segments, step, 1).withColumn("g__", F.coalesce(rise, F.lit(0.0)))
    return each.groupBy(*segments.columns).agg(F.max("g__").alias("grade"))


def water_offences(edges: DataFrame, water: Field, tolerance: float = 0.25, step: float = 0.125) -> DataFrame:
    """At-grade edges (edge, ax, az, bx, bz) with a sampled point in water, and the first such point."""
    each = _steps(edges.repartition("edge"), step, 0)  # a short table has few partitions, and a street many samples
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k__") / F.col("n__")
    each = each.select("edge", F.col("k__").alias("k"), at("ax", "bx").alias("x"), at("az", "bz").alias("z"))
    wet = each.where(water(F.col("x"), F.col("z")) < -tolerance)
    return wet.groupBy("edge").agg(F.min_by(F.struct("x", "z"), "k").alias("p")).select("edge", "p.x", "p.z")


def kerbs(roads: DataFrame, inset: float = 0.0) -> DataFrame:
    """The two edge lines of each road (ax, az, bx, bz, width and a key): side, kax, kaz, kbx, kbz; side 1 lies left of a to b."""
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    run = F.sqrt(dx * dx + dz * dz)
    size = F.when(run > 0, run).otherwise(1.0)
    nx, nz = -dz / size * (F.col("width") / 2 - inset), dx / size * (F.col("width") / 2 - inset)
    each = roads.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    return each.withColumns({f"k{end}{axis}": F.col(f"{end}{axis}") + F.col("side") * n for end in "ab" for axis, n in (("x", nx), ("z", nz))})


def terrain_cells(spark, x: float, z: float, w: float, d: float, n: int = 16) -> DataFrame:
    """(i, j, ring) of a plate's n x n cells."""
    rows = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    x0, z0 = F.lit(float(x)) + F.lit(float(w)) * F.col("i") / n, F.lit(float(z)) + F.lit(float(d)) * F.col("j") / n
    x1, z1 = F.lit(float(x)) + F.lit(float(w)) * (F.col("i") + 1) / n, F.lit(float(z)) + F.lit(float(d)) * (F.col("j") + 1) / n
    return rows.select("i", "j", rings.of((x0, z0), (x1, z0), (x1, z1), (x0, z1)).alias("ring"))


def drape_depth(span: Column, least: int = DRAPE_LEVELS, most: int = DRAPE_MOST, target: float = DRAPE_TARGET) -> Column:
    """How often a span is halved for its parts to be as long as the target, within bounds."""
    wanted = F.ceil(F.log2(F.when(span > 0, span) / target)).cast("int")
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(wanted, F.lit(least))))
