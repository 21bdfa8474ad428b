"""Cycles of a permutation by pointer doubling: every link learns its cycle and its place in it, with no task holding a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators.shared import Rounds


def trace(links: DataFrame) -> DataFrame:
    """links (node, next, ...) with `cycle`, the least node of its cycle, and `ahead`, the steps from the node on to that one.

    `next` has to be a permutation of `node`, of any type that can be compared. Each round looks twice as far along the cycle, so
    there are log2 of the longest cycle's length, and one more in which nothing changes. Pointers stay a permutation, so the joins
    have no skewed key. No links give no rows.
    """
    rounds = Rounds(links.sparkSession, "cycles")
    own = [c for c in links.columns if c != "next"]
    now = rounds.put(links.select(*own, F.col("next").alias("to__"), F.col("node").alias("cycle"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("moved__")))
    reach = 1
    while not now.where("moved__").isEmpty():
        far = now.select(F.col("node").alias("at__"), F.col("to__").alias("further__"), F.col("cycle").alias("least__"), F.col("ahead").alias("more__"))
        met = now.join(far.hint("merge"), F.col("to__") == F.col("at__"))  # files are small where rows are many: no broadcast
        nearer = F.col("least__") < F.col("cycle")
        now = rounds.put(
            met.select(
                *own,
                F.col("further__").alias("to__"),
                F.when(nearer, F.col("least__")).otherwise(F.col("cycle")).alias("cycle"),
                F.when(nearer, F.col("more__") + reach).otherwise(F.col("ahead")).alias("ahead"),
                nearer.alias("moved__"),
            )
        )
        reach *= 2
    return rounds.end(now.drop("to__", "moved__"))


def gathered(traced: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """One row a cycle with its values in order, from the least node on: the keys, cycle and `items`. A cycle has to fit in a row."""
    place = F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead")).alias("place__")
    return traced.groupBy(*keys, "cycle").agg(F.array_sort(F.collect_list(F.struct(place, *values))).alias("items"))


def outlines(traced: DataFrame, keys: list[str]) -> DataFrame:
    """The cycles of points (x, z) as rings: the keys, cycle and ring."""
    items = gathered(traced, keys, F.col("x"), F.col("z"))
    return items.select(*keys, "cycle", F.transform("items", lambda p: rings.point(p["x"], p["z"])).alias("ring"))


def follow(stubs: DataFrame, keys: list[str]) -> DataFrame:
    """(half, next): how directed edges that meet at nodes go on so that the closed walks they form don't cross each other.

    stubs: the keys of a node, half (the edge), out (whether it leaves the node), angle (of the way it lies). Seen counter-clockwise,
    an edge that leaves opens a pair and one that arrives closes the last that is open, so an arriving edge goes on along the
    nearest free one to its right. As many edges have to arrive at a node as leave it.
    """
    # Edges that lie on each other are side by side: what is left at one end is left at the other, seen from there the other way round.
    order = [F.col("angle"), F.desc("out"), F.when(F.col("out"), F.col("half")), F.when(~F.col("out"), F.col("half")).desc()]
    around = Window.partitionBy(*keys).orderBy(*order)
    depth = F.sum(F.when(F.col("out"), 1).otherwise(-1)).over(around.rowsBetween(Window.unboundedPreceding, 0))
    level = stubs.withColumn("level__", depth + F.when(F.col("out"), 0).otherwise(1))
    same = Window.partitionBy(*keys, "level__").orderBy(*order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = F.coalesce(F.lag("half").over(same), F.last("half").over(whole))
    return level.withColumn("next", partner).where(~F.col("out")).select("half", "next")
