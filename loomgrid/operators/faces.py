"""Faces of a planar graph: every edge is two half-edges; each knows the next one around its face.

The next half-edge comes from a window by angle around each node. Half-edges that follow each other form cycles, which pointer
doubling names and puts in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators.components import connected_components
from loomgrid.operators.cycles import gathered, trace
from loomgrid.operators.network import spurs, with_ends
from loomgrid.operators.shared import cut

LEAST_AREA = 1.0


def half_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(half, edge, node, next_node, x, z, next): half-edge 2 e goes from a to b, 2 e + 1 back; next follows it around its face."""
    told = with_ends(edges, nodes)
    out = told.select(
        "edge",
        F.explode(
            F.array(
                F.struct((F.col("edge") * 2).alias("half"), F.col("a").alias("node"), F.col("b").alias("next_node"), F.col("ax").alias("x"), F.col("az").alias("z"), F.atan2(F.col("bz") - F.col("az"), F.col("bx") - F.col("ax")).alias("angle")),
                F.struct((F.col("edge") * 2 + 1).alias("half"), F.col("b").alias("node"), F.col("a").alias("next_node"), F.col("bx").alias("x"), F.col("bz").alias("z"), F.atan2(F.col("az") - F.col("bz"), F.col("ax") - F.col("bx")).alias("angle")),
            )
        ).alias("h"),
    ).select("edge", "h.*")
    around = Window.partitionBy("node").orderBy("angle", "edge")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Arriving at a node, a face goes on along the edge that comes before its own in the order of angles.
    before = F.coalesce(F.lag("half").over(around), F.last("half").over(whole))
    turned = out.withColumn("before", before)
    twin = turned.select(F.col("half").alias("twin"), F.col("before").alias("next"))
    return out.join(twin, F.col("half").bitwiseXOR(F.lit(1).cast("long")) == F.col("twin")).drop("twin", "angle")


def extract_faces(nodes: DataFrame, edges: DataFrame, least: float = LEAST_AREA) -> DataFrame:
    """face, ring (counter-clockwise), edge_ids, area, simple; without dead ends, faces below `least` and the outer face of each part.

    The outer face's sign is that of the largest area of its component."""
    eligible = edges.where(F.coalesce("face_eligible", F.lit(True))) if "face_eligible" in edges.columns else edges
    eligible = eligible.where(~F.coalesce("removed", F.lit(False))) if "removed" in edges.columns else eligible
    live = cut(eligible.join(spurs(eligible), "edge", "left_anti").select("edge", "a", "b"))
    halves = cut(half_edges(nodes, live))
    traced = trace(halves.select(F.col("half").alias("node"), "next", "edge", F.col("node").alias("at"), "x", "z"))
    around = gathered(traced, [], F.col("x"), F.col("z"), F.col("edge"), F.col("at"))
    faces = cut(around.select(F.col("cycle").alias("face"), F.transform("items", lambda h: rings.point(h["x"], h["z"])).alias("ring"), F.transform("items", lambda h: h["edge"]).alias("edge_ids"), F.element_at("items", 1)["at"].alias("node")))
    sized = faces.withColumn("signed", rings.signed_area(F.col("ring")))
    parts = connected_components(live.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "part")
    part_of = faces.select("face", "node").join(parts, "node").select("face", "part")
    told = sized.join(part_of, "face")
    outer = told.groupBy("part").agg(F.max_by(F.signum("signed"), F.struct(F.abs("signed"), -F.col("face"))).alias("outer"))
    inner = told.join(outer, "part").where((F.signum("signed") != F.col("outer")) & (F.abs("signed") >= least))
    ring = rings.ccw(F.col("ring"))
    turned = F.col("signed") < 0
    n = F.size("edge_ids")
    # reversed, edge i runs from point i to i + 1 again when the ids are reversed and shifted by one
    back = F.concat(F.slice(F.reverse("edge_ids"), 2, F.greatest(n - 1, F.lit(0))), F.slice(F.reverse("edge_ids"), 1, 1))
    return inner.select("face", ring.alias("ring"), F.when(turned, back).otherwise(F.col("edge_ids")).alias("edge_ids"), F.abs("signed").alias("area"), rings.is_simple(ring).alias("simple"))
