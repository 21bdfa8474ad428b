"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a pair of aggregations and equi-joins, so that neither the driver nor one task ever holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.shared import Rounds


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b; returns edges of the same form."""
    links = edges
    if both_ways:
        links = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # Under a name that isn't the grouping's, both sides of the join are dealt out anew, and Spark may split a node with many links.
    own = least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m")
    joined = links.join(own.hint("merge"), links["a"] == own["k"]).drop("k")
    if both_ways:  # the larger neighbours move to the smallest node in reach
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the smaller neighbours and the node itself do
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node it reaches.
    Nodes are integers.

    Nulls, self-loops and repeated edges are ignored; no edges give no rows. A node without links is its own component
    and is left to the caller. Raises RuntimeError if max_rounds rounds don't settle.
    """
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d")
    rounds = Rounds(edges.sparkSession, "components")
    now = rounds.put(pairs.select(F.greatest("s", "d").alias("a"), F.least("s", "d").alias("b")).distinct())
    before, after = None, _state(now)
    while after[0] and after != before:
        if rounds.n > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        now = rounds.put(_stars(_stars(now, True), False))
        before, after = after, _state(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return rounds.end(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component"))))
