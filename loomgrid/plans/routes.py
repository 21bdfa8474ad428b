"""Queries of ways through graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import faces, network
from loomgrid.plans import tables as t
from loomgrid.plans.queries import ROADS, _roads, query

# Every block of forty parts is a graph with as many links as parts, so two parts have few ways between them that pass none twice.
WAYS = f"""
WITH RECURSIVE {t.LINKS}, ways AS (
  SELECT a, b, weight FROM lk UNION ALL SELECT b, a, weight FROM lk
), pairs AS (
  SELECT k - k % 40 + 1 AS start, k AS goal FROM (SELECT p_partkey AS k FROM part) WHERE k % 8 = 5
), walks AS (
  SELECT DISTINCT start, start AS here, [start] AS seen, 0.0::DOUBLE AS cost FROM pairs
  UNION ALL SELECT start, b, list_append(seen, b), cost + weight FROM walks JOIN ways ON a = here WHERE NOT list_contains(seen, b)
)
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = t.links(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("w")
    return links.select("edge", "weight", both).select("w.node", "edge", "w.next", F.col("weight").alias("cost"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return t.read(spark, sf_dir, "part").where(k % 8 == 5).select((k - k % 40 + 1).alias("start"), k.alias("goal"))


@query(WAYS + "SELECT start, goal, round(min(cost), 6) AS cost FROM walks JOIN pairs USING (start) WHERE here = goal GROUP BY start, goal")
def cheapest_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cheapest way costs from the first part of a block to others of it, all blocks at once (NET-3)."""
    reached, pairs = network.least_cost(_steps(spark, sf_dir), _pairs(spark, sf_dir))
    costs = reached.select("start", F.col("node").alias("goal"), F.round("cost", 6).alias("cost"))
    return pairs.join(costs.hint("merge"), ["start", "goal"])


@query(WAYS + "SELECT start, goal, unnest(range(length(way))) AS pos, unnest(way) AS node FROM (SELECT start, goal, arg_min(seen, cost) AS way FROM walks JOIN pairs USING (start) WHERE here = goal GROUP BY start, goal)")
def cheapest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts on those ways, in order (NET-3)."""
    found = network.paths(*network.least_cost(_steps(spark, sf_dir), _pairs(spark, sf_dir)))
    return found.select("start", "goal", "pos", "node")


# Half-edges 2 e and 2 e + 1; a walk that comes to a lower one than its first isn't the first of its face.
FACES = f"""
WITH RECURSIVE {ROADS}, ground AS (
  SELECT row_number() OVER (ORDER BY src, nth) AS e, x, z, qx, qz FROM ed WHERE level = 0
), halves AS (
  SELECT e * 2 AS half, e, x, z, qx, qz, atan2(qz - z, qx - x) AS angle FROM ground UNION ALL SELECT e * 2 + 1, e, qx, qz, x, z, atan2(z - qz, x - qx) FROM ground
), turns AS (
  SELECT *, coalesce(lag(half) OVER w, last_value(half) OVER (PARTITION BY x, z ORDER BY angle, e ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM halves WINDOW w AS (PARTITION BY x, z ORDER BY angle, e)
), follows AS (
  SELECT h.half, h.x * h.qz - h.qx * h.z AS twice, t.before AS next FROM turns h JOIN turns t ON t.half = xor(h.half, 1)
), walk AS (
  SELECT half AS start, next AS here, twice FROM follows UNION ALL SELECT w.start, f.next, w.twice + f.twice FROM walk w JOIN follows f ON f.half = w.here WHERE w.here > w.start
)
SELECT round(twice / 2, 6) AS area FROM walk WHERE here = start AND twice / 2 >= 1
"""


@query(FACES)
def street_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that the streets at grade enclose (GR-6, WIN-5, FLT-16)."""
    g = _roads(spark, sf_dir)
    found = faces.extract_faces(g.nodes.drop("level"), g.edges.where("level = 0").select("edge", "a", "b"))
    return found.select(F.round("area", 6).alias("area"))
