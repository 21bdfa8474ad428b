"""Queries that check tables, and what spans leave of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import checks, lines
from loomgrid.plans import tables as t
from loomgrid.plans.queries import query

ROW = "coalesce(o_orderkey::VARCHAR, '') || '|' || coalesce(o_custkey::VARCHAR, '') || '|' || o_orderpriority || '|' || list_reduce(list_prepend('', items), lambda a, b: a || b)"


@query(
    f"""
WITH nested AS (SELECT o.*, (SELECT coalesce(list('[' || l_linenumber::VARCHAR || ',' || l_partkey::VARCHAR || ',' || l_suppkey::VARCHAR || ']' ORDER BY l_linenumber, l_partkey, l_suppkey), []::VARCHAR[]) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders o)
SELECT o_orderstatus AS status, count(*) AS rows, sum(('0x' || substr(md5({ROW}), 1, 15))::BIGINT)::VARCHAR AS signature FROM nested GROUP BY o_orderstatus"""
)
def order_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of orders with their items by status, which no order of rows changes (SCL-20)."""
    item = F.concat(F.lit("["), F.concat_ws(",", "l_linenumber", "l_partkey", "l_suppkey"), F.lit("]"))
    items = t.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("told")))).alias("items"))
    nested = t.read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    told = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority", F.coalesce(F.array_join(F.transform("items", lambda i: i["told"]), ""), F.lit("")))
    return checks.signature(nested.withColumnRenamed("o_orderstatus", "status"), told, ["status"])


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) SELECT * FROM w WHERE l_partkey <= before")
def items_not_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order whose part isn't above that of the item before (WIN-9)."""
    items = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return checks.not_rising(items, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


# An order's line is as long as its price in hundreds; every item closes a span of it. SQL cuts lines at all ends and keeps what no span covers.
SPANS = """ex AS (SELECT o_orderkey AS line, 0.0::DOUBLE AS start, (o_orderkey % 61 * 4 + 40)::DOUBLE AS stop FROM orders), sp AS (
  SELECT l_orderkey AS line, (l_partkey * 7 % 300)::DOUBLE - 10 AS start, (l_partkey * 7 % 300)::DOUBLE - 10 + l_suppkey % 45 AS stop FROM lineitem
)"""


@query(
    f"""
WITH {SPANS}, ends AS (SELECT line, start AS p FROM ex UNION SELECT line, stop FROM ex UNION SELECT line, least(greatest(s.start, e.start), e.stop) FROM sp s JOIN ex e USING (line) UNION SELECT line, least(greatest(s.stop, e.start), e.stop) FROM sp s JOIN ex e USING (line)),
parts AS (SELECT line, p AS a, lead(p) OVER (PARTITION BY line ORDER BY p) AS b FROM ends), free AS (SELECT * FROM parts p WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sp s WHERE s.line = p.line AND s.start <= p.a AND s.stop >= p.b AND s.start < s.stop)),
runs AS (SELECT *, sum(CASE WHEN a = before THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY a) AS run FROM (SELECT *, lag(b) OVER (PARTITION BY line ORDER BY a) AS before FROM free))
SELECT line, run::BIGINT - 1 AS nth, min(a) AS start, max(b) AS stop FROM runs GROUP BY line, run"""
)
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What items' spans leave open of orders' lines, in order (WIN-8)."""
    key = F.col("o_orderkey")
    extents = t.read(spark, sf_dir, "orders").select(key.alias("line"), F.lit(0.0).alias("start"), (key % 61 * 4 + 40).cast("double").alias("stop"))
    at = (F.col("l_partkey") * 7 % 300).cast("double") - 10
    spans = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), at.alias("start"), (at + F.col("l_suppkey") % 45).alias("stop"))
    return lines.without_spans(extents, spans, ["line"])


@query(
    f"""
WITH {t.POINTS}, wet AS (SELECT id, x, z, abs(x + z / 2) - 60 AS sdf FROM pts), grid AS (
  SELECT spot, x, z FROM (SELECT i AS spot, ((i // 41) / 40.0::DOUBLE - 0.5) * 900 AS x, ((i % 41) / 40.0::DOUBLE - 0.5) * 900 AS z FROM (SELECT unnest(range(1681)) AS i)) WHERE abs(x + z / 2) - 60 > 0
), near AS (
  SELECT w.id, arg_min([g.x, g.z], [sqrt((g.x - w.x) * (g.x - w.x) + (g.z - w.z) * (g.z - w.z)), g.spot::DOUBLE]) AS g FROM wet w JOIN grid g ON w.sdf <= 0 AND abs(g.x - w.x) < 200 AND abs(g.z - w.z) < 200 GROUP BY w.id
)
SELECT w.id, round(coalesce(g[1], x), 6) AS x, round(coalesce(g[2], z), 6) AS z FROM wet w LEFT JOIN near n ON n.id = w.id"""
)
def points_on_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that lie in a river, moved to the nearest land of a grid (SRT-12)."""
    points = t.points(spark, sf_dir).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("z").alias("pz"))
    found = checks.on_land(points, lambda x, z: F.abs(x + z / 2) - 60, 900.0)
    return found.select(F.col("pid").alias("id"), F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))
