"""Geometry derived from the given tables, the same in Spark and in SQL: all coordinates are multiples of a quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import rings


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table's rows dealt to all cores by its key: a file of short rows has few partitions, and what is made of them is large."""
    return read(spark, sf_dir, table).repartition(2 * spark.sparkContext.defaultParallelism, key)


def _spread(value, step: int, span: int, shift: float):
    return (value * step % span) / F.lit(4.0) - shift


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, z of customers, within the viewport."""
    cents = F.floor(F.abs("c_acctbal") * 100 + 0.5).cast("long")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _spread(F.col("c_custkey"), 7919, 3601, 450).alias("x"), ((cents % 3601) / F.lit(4.0) - 450).alias("z"), F.col("c_mktsegment").alias("segment"))


POINTS = """pts AS (
  SELECT c_custkey AS id, (c_custkey * 7919 % 3601) / 4.0::DOUBLE - 450 AS x, (CAST(floor(abs(c_acctbal) * 100 + 0.5) AS BIGINT) % 3601) / 4.0::DOUBLE - 450 AS z, c_mktsegment AS segment FROM customer
)"""


def moves(spark: SparkSession, sf_dir: str, scale: float = 1.5) -> DataFrame:
    """uid, seq, ax, az, bx, bz: users' ways from event to event, reaching beyond the viewport."""
    at = read(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), "ts", "event_id", (_spread(F.col("event_id"), 7919, 3601, 450) * scale).alias("ax"), (((F.floor(F.abs("value") * 100 + 0.5).cast("long") * 31 + F.col("event_id") * 101) % 3601 / F.lit(4.0) - 450) * scale).alias("az"))
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    return at.select("uid", (F.row_number().over(w) - 1).cast("long").alias("seq"), "ax", "az", F.lead("ax").over(w).alias("bx"), F.lead("az").over(w).alias("bz")).where("bx is not null")


MOVES = """ev AS (
  SELECT user_id AS uid, ts, event_id, ((event_id * 7919 % 3601) / 4.0::DOUBLE - 450) * 1.5::DOUBLE AS ax, ((CAST(floor(abs(value) * 100 + 0.5) AS BIGINT) * 31 + event_id * 101) % 3601 / 4.0::DOUBLE - 450) * 1.5::DOUBLE AS az FROM events
), mv0 AS (
  SELECT uid, row_number() OVER w - 1 AS seq, ax, az, lead(ax) OVER w AS bx, lead(az) OVER w AS bz FROM ev WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id)
), mv AS (SELECT * FROM mv0 WHERE bx IS NOT NULL)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ring: a five-cornered house for every part, turned upside down for odd keys; tags from its columns."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, z = _spread(k, 37, 3401, 450), _spread(k, 91, 3401, 450)
    w, d = s / 2 + 2, (k % 17) / F.lit(4.0) + 2
    up = rings.of((x, z), (x + w, z), (x + w, z + d), (x + w / 2, z + d * 2), (x, z + d))
    return dealt(spark, sf_dir, "part", "p_partkey").select(k.alias("id"), F.when(k % 2 == 0, up).otherwise(F.reverse(up)).alias("ring"), "p_name", "p_brand", "p_type", "p_size", x.alias("x"), z.alias("z"), w.alias("w"), d.alias("d"))


SHAPES = """sh AS (
  SELECT p_partkey AS id, (p_partkey * 37 % 3401) / 4.0::DOUBLE - 450 AS x, (p_partkey * 91 % 3401) / 4.0::DOUBLE - 450 AS z, p_size::DOUBLE / 2 + 2 AS w, (p_partkey % 17) / 4.0::DOUBLE + 2 AS d, p_name, p_brand, p_type, p_size FROM part
), corners AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN k ELSE 4 - k END AS pos, CASE k WHEN 0 THEN x WHEN 1 THEN x + w WHEN 2 THEN x + w WHEN 3 THEN x + w / 2 ELSE x END AS px, CASE k WHEN 0 THEN z WHEN 1 THEN z WHEN 2 THEN z + d WHEN 3 THEN z + d * 2 ELSE z + d END AS pz
  FROM sh, (SELECT unnest(range(5)) AS k)
), ring AS (
  SELECT id, pos, px, pz, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(pz) OVER w, first_value(pz) OVER w) AS qz FROM corners WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, part, ax, az, bx, bz, cls, level: a straight street for every supplier, upright or level or slanting."""
    k = F.col("s_suppkey").cast("long")
    x, z = _spread(k, 577, 3201, 400), _spread(k, 911, 3201, 400)
    reach = (k * 53 % 600) / F.lit(4.0) + 20
    dx = F.when(k % 3 == 0, 0.0).otherwise(reach)
    dz = F.when(k % 3 == 1, 0.0).otherwise(reach)
    cls = F.when(k % 7 == 0, "arterial").when(k % 7 < 3, "collector").otherwise("local")
    return read(spark, sf_dir, "supplier").select(k.alias("src"), F.lit(0).alias("part"), x.alias("ax"), z.alias("az"), (x + dx).alias("bx"), (z + dz).alias("bz"), cls.alias("cls"), F.when(k % 11 == 0, 1.0).otherwise(0.0).alias("level"))


STREETS = """st AS (
  SELECT k AS src, x AS ax, z AS az, x + CASE WHEN k % 3 = 0 THEN 0.0 ELSE reach END AS bx, z + CASE WHEN k % 3 = 1 THEN 0.0 ELSE reach END AS bz,
    CASE WHEN k % 7 = 0 THEN 'arterial' WHEN k % 7 < 3 THEN 'collector' ELSE 'local' END AS cls, CASE WHEN k % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS level
  FROM (SELECT s_suppkey::BIGINT AS k, (s_suppkey::BIGINT * 577 % 3201) / 4.0::DOUBLE - 400 AS x, (s_suppkey::BIGINT * 911 % 3201) / 4.0::DOUBLE - 400 AS z, (s_suppkey::BIGINT * 53 % 600) / 4.0::DOUBLE + 20 AS reach FROM supplier)
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge, a, b, weight: every part and another of its block of forty that its key and size name."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("edge"), k.alias("a"), (k - k % 40 + (k * k + F.col("p_size") * 7) % 40).alias("b"), F.col("p_retailprice").alias("weight"))
    return rows.where("a <> b")


LINKS = """lk AS (
  SELECT * FROM (SELECT p_partkey AS edge, p_partkey AS a, p_partkey - p_partkey % 40 + (p_partkey * p_partkey + p_size * 7) % 40 AS b, p_retailprice AS weight FROM part) WHERE a <> b
)"""
