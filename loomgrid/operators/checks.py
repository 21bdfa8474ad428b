"""Checks of whole tables: a digest that no order changes, ids that have to rise, and points moved out of the water."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.fields import Field
from loomgrid.operators.lines import nearest_lines

#: Hexadecimal digits of a row's MD5 that are added up; sums of as many rows as there may be stay within 38 digits.
DIGITS = 15


def canonical(*columns: Column) -> Column:
    """One text for the values of a row, nested ones too: nulls, empty texts and separators in texts can't be taken for each other."""
    return F.to_json(F.array(*(F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("{}")) for c in columns)))


def signature(df: DataFrame, text: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, rows, signature): a digest of the rows of each group, the same in whatever order or partitioning they come, that counts
    repeats. text: the canonical text of a row, by default that of all columns by name."""
    by = by or []
    told = text if text is not None else canonical(*(F.col(c) for c in sorted(df.columns)))
    number = F.conv(F.substring(F.md5(told), 1, DIGITS), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("signature"))


def not_rising(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value isn't larger than that of the row before them, with it as `before`; nulls rise from nothing."""
    along = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(along)).where(F.col(value) <= F.col("before"))


def land_grid(spark: SparkSession, water: Field, size: float, n: int = 41) -> DataFrame:
    """(spot, x, z): the points of an n x n grid over a plate that lie on land."""
    cells = spark.range(n * n).select(F.col("id").alias("spot"), *((((F.col("id") / n).cast("long") if a == "x" else F.col("id") % n) / (n - 1) - 0.5) * size for a in "xz"))
    grid = cells.toDF("spot", "x", "z")
    return grid.where(water(F.col("x"), F.col("z")) > 0)


def on_land(points: DataFrame, water: Field, size: float, n: int = 41) -> DataFrame:
    """points (pid, px, pz) with x and z: where they are, or else the nearest point of the grid that is on land, of equals the first.
    Without any land points stay where they are."""
    told = points.withColumn("dry", F.coalesce(water(F.col("px"), F.col("pz")) > 0, F.lit(False)))
    spots = land_grid(points.sparkSession, water, size, n)
    lines = spots.select(F.col("spot").alias("line"), F.col("x").alias("ax"), F.col("z").alias("az"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    found = nearest_lines(told.where("not dry").select("pid", "px", "pz"), lines, size / (n - 1))
    moved = found.join(spots.withColumnRenamed("spot", "line"), "line").select("pid", "x", "z")
    return told.join(moved, "pid", "left").select(*points.columns, F.coalesce("x", "px").alias("x"), F.coalesce("z", "pz").alias("z"))
