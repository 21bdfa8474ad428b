"""Joins of many rows with the groups they belong to, where one group may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot that has more than a SPREAD-th of the rows; there are at most SPREAD of them.
SPREAD = 512


def meet(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows with the other columns of their group. groups is a written table with one row for each value of `on` in rows, and the number
    of its rows in `size`, `total` in all. Hot groups go to the rows, which stay where they are; the others meet theirs in a join."""
    told = [c for c in groups.columns if c not in on and c != size]
    few = groups.where(F.col(size) * SPREAD > total).select(*on, F.struct(*told).alias("hot__"))
    many = groups.where(F.col(size) * SPREAD <= total).select(*on, *told)
    split = rows.join(F.broadcast(few), on, "left")  # at most SPREAD rows
    cold = split.where("hot__ is null").drop("hot__").join(many, on).select(*rows.columns, *told)
    return cold.unionAll(split.where("hot__ is not null").select(*rows.columns, *(F.col(f"hot__.{c}").alias(c) for c in told)))
