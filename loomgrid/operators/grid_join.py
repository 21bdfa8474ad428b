"""Spatial joins by a grid: boxes are dealt to the cells they cover and meet in an equi-join.

A pair that shares several cells is kept only in the first one they share, so there is nothing to make distinct.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.operators.shared import checked, cut

FINEST = 8  # halvings of a reach at most
DENSE = 8  # tasks a core of a join that makes many pairs
LOT = 2048  # rows of a cell and side that meet others together
PAIRS = 1 << 16  # pairs that a task looks at in one go
CORNERS = ("x0", "z0", "x1", "z1")


def with_cells(df: DataFrame, x0: Column, z0: Column, x1: Column, z1: Column, cell: float, prefix: str) -> DataFrame:
    """One row per cell that the box covers: cx__, cz__, and the box's first cell under prefix."""
    at = lambda v: F.floor(v / F.lit(float(cell))).cast("long")
    cells = df.withColumn(f"{prefix}x0", at(x0)).withColumn(f"{prefix}z0", at(z0))
    cells = cells.withColumn("cx__", F.explode(F.sequence(F.col(f"{prefix}x0"), at(x1))))
    return cells.withColumn("cz__", F.explode(F.sequence(F.col(f"{prefix}z0"), at(z1))))


def grid_join(left: DataFrame, right: DataFrame, left_box: Sequence[Column], right_box: Sequence[Column], cell: float, keys: Sequence[tuple[str, str]] = (), how: str = "inner", dense: bool = False) -> DataFrame:
    """Pairs of rows whose cells meet; the caller adds the exact condition. Boxes are (x0, z0, x1, z1); column names differ.

    dense: there are far more pairs than rows, so the cells are dealt to many tasks however few bytes the rows have."""
    a = with_cells(left, *left_box, cell, "l__")
    b = with_cells(right, *right_box, cell, "r__").withColumnsRenamed({"cx__": "rx__", "cz__": "rz__"})
    on = (F.col("cx__") == F.col("rx__")) & (F.col("cz__") == F.col("rz__"))
    for lk, rk in keys:
        on = on & (F.col(lk) == F.col(rk))
    if dense:
        tasks = DENSE * left.sparkSession.sparkContext.defaultParallelism
        a, b = a.repartition(tasks, "cx__", "cz__", *(lk for lk, _ in keys)), b.repartition(tasks, "rx__", "rz__", *(rk for _, rk in keys))
    # A short table may cover many cells, and a broadcast of them goes through the driver.
    met = a.join(b.hint("merge"), on, how)
    first = (F.col("cx__") == F.greatest("l__x0", "r__x0")) & (F.col("cz__") == F.greatest("l__z0", "r__z0"))
    return met.where(first).drop("cx__", "cz__", "rx__", "rz__", "l__x0", "l__z0", "r__x0", "r__z0")


def lots_join(left: DataFrame, right: DataFrame, left_box: Sequence[Column], right_box: Sequence[Column], cell: float, tell: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: StructType, keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """What tell() makes of the rows of both sides that meet in a cell, for joins of far more pairs than rows; see meeting().

    No pair is a row before tell() returns it: only the two sides are dealt out, and a task forms and decides the pairs of a cell by the
    batch. Cells of many rows are divided in lots, so a task holds two lots and what is made of them, however many rows a cell has."""
    spark = left.sparkSession
    given = lambda df, box, p: df.withColumns({f"{p}{n}": c.cast("double") for n, c in zip(CORNERS, box, strict=True)})
    ends = lambda p: [F.col(f"{p}{n}") for n in CORNERS]
    a, b = with_cells(given(left, left_box, "l_"), *ends("l_"), cell, "l__"), with_cells(given(right, right_box, "r_"), *ends("r_"), cell, "r__")
    own = ["cx__", "cz__"]
    for n, (lk, rk) in enumerate(keys):
        own.append(f"key{n}__")
        a, b = a.withColumn(f"key{n}__", F.col(lk)), b.withColumn(f"key{n}__", F.col(rk))
    lots = lambda df, n: df.groupBy(*own).agg(F.ceil(F.count("*") / LOT).alias(n))
    hot = cut(lots(a, "la__").join(lots(b, "lb__").hint("merge"), own).where("la__ > 1 or lb__ > 1"))
    hot = checked(hot, hot.count())

    def dealt(df: DataFrame, mine: str, its: str, i: str, j: str) -> DataFrame:
        lot = F.pmod(F.xxhash64(*(c for c in df.columns if c not in own)), F.coalesce(mine, F.lit(1)))
        every = df.join(hot, own, "left").withColumn(i, lot).withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(its, F.lit(1)) - 1)))
        return every.drop("la__", "lb__").repartition(DENSE * spark.sparkContext.defaultParallelism, *own, "i__", "j__")

    on = [*own, "i__", "j__"]
    told = lambda l, r: pa.concat_tables(tell(l.combine_chunks(), r.combine_chunks()))  # noqa: E731, E741
    return dealt(a, "la__", "lb__", "i__", "j__").groupBy(*on).cogroup(dealt(b, "lb__", "la__", "j__", "i__").groupBy(*on)).applyInArrow(told, schema)


def meeting(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two lots of lots_join() whose boxes meet, edges included, in the first cell that they share, so many pairs at a time."""
    if not len(a) or not len(b):
        yield np.array([], np.int64), np.array([], np.int64)
        return
    number = lambda t, n: t.column(n).to_numpy()
    (ax0, az0, ax1, az1), (bx0, bz0, bx1, bz1) = ([number(t, p + n) for n in CORNERS] for t, p in ((a, "l_"), (b, "r_")))
    here = [(number(a, f"l__{c}0"), number(b, f"r__{c}0"), a.column(f"c{c}__")[0].as_py()) for c in "xz"]
    step = max(1, PAIRS // len(b))
    for k in range(0, len(a), step):
        of = slice(k, k + step)
        hit = (ax0[of, None] <= bx1) & (ax1[of, None] >= bx0) & (az0[of, None] <= bz1) & (az1[of, None] >= bz0)
        i, j = np.divmod(np.flatnonzero(hit), len(b))
        i += k
        first = np.logical_and(*(np.maximum(p[i], q[j]) == c for p, q, c in here))
        yield i[first], j[first]


def nearest(points: DataFrame, sites: DataFrame, keys: Sequence[str], reach: float, cell: float | None = None) -> DataFrame:
    """For points (pid, px, pz) the nearest of sites (sid, sx, sz) within reach: pid, sid, d; of equals the smallest sid.
    Points without a site in reach have no row. Both sides carry the columns of keys; a pid is unique with its keys.

    Sites of one place are one site. Points look at first only as far as a few sites lie, and those that find none twice as far in the
    next round, up to reach, so a point meets few sites however dense they are."""
    places = cut(sites.groupBy(*keys, "sx", "sz").agg(F.min("sid").alias("sid")))
    n, w, d = places.agg(F.count("*"), F.max("sx") - F.min("sx"), F.max("sz") - F.min("sz")).first()
    few = math.sqrt(max((w or 0.0) * (d or 0.0), 1e-12) * 2 / max(n, 1))
    halvings = max(0, min(FINEST, math.floor(math.log2(reach / few)))) if math.isfinite(few) and 0 < few < reach else 0
    renamed = places.withColumnsRenamed({k: f"{k}__s" for k in keys})
    box = lambda x, z, r: (F.col(x) - r, F.col(z) - r, F.col(x) + r, F.col(z) + r)
    found, left = [], points
    for k in range(halvings, -1, -1):
        near = reach / 2**k
        met = grid_join(left, renamed, box("px", "pz", near), box("sx", "sz", 0.0), near if k else cell or reach, [(k, f"{k}__s") for k in keys])
        gap = F.sqrt((F.col("px") - F.col("sx")) ** 2 + (F.col("pz") - F.col("sz")) ** 2)
        best = met.withColumn("d", gap).where(F.col("d") <= near).groupBy(*keys, "pid").agg(F.min(F.struct("d", "sid")).alias("best"))
        found.append(cut(best.select(*keys, "pid", F.col("best.sid").alias("sid"), F.col("best.d").alias("d"))))
        if k:
            left = cut(left.join(found[-1].select(*keys, "pid").hint("merge"), [*keys, "pid"], "left_anti"))
            if left.isEmpty():
                break
    return reduce(DataFrame.unionAll, found)
