"""Blocks in parcels: recursive halving of all rings at once, and merging of parcels that no street reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from loomgrid.functions import halves, rings
from loomgrid.operators.components import connected_components
from loomgrid.operators.land import adjacent
from loomgrid.operators.polygons import dissolve
from loomgrid.operators.shared import Rounds, cut

# How far off the middle a cut may be, how often a ring is halved, the least area of a piece, and the shares of the least
# width that a parcel's area and its sides have to reach.
JITTER, MOST_HALVINGS, LEAST_AREA = 0.12, 9, 4.0
LEAST_SHARE, LEAST_SIDE = 0.8, 0.7
SAME = 1e-9  # points of a parcel that are one: a cut this near a corner takes no area that would be told


def _draw(seed: str, *columns: str) -> Column:
    """A number from -1 to 1 that the values settle."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2_000_001)) / 1_000_000.0 - 1.0


def subdivide(blocks: DataFrame, key: str, target: float, least_width: float, seed: str = "parcels", ring: str = "ring", halvings: int = MOST_HALVINGS, least_area: float = LEAST_AREA) -> DataFrame:
    """(key, path, ring, sliver): each ring in parcels. A ring of the target area or more is halved across the longer side of its
    oriented box, near the middle, as long as both sides are twice the least width; path tells which piece of which half it is, and settles
    where the next cut lies. Parcels that are too small or too narrow to use are slivers; what is below least_area is dropped, so the other
    parcels tile the ring.

    A round halves all open rings, those of a batch together, within their tasks; each round writes only what it made. The rounds are
    `halvings` at most."""
    begin = blocks.where(F.size(F.coalesce(F.col(ring), F.array().cast(rings.RING))) >= 3)
    now = begin.select(F.col(key), F.lit("").alias("path"), F.col(ring).alias("ring"), F.lit(None).cast("double").alias("draw"))
    made = StructType([*now.schema.fields[:3], StructField("open", BooleanType()), StructField("sliver", BooleanType())])
    rounds = []
    for n in range(halvings + 1):
        rounds.append(cut(now.mapInArrow(_halving(target, least_width, least_area, n < halvings), made)))
        now = rounds[-1].where("open").select(key, "path", "ring", _draw(seed, key, "path").alias("draw"))
        if now.isEmpty():
            break
    return reduce(DataFrame.unionAll, (made.where("not open").select(key, "path", "ring", "sliver") for made in rounds))


def _halving(target: float, least_width: float, least_area: float, further: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches (key, path, ring, draw) to the parcels that the cuts leave: key, path, ring, open (whether it has to be halved),
    sliver. Without a draw the ring itself is a parcel."""

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = halves.of_arrow(batch.column("ring")), batch.column("draw").null_count > 0
            told = (halves.ccw(own), np.arange(batch.num_rows), batch.column("path")) if first else _cut(own, batch.column("draw").to_numpy(), batch.column("path"))
            areas = np.abs(halves.signed_areas(told[0]))
            usable = areas >= least_area
            if not usable.any():
                continue
            found, of, paths = halves.chosen(told[0], usable), told[1][usable], told[2].filter(pa.array(usable))
            *_, w, d, _ = halves.oriented_boxes(found)
            areas, narrow = areas[usable], np.minimum(w, d)
            fit = (areas >= target) & (narrow >= 2 * least_width) & further
            sliver = (areas < least_width * least_width * LEAST_SHARE) | (narrow < least_width * LEAST_SIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), paths, halves.to_arrow(found), pa.array(fit), pa.array(sliver)], names=[batch.schema.names[0], "path", "ring", "open", "sliver"])

    return parcels


def _cut(own: halves.Rings, draw: np.ndarray, paths: pa.Array) -> tuple[halves.Rings, np.ndarray, pa.Array]:
    """The pieces of rings halved across the longer side of their boxes, the ring that each is of, and its path."""
    cx, cz, w, d, angle = halves.oriented_boxes(own)
    long, c, s = w >= d, np.cos(angle), np.sin(angle)
    nx, nz = np.where(long, c, -s), np.where(long, s, c)
    middle = nx * cx + nz * cz + draw * JITTER * np.maximum(w, d)
    sides = [halves.pieces(own, nx * way, nz * way, middle * way, SAME) for way in (1.0, -1.0)]
    marks = []
    for half, (found, of) in zip("ab", sides, strict=True):
        x, z = (np.round(v, 4) for v in halves.centroids(found))
        order = np.lexsort((z, x, of))
        fresh = np.diff(of[order], prepend=-1) != 0
        nth = np.empty(len(of), np.int64)
        nth[order] = np.arange(len(of)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        marks += [half + str(k) for k in nth]
    of = np.concatenate([of for _, of in sides])
    return halves.joined(*(found for found, _ in sides)), of, pc.binary_join_element_wise(paths.take(pa.array(of)), pa.array(marks, pa.string()), "")


def merge_landlocked(parcels: DataFrame, group: str, parcel: str, ring: str = "ring", frontage: str = "frontage", most_rounds: int = 60, tol: float = 1e-6) -> DataFrame:
    """(group, parcel, ring, holes, frontage, members): parcels without frontage joined to neighbours until none is left that could be.

    Parcels that share boundary hang together; where one of such a component has frontage, each without it picks the neighbour it
    shares most boundary with (of equals the least), and all that picked each other become one, which has frontage if one of them
    has. Components without any frontage stay as they are. A parcel that encloses another gets a hole where that is. The id of a
    merged parcel is the least of its members. Every round at least halves the parcels of a component that still lack frontage."""
    spark = parcels.sparkSession
    own = cut(parcels.select(F.col(group).alias("piece"), F.col(parcel).cast("long").alias("parcel"), rings.ccw(F.col(ring)).alias("ring"), F.coalesce(F.col(frontage), F.lit(False)).alias("frontage")))
    edges = cut(adjacent(own.select("piece", "parcel", "ring"), tol))
    hang = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = own.join(hang, own["parcel"] == hang["node"], "left").select("piece", "parcel", F.coalesce("component", "parcel").alias("component"), "frontage")
    lucky = named.groupBy("component").agg(F.max("frontage").alias("any")).where("any").select("component")
    usable = cut(named.join(lucky, "component", "left_semi").select("parcel", "frontage"))
    both = edges.unionByName(edges.select("piece", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    both = cut(both.join(usable.select(F.col("parcel").alias("a")), "a", "left_semi"))
    rounds = Rounds(spark, "landlocked")
    now = rounds.put(usable.select("parcel", F.col("parcel").alias("owner"), "frontage"))  # owner: the merged parcel that a parcel belongs to
    for _ in range(most_rounds):
        reached = now.groupBy("owner").agg(F.max("frontage").alias("frontage"))
        waiting = cut(reached.where("not frontage").select("owner"))
        if waiting.isEmpty():
            break
        ends = both.join(now.select(F.col("parcel").alias("a"), F.col("owner").alias("from")), "a").join(now.select(F.col("parcel").alias("b"), F.col("owner").alias("to")), "b").where(F.col("from") != F.col("to"))
        shared = ends.join(waiting.withColumnRenamed("owner", "from"), "from", "left_semi").groupBy("from", "to").agg(F.sum("shared").alias("shared"))
        picks = shared.groupBy("from").agg(F.max(F.struct(F.round("shared", 6).alias("shared"), (-F.col("to")).alias("to"))).alias("best")).select("from", (-F.col("best.to")).alias("to"))
        joined = connected_components(cut(picks), "from", "to")
        now = rounds.put(now.join(joined, now["owner"] == joined["node"], "left").select("parcel", F.coalesce("component", "owner").alias("owner"), "frontage"))
    else:
        raise RuntimeError(f"parcels did not settle in {most_rounds} rounds")
    owners = rounds.end(own.join(now.select("parcel", "owner"), "parcel", "left").select("piece", "parcel", F.coalesce("owner", "parcel").alias("owner"), "frontage"))
    counts = owners.groupBy("piece", "owner").agg(F.count("*").alias("members"), F.max("frontage").alias("frontage"))
    shapes = own.select("parcel", "ring").join(owners, "parcel")
    alone = counts.where("members = 1")
    kept = shapes.join(alone.select("owner"), "owner", "left_semi").select("owner", "ring", F.array().cast(f"array<{rings.RING}>").alias("holes"))
    several = counts.where("members > 1").select("owner")
    outlines = dissolve(shapes.join(several, "owner", "left_semi"), "owner", "parcel")
    whole = outlines.groupBy("owner").agg(F.max_by("ring", F.when(~F.col("hole"), rings.area(F.col("ring")))).alias("ring"), F.filter(F.collect_list(F.when(F.col("hole"), F.col("ring"))), lambda r: r.isNotNull()).alias("holes"))
    return counts.join(kept.unionAll(whole), "owner").select(F.col("piece").alias(group), F.col("owner").alias(parcel), "ring", "holes", "frontage", "members")
