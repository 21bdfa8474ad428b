"""Queries over rings: cutting, joining and shrinking, with closed forms or half-planes in SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators import parcels, polygons
from loomgrid.plans import tables as t
from loomgrid.plans.queries import query

# ---- combs: a bar with teeth, which a level cut takes apart


def combs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ring, nx, nz, c: a comb of two to five teeth for every part, and a half-plane that cuts it: above the middle of its teeth,
    below it, or aslant."""
    k = F.col("p_partkey").cast("long")
    x, z = t._spread(k, 37, 3401, 450), t._spread(k, 91, 3401, 450)
    told = t.dealt(spark, sf_dir, "part", "p_partkey").select(
        k.alias("id"), x.alias("x"), z.alias("z"), (2 + k % 4).cast("int").alias("teeth"), (1 + k % 3 / F.lit(2.0)).alias("tw"), (F.lit(1.0) + F.col("p_size") % 5 / F.lit(4.0)).alias("gw"), (2 + k % 5 / F.lit(4.0)).alias("bar"), (3 + k % 7 / F.lit(4.0)).alias("h")
    )
    pitch = F.col("tw") + F.col("gw")
    low, top = F.col("z") + F.col("bar"), F.col("z") + F.col("bar") + F.col("h")
    wide = F.col("x") + F.col("teeth") * pitch - F.col("gw")

    def tooth(j: Column) -> Column:
        left = F.col("x") + j * pitch
        own = rings.of((left + F.col("tw"), top), (left, top))
        return F.when(j > 0, F.concat(own, rings.of((left, low), (left - F.col("gw"), low)))).otherwise(own)

    ring = F.concat(rings.of((F.col("x"), F.col("z")), (wide, F.col("z"))), F.flatten(F.transform(F.sequence(F.col("teeth") - 1, F.lit(0), F.lit(-1)), tooth)))
    kind, half = F.col("id") % 3, F.col("z") + F.col("bar") + F.col("h") / 2
    nx = F.when(kind == 2, 1.0).otherwise(0.0)
    nz = F.when(kind == 0, -1.0).when(kind == 1, 1.0).otherwise(2.0)
    c = F.when(kind == 0, -half).when(kind == 1, half).otherwise((F.col("x") + wide) / 2 + 2 * half)
    return told.select("id", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"), nx.alias("nx"), nz.alias("nz"), c.alias("c"))


COMBS = """cb0 AS (
  SELECT p_partkey::BIGINT AS id, (p_partkey::BIGINT * 37 % 3401) / 4.0::DOUBLE - 450 AS x, (p_partkey::BIGINT * 91 % 3401) / 4.0::DOUBLE - 450 AS z, 2 + p_partkey % 4 AS teeth,
    1 + (p_partkey % 3) / 2.0::DOUBLE AS tw, 1 + (p_size % 5) / 4.0::DOUBLE AS gw, 2 + (p_partkey % 5) / 4.0::DOUBLE AS bar, 3 + (p_partkey % 7) / 4.0::DOUBLE AS h FROM part
), cb AS (
  SELECT *, x + teeth * (tw + gw) - gw AS wide, z + bar + h / 2 AS half, id % 3 AS kind FROM cb0
), planes AS (
  SELECT *, CASE WHEN kind = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nx, CASE kind WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS nz,
    CASE kind WHEN 0 THEN -half WHEN 1 THEN half ELSE (x + wide) / 2 + 2 * half END AS c FROM cb
), teeth AS (
  SELECT id, x, z + bar AS low, z + bar + h AS top, tw, gw, teeth, unnest(range(teeth)) AS j, nx, nz, c FROM planes
), points AS (
  SELECT id, 0 AS k, x AS px, z AS pz, nx, nz, c FROM planes UNION ALL SELECT id, 1, wide, z, nx, nz, c FROM planes
  UNION ALL SELECT id, 2 + (teeth - 1 - j) * 4, x + j * (tw + gw) + tw, top, nx, nz, c FROM teeth UNION ALL SELECT id, 3 + (teeth - 1 - j) * 4, x + j * (tw + gw), top, nx, nz, c FROM teeth
  UNION ALL SELECT id, 4 + (teeth - 1 - j) * 4, x + j * (tw + gw), low, nx, nz, c FROM teeth WHERE j > 0 UNION ALL SELECT id, 5 + (teeth - 1 - j) * 4, x + j * (tw + gw) - gw, low, nx, nz, c FROM teeth WHERE j > 0
)"""

# Chains of the ring inside the half-plane begin at a way in; the i-th way out along the line goes to the i-th way in, and chains that follow
# each other in a circle are a piece.
PIECES = f"""
WITH RECURSIVE {COMBS}, e AS (
  SELECT *, nx * px + nz * pz - c AS fp, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(pz) OVER w, first_value(pz) OVER w) AS qz
  FROM points WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), f AS (
  SELECT *, nx * qx + nz * qz - c AS fq FROM e
), g AS (
  SELECT *, fp <= 0 AS pin, fq <= 0 AS qin, px + (qx - px) * (fp / (fp - fq)) AS cx, pz + (qz - pz) * (fp / (fp - fq)) AS cz FROM f WHERE fp <= 0 OR fq <= 0
), crossed AS (
  SELECT *, row_number() OVER (PARTITION BY id, qin ORDER BY nx * cz - nz * cx, k) AS r FROM g WHERE pin <> qin
), chained AS (
  SELECT g.*, coalesce((SELECT max(k) FROM crossed i WHERE i.id = g.id AND i.qin AND i.k <= g.k), (SELECT max(k) FROM crossed i WHERE i.id = g.id AND i.qin)) AS chain FROM g
), follows AS (
  SELECT o.id, c.chain, i.k AS other, o.cx AS ox, o.cz AS oz, i.cx AS ix, i.cz AS iz FROM crossed o JOIN crossed i ON i.id = o.id AND i.r = o.r AND i.qin JOIN chained c ON c.id = o.id AND c.k = o.k WHERE NOT o.qin
), orbit AS (
  SELECT id, chain, chain AS here, 0 AS n FROM follows UNION ALL SELECT o.id, o.chain, f.other, n + 1 FROM orbit o JOIN follows f ON f.id = o.id AND f.chain = o.here WHERE n < 6
), named AS (
  SELECT id, chain, min(here) AS piece FROM orbit GROUP BY id, chain
), twice AS (
  SELECT id, chain, CASE WHEN pin THEN px ELSE cx END * CASE WHEN qin THEN qz ELSE cz END - CASE WHEN qin THEN qx ELSE cx END * CASE WHEN pin THEN pz ELSE cz END AS a FROM chained
  UNION ALL SELECT id, chain, ox * iz - ix * oz FROM follows
)
SELECT t.id, round(sum(a) / 2, 6) AS area FROM twice t JOIN named n ON n.id = t.id AND n.chain = t.chain GROUP BY t.id, piece
"""


@query(PIECES)
def comb_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of combs in a half-plane, each with its area (GEO-14)."""
    found = polygons.half_plane_pieces(combs(spark, sf_dir), "id")
    return found.select("id", F.round(rings.area(F.col("ring")), 6).alias("area"))


@query(
    f"""
WITH {t.SHAPES}, lines AS (
  SELECT id, x + w / 3 * 2 + z AS c FROM sh
), f AS (
  SELECT r.id, px, pz, qx, qz, px + pz - c AS fp, qx + qz - c AS fq FROM ring r JOIN lines USING (id)
), clipped AS (
  SELECT id, CASE WHEN fp <= 0 THEN px ELSE px + (qx - px) * (fp / (fp - fq)) END AS ax, CASE WHEN fp <= 0 THEN pz ELSE pz + (qz - pz) * (fp / (fp - fq)) END AS az,
    CASE WHEN fq <= 0 THEN qx ELSE px + (qx - px) * (fp / (fp - fq)) END AS bx, CASE WHEN fq <= 0 THEN qz ELSE pz + (qz - pz) * (fp / (fp - fq)) END AS bz, fp, fq FROM f WHERE fp <= 0 OR fq <= 0
), ends AS (
  SELECT id, max(CASE WHEN fp <= 0 AND fq > 0 THEN bx END) AS ox, max(CASE WHEN fp <= 0 AND fq > 0 THEN bz END) AS oz, max(CASE WHEN fp > 0 AND fq <= 0 THEN ax END) AS ix, max(CASE WHEN fp > 0 AND fq <= 0 THEN az END) AS iz FROM clipped GROUP BY id
)
SELECT c.id, count(DISTINCT 1) AS pieces, round(abs(sum(ax * bz - bx * az) + coalesce(max(ox * iz - ix * oz), 0)) / 2, 6) AS area FROM clipped c JOIN ends USING (id) GROUP BY c.id
"""
)
def house_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses cut aslant: one piece each, of the clipped area (GEO-14, GEO-13)."""
    told = t.shapes(spark, sf_dir).select("id", "ring", F.lit(1.0).alias("nx"), F.lit(1.0).alias("nz"), (F.col("x") + F.col("w") / 3 * 2 + F.col("z")).alias("c"))
    found = polygons.half_plane_pieces(told, "id").select("id", rings.area(F.col("ring")).alias("area"))
    return found.groupBy("id").agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 6).alias("area"))


TRIM_PAD, TRIM_LEAST = 0.25, 3.0


@query(
    f"""
WITH {t.SHAPES}, boxes AS (
  SELECT id, x, z, w, d, x + w * 0.75 - {TRIM_PAD} AS rx, z - d - {TRIM_PAD} AS rz FROM sh
), kept AS (
  -- the box covers the right quarter of the house's foot and all below it: what is left of it stays, or what is above
  SELECT id, (rx - x) * d + 2 * d / w * CASE WHEN rx - x <= w / 2 THEN (rx - x) * (rx - x) / 2 ELSE w * w / 8 + (rx - x - w / 2) * (w / 2 - (rx - x - w / 2) / 2) END AS at_left,
    x, z, w, d, rz + 2 * d + {TRIM_PAD} * 2 AS top FROM boxes
), above AS (
  SELECT id, at_left, CASE WHEN top >= z + 2 * d THEN 0 WHEN top >= z + d THEN (z + 2 * d - top) * (z + 2 * d - top) * w / d / 2 ELSE w * (z + d - top) + w * d / 2 END AS over FROM kept
)
SELECT id, round(greatest(at_left, over), 9) AS area FROM above WHERE greatest(at_left, over) > {TRIM_LEAST}
"""
)
def trimmed_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right of way leaves of houses (GEO-19)."""
    told = t.shapes(spark, sf_dir).select("id", "ring", (F.col("x") + F.col("w") * 0.75).alias("bx"), (F.col("z") - F.col("d")).alias("bz"), (F.col("w") * 2).alias("bw"), (F.col("d") * 2).alias("bd"))
    found = polygons.trimmed(told, "id", ("bx", "bz", "bw", "bd"), TRIM_PAD, TRIM_LEAST)
    return found.select("id", F.round(rings.area(F.col("ring")), 9).alias("area"))


# ---- bricks: rows of parcels, each row half a parcel off, with gaps


def bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wall, brick, ring: up to twenty parcels of 8 x 4 in four rows for every twenty parts; three in ten are missing."""
    k = F.col("p_partkey").cast("long")
    told = t.dealt(spark, sf_dir, "part", "p_partkey").select(k.alias("brick"), F.floor(k / 20).cast("long").alias("wall"), (k % 20).alias("i")).where((F.col("brick") * F.col("brick") + F.col("wall")) % 10 < 7)
    row, column = F.floor(F.col("i") / 5), F.col("i") % 5
    x, z = (column * 8 + row % 2 * 4 + F.col("wall") % 30 * 50).cast("double"), (row * 4 + F.floor(F.col("wall") / 30) * 20).cast("double")
    ring = rings.rect(x, z, F.lit(8.0), F.lit(4.0))
    return told.select("wall", "brick", F.when(F.col("brick") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"))


BRICKS = """bricks AS (
  SELECT k AS brick, k // 20 AS wall, k % 20 AS i FROM (SELECT p_partkey::BIGINT AS k FROM part) WHERE (k * k + k // 20) % 10 < 7
), cells AS (
  SELECT wall, (i % 5) * 2 + (i // 5) % 2 + h AS cx, i // 5 AS cz FROM bricks, (VALUES (0), (1)) AS halves(h)
), sides AS (
  SELECT wall, side, count(*) AS n FROM (
    SELECT wall, unnest([[cx, cz, 0], [cx, cz + 1, 0], [cx, cz, 1], [cx + 1, cz, 1]]) AS side FROM cells) GROUP BY wall, side
), rim AS (
  SELECT wall, count(*) * 4 AS perimeter FROM sides WHERE n = 1 GROUP BY wall
), spots AS (
  -- of the four cells around a point: how many there are, and whether two of them lie opposite
  SELECT wall, px, pz, count(*) AS n, abs(sum(s)) AS opposite FROM (
    SELECT wall, cx + dx AS px, cz + dz AS pz, CASE WHEN dx = dz THEN 1 ELSE -1 END AS s FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dx, dz)) GROUP BY wall, px, pz
), bends AS (
  SELECT wall, sum(CASE WHEN n = 1 OR n = 3 THEN 1 WHEN n = 2 AND opposite = 2 THEN 2 ELSE 0 END) AS corners,
    sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND opposite = 2 THEN 2 ELSE 0 END) // 4 AS outlines FROM spots GROUP BY wall
)"""


@query(f"WITH {BRICKS} SELECT wall, (count(*) * 16)::DOUBLE AS area, any_value(perimeter)::DOUBLE AS perimeter, any_value(corners)::BIGINT AS corners, any_value(outlines)::BIGINT AS outlines FROM cells JOIN rim USING (wall) JOIN bends USING (wall) GROUP BY wall")
def dissolved_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls of bricks as outlines: area, length and corners of all, and outlines less holes (GEO-18, SET-6)."""
    found = polygons.dissolve(bricks(spark, sf_dir), "wall", "brick")
    around = F.aggregate(rings.edges(F.col("ring")), F.lit(0.0), lambda s, e: s + F.sqrt((e["q"]["x"] - e["p"]["x"]) ** 2 + (e["q"]["z"] - e["p"]["z"]) ** 2))
    told = found.select("wall", rings.signed_area(F.col("ring")).alias("area"), around.alias("length"), F.size("ring").cast("long").alias("n"), F.when(F.col("hole"), -1).otherwise(1).cast("long").alias("turn"))
    return told.groupBy("wall").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("length"), 6).alias("perimeter"), F.sum("n").alias("corners"), F.sum("turn").alias("outlines"))


# ---- dumbbells: two squares and a neck, which closes where it is narrower than twice the distance


def dumbbells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ring, distances: two squares of side a, joined by a neck of length l and width w, for every part; all edges move alike."""
    k = F.col("p_partkey").cast("long")
    told = t.dealt(spark, sf_dir, "part", "p_partkey").select(
        k.alias("id"), t._spread(k, 37, 3401, 450).alias("x"), t._spread(k, 91, 3401, 450).alias("z"), (6 + k % 9 / F.lit(2.0)).alias("a"), (1 + k % 5 / F.lit(2.0)).alias("w"), (4 + k % 7 / F.lit(2.0)).alias("l"), (F.lit(0.625) + F.col("p_size") % 4 / F.lit(4.0)).alias("d")
    )
    x, z, a, w, l = (F.col(c) for c in "xzawl")  # noqa: E741
    low, high, far = z + a / 2 - w / 2, z + a / 2 + w / 2, x + a + l
    ring = rings.of((x, z), (x + a, z), (x + a, low), (far, low), (far, z), (far + a, z), (far + a, z + a), (far, z + a), (far, high), (x + a, high), (x + a, z + a), (x, z + a))
    return told.select("id", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"), F.array_repeat("d", 12).alias("distances"))


@query(
    """
WITH db AS (
  SELECT p_partkey::BIGINT AS id, 6 + (p_partkey % 9) / 2.0::DOUBLE AS a, 1 + (p_partkey % 5) / 2.0::DOUBLE AS w, 4 + (p_partkey % 7) / 2.0::DOUBLE AS l, 0.625::DOUBLE + (p_size % 4) / 4.0::DOUBLE AS d FROM part
)
SELECT id, round(2 * (a - 2 * d) * (a - 2 * d) + (w - 2 * d) * (l + 2 * d), 6) AS area, 12::BIGINT AS corners FROM db WHERE w > 2 * d
UNION ALL SELECT id, round((a - 2 * d) * (a - 2 * d), 6), 4::BIGINT FROM db, (VALUES (1), (2)) AS lobes(n) WHERE w < 2 * d
"""
)
def dumbbell_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumbbells shrunk: in one piece, or in two where the neck closes (GEO-17)."""
    found = polygons.inset(dumbbells(spark, sf_dir), "id")
    return found.select("id", F.round(rings.area(F.col("ring")), 6).alias("area"), F.size("ring").cast("long").alias("corners"))


INSET = 0.5


@query(
    f"""
WITH {t.SHAPES}, b AS (
  SELECT id, px, pz, qx, qz, coalesce(lag(px) OVER w, last_value(px) OVER w) AS ox, coalesce(lag(pz) OVER w, last_value(pz) OVER w) AS oz
  FROM ring WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), turned AS (
  SELECT id, px * qz - qx * pz AS twice, sqrt((qx - px) * (qx - px) + (qz - pz) * (qz - pz)) AS len,
    abs(tan(atan2((px - ox) * (qz - pz) - (pz - oz) * (qx - px), (px - ox) * (qx - px) + (pz - oz) * (qz - pz)) / 2)) AS bend FROM b
)
SELECT id, round(abs(sum(twice)) / 2 - sum(len) * {INSET} + sum(bend) * {INSET} * {INSET}, 6) AS area, true AS same FROM turned GROUP BY id
"""
)
def house_insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses shrunk by half a unit, as a mitred offset and by events, which agree as no edge vanishes (GEO-16, GEO-17)."""
    told = t.shapes(spark, sf_dir).select("id", "ring", F.array_repeat(F.lit(INSET), 5).alias("distances"))
    shrunk = polygons.inset(told, "id").select("id", rings.area(F.col("ring")).alias("shrunk"))
    moved = told.select("id", rings.area(rings.offset(rings.ccw(F.col("ring")), F.col("distances"))).alias("area"))
    return moved.join(shrunk.hint("merge"), "id").select("id", F.round("area", 6).alias("area"), (F.abs(F.col("area") - F.col("shrunk")) < 1e-6).alias("same"))




# ---- parcels

TARGET, LEAST_WIDTH = 12.0, 1.0


@query(f"WITH {t.SHAPES} SELECT id, round(w * d * 3 / 2, 6) AS area, 0::BIGINT AS over FROM sh")
def house_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses cut in parcels, which tile them, and none is left that could be halved (FAB-7, FAB-15)."""
    found = parcels.subdivide(t.shapes(spark, sf_dir), "id", TARGET, LEAST_WIDTH, least_area=0.0)
    large = rings.let(rings.oriented_box(F.col("ring")), lambda box: F.least(box["w"], box["d"]) >= 2 * LEAST_WIDTH)
    told = found.select("id", rings.area(F.col("ring")).alias("area"), (F.when(rings.area(F.col("ring")) >= TARGET, large).otherwise(False)).alias("large"))
    return told.groupBy("id").agg(F.round(F.sum("area"), 6).alias("area"), F.count_if("large").alias("over"))


@query(
    f"""
WITH RECURSIVE {BRICKS}, own AS (SELECT b.wall, b.brick, i, c.cx, c.cz FROM bricks b JOIN (SELECT wall, brick, (i % 5) * 2 + (i // 5) % 2 + h AS cx, i // 5 AS cz FROM bricks, (VALUES (0), (1)) AS halves(h)) c USING (wall, brick)),
beside AS (SELECT DISTINCT a.brick AS a, b.brick AS b FROM own a JOIN own b ON a.wall = b.wall AND abs(a.cx - b.cx) + abs(a.cz - b.cz) = 1),
hang AS (SELECT brick AS a, brick AS b FROM bricks UNION SELECT h.a, n.b FROM hang h JOIN beside n ON n.a = h.b),
comps AS (SELECT a AS brick, min(b) AS comp FROM hang GROUP BY a), sums AS (SELECT wall, comp, count(*) AS bricks, count(*) FILTER (WHERE i < 5) AS fronts FROM bricks JOIN comps USING (brick) GROUP BY wall, comp)
SELECT wall, sum(CASE WHEN fronts > 0 THEN fronts ELSE bricks END)::BIGINT AS parcels, sum(CASE WHEN fronts > 0 THEN 0 ELSE bricks END)::BIGINT AS landlocked, sum(bricks)::BIGINT AS members, (sum(bricks) * 32)::DOUBLE AS area FROM sums GROUP BY wall"""
)
def merged_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of which only the lowest row has frontage, joined to neighbours that have (FAB-9, JN-17)."""
    wall = bricks(spark, sf_dir).withColumn("frontage", F.col("brick") % 20 < 5)
    found = parcels.merge_landlocked(wall, "wall", "brick")
    size = rings.area(F.col("ring")) - F.aggregate("holes", F.lit(0.0), lambda s, h: s + rings.area(h))
    told = found.select("wall", "members", "frontage", size.alias("area"))
    return told.groupBy("wall").agg(F.count("*").alias("parcels"), F.count_if(~F.col("frontage")).alias("landlocked"), F.sum("members").alias("members"), F.round(F.sum("area"), 6).alias("area"))
