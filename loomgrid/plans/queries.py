"""The registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions import fields, randoms, rings, scalars, segments, tags
from loomgrid.functions.projection import Projection, in_view
from loomgrid.operators import land, network, noding
from loomgrid.operators.components import connected_components
from loomgrid.operators.grid_join import grid_join, nearest
from loomgrid.operators.numbering import numbered
from loomgrid.plans import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _near(name: str, places: int = 6) -> str:
    return f"round({name}, {places})"


# ---- scalars

FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((xor(h, c) * 16777619) % 4294967296))"


@query(f"SELECT c_custkey, {FNV.format('c_name')} AS h, {FNV.format(chr(39) + 'city:' + chr(39) + ' || c_mktsegment')} AS s FROM customer")
def fnv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of names (SCL-1)."""
    return t.read(spark, sf_dir, "customer").select("c_custkey", randoms.hash_text(F.col("c_name")).alias("h"), randoms.hash_text(F.concat(F.lit("city:"), "c_mktsegment")).alias("s"))


STEP = "(({0}) * 1664525 + 1013904223) % 4294967296"


@query(
    f"""
WITH s0 AS (SELECT s_suppkey, {FNV.format("s_suppkey::VARCHAR || ':traffic'")} AS s FROM supplier),
s1 AS (SELECT *, {STEP.format("CASE WHEN s = 0 THEN 2654435769 ELSE s END")} AS a FROM s0), s2 AS (SELECT *, {STEP.format("a")} AS b FROM s1), s3 AS (SELECT *, {STEP.format("b")} AS c FROM s2)
SELECT s_suppkey, a / 4294967296.0::DOUBLE AS u1, b / 4294967296.0::DOUBLE AS u2, c / 4294967296.0::DOUBLE AS u3, 5 + floor(b / 4294967296.0::DOUBLE * 7) AS k, -2 + 6 * (c / 4294967296.0::DOUBLE) AS f, a / 4294967296.0::DOUBLE < 0.3 AS yes,
  ['tower', 'slab', 'block'][CAST(floor(c / 4294967296.0::DOUBLE * 3) + 1 AS INTEGER)] AS style FROM s3"""
)
def lcg_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three draws of each supplier's stream, and what they choose (SCL-2)."""
    u = randoms.draws(randoms.stream(F.col("s_suppkey"), "traffic"), 3)
    told = t.read(spark, sf_dir, "supplier").withColumn("u", u)
    at = lambda k: F.element_at("u", k)
    return told.select("s_suppkey", at(1).alias("u1"), at(2).alias("u2"), at(3).alias("u3"), randoms.whole(at(2), 5, 11).cast("double").alias("k"), randoms.between(at(3), -2, 4).alias("f"), randoms.chance(at(1), 0.3).alias("yes"), randoms.pick(at(3), F.array(*map(F.lit, ("tower", "slab", "block")))).alias("style"))


@query("SELECT l_orderkey, l_linenumber, floor((l_extendedprice - 30000) / 0.25 + 0.5) * 0.25::DOUBLE + 0.0 AS q, floor(l_discount * 100 / 0.25 - 3 + 0.5) * 0.25::DOUBLE AS r FROM lineitem")
def quantize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding to the grid, halves upwards (SCL-4)."""
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.quantize(F.col("l_extendedprice") - 30000).alias("q"), (F.floor(F.col("l_discount") * 100 / 0.25 - 3 + 0.5) * 0.25).alias("r"))


@query(f"WITH {t.POINTS} SELECT id, x, z FROM pts WHERE x BETWEEN -200 AND 200 AND z BETWEEN -200 AND 200")
def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a window of 400 metres (FLT-13)."""
    return t.points(spark, sf_dir).where(in_view(F.col("x"), F.col("z"), 400.0)).select("id", "x", "z")


DEGREE = repr(math.pi / 180 * 6378137.0)


@query(
    f"""
WITH {t.POINTS}, g AS (SELECT id, x / 1000 AS lon, z / 1000 AS lat FROM pts)
SELECT id, round((lon - 0.125) * {DEGREE}, 6) + 0.0 AS x, round(-(lat * {DEGREE}), 6) + 0.0 AS z, round(0.125 + ((lon - 0.125) * {DEGREE}) / {DEGREE}, 9) AS lon, round(0 - (-(lat * {DEGREE})) / {DEGREE}, 9) + 0.0 AS lat FROM g"""
)
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To local metres and back (GEO-1)."""
    p = Projection(0.125, 0.0)
    told = t.points(spark, sf_dir).select("id", p.forward(F.col("x") / 1000, F.col("z") / 1000).alias("m"))
    back = p.inverse(F.col("m.x"), F.col("m.z"))
    return told.select("id", (F.round("m.x", 6) + 0.0).alias("x"), (F.round("m.z", 6) + 0.0).alias("z"), F.round(back["lon"], 9).alias("lon"), (F.round(back["lat"], 9) + 0.0).alias("lat"))


TURN = repr(2 * math.pi)
PI = repr(math.pi)


@query(
    f"""
WITH {t.MOVES}, h AS (SELECT uid, seq, atan2(bz - az, bx - ax) AS h, atan2(bx - ax, bz - az) * 3 AS g, ax, az, bx, bz FROM mv WHERE ax <> bx OR az <> bz),
d AS (SELECT *, fmod(h - g, {TURN}) AS r FROM h),
a AS (SELECT *, CASE WHEN r > {PI} THEN r - {TURN} WHEN r <= -{PI} THEN r + {TURN} ELSE r END AS diff FROM d)
SELECT uid, seq, round(diff, 6) AS diff, round(abs(diff), 6) AS gap, round(sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)), 6) AS dist,
  CASE WHEN (bx - ax) * (0 - az) - (bz - az) * (0 - ax) > 1e-9 THEN 1 WHEN (bx - ax) * (0 - az) - (bz - az) * (0 - ax) < -1e-9 THEN -1 ELSE 0 END AS turn,
  greatest(0.0, least(abs(diff) / 4, abs(diff) / 2 - CASE WHEN uid % 2 = 0 THEN 3.4 ELSE 1.9 END)) AS lane0, round(greatest(0.0, least((seq % 30) / 4.0::DOUBLE, (seq % 30) / 2.0::DOUBLE - CASE WHEN uid % 2 = 0 THEN 3.4 ELSE 1.9 END)), 6) AS lane
FROM a""".replace("greatest(0.0, least(abs(diff) / 4, abs(diff) / 2 - CASE WHEN uid % 2 = 0 THEN 3.4 ELSE 1.9 END)) AS lane0, ", "")
)
def angles_and_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, turns, distances and lanes of moves (SCL-5, 6, 7, 12)."""
    m = t.moves(spark, sf_dir).where("ax <> bx or az <> bz")
    c = {n: F.col(n) for n in ("ax", "az", "bx", "bz")}
    h, g = F.atan2(c["bz"] - c["az"], c["bx"] - c["ax"]), F.atan2(c["bx"] - c["ax"], c["bz"] - c["az"]) * 3
    return m.select("uid", "seq", F.round(scalars.angle_diff(h, g), 6).alias("diff"), F.round(scalars.angle_between(h, g), 6).alias("gap"), F.round(scalars.distance(*c.values()), 6).alias("dist"), scalars.orient(*c.values(), F.lit(0.0), F.lit(0.0)).alias("turn"), F.round(scalars.right_lane_offset((F.col("seq") % 30).cast("double"), F.col("uid") % 2 == 0), 6).alias("lane"))


# ---- segments

CLIP = """cl0 AS (
  SELECT *, bx - ax AS dx, bz - az AS dz FROM mv
), cl1 AS (
  SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (-450 - ax) / dx WHEN dx < 0 THEN (450 - ax) / dx ELSE 0 END, CASE WHEN dz > 0 THEN (-450 - az) / dz WHEN dz < 0 THEN (450 - az) / dz ELSE 0 END) AS lo,
    least(1.0, CASE WHEN dx > 0 THEN (450 - ax) / dx WHEN dx < 0 THEN (-450 - ax) / dx ELSE 1 END, CASE WHEN dz > 0 THEN (450 - az) / dz WHEN dz < 0 THEN (-450 - az) / dz ELSE 1 END) AS hi,
    (dx = 0 AND (ax < -450 OR ax > 450)) OR (dz = 0 AND (az < -450 OR az > 450)) AS gone FROM cl0
), cl AS (SELECT * FROM cl1 WHERE NOT gone AND hi - lo > 1e-12)"""


@query(f"WITH {t.MOVES}, {CLIP} SELECT uid, seq, {_near('ax + dx * lo')} + 0.0 AS cax, {_near('az + dz * lo')} + 0.0 AS caz, {_near('ax + dx * hi')} + 0.0 AS cbx, {_near('az + dz * hi')} + 0.0 AS cbz FROM cl")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves clipped to the viewport (GEO-4)."""
    c = segments.clip_open(*(F.col(n) for n in ("ax", "az", "bx", "bz")), -450, 450, -450, 450)
    told = t.moves(spark, sf_dir).withColumn("c", c).where("c is not null")
    return told.select("uid", "seq", *((F.round(F.col(f"c.{n}"), 6) + 0.0).alias(f"c{n}") for n in ("ax", "az", "bx", "bz")))


@query(
    f"""
WITH {t.MOVES}, {CLIP}, b AS (SELECT uid, seq, lo, hi, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(hi) OVER w = 1 AND lo = 0 THEN 0 ELSE 1 END AS brk FROM cl WINDOW w AS (PARTITION BY uid ORDER BY seq)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY uid ORDER BY seq) AS piece FROM b)
SELECT uid, piece::BIGINT AS piece, min(seq) AS first_seq, max(seq) AS last_seq, count(*) + 1 AS n_points FROM i GROUP BY uid, piece"""
)
def clip_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of clipped moves without a gap (GEO-3, WIN-7)."""
    from loomgrid.operators.lines import clip_runs

    runs = clip_runs(t.moves(spark, sf_dir), ["uid"], "seq", (-450, 450, -450, 450))
    return runs.groupBy("uid", "piece").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.count("*") + 1).alias("n_points"))


CROSS = """cr AS (
  SELECT a.src AS s1, b.src AS s2, (a.bx - a.ax) * (b.bz - b.az) - (a.bz - a.az) * (b.bx - b.ax) AS den, a.ax, a.az, a.bx - a.ax AS rx, a.bz - a.az AS rz,
    ((b.ax - a.ax) * (b.bz - b.az) - (b.az - a.az) * (b.bx - b.ax)) AS tn, ((b.ax - a.ax) * (a.bz - a.az) - (b.az - a.az) * (a.bx - a.ax)) AS un
  FROM st a JOIN st b ON a.src < b.src AND a.level = b.level
)"""


@query(
    f"""
WITH {t.STREETS}, {CROSS}, c AS (SELECT *, tn / den AS t, un / den AS u FROM cr WHERE abs(den) >= 1e-9)
SELECT s1, s2, {_near('t')} AS t, {_near('u')} AS u, {_near('ax + rx * t')} AS x, {_near('az + rz * t')} AS z FROM c WHERE t BETWEEN -1e-7 AND 1 + 1e-7 AND u BETWEEN -1e-7 AND 1 + 1e-7"""
)
def street_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of streets of one level that cross (JN-1, GEO-5)."""
    s = t.streets(spark, sf_dir).drop("part", "cls")
    o = s.toDF("s2", "cx", "cz", "dx", "dz", "level2")
    box = lambda ax, az, bx, bz: (F.least(ax, bx), F.least(az, bz), F.greatest(ax, bx), F.greatest(az, bz))
    met = grid_join(s, o, box("ax", "az", "bx", "bz"), box("cx", "cz", "dx", "dz"), 40.0, [("level", "level2")]).where("src < s2")
    told = met.withColumn("k", segments.intersect(*(F.col(n) for n in ("ax", "az", "bx", "bz", "cx", "cz", "dx", "dz")))).where("k is not null")
    return told.select(F.col("src").alias("s1"), "s2", *(F.round(F.col(f"k.{n}"), 6).alias(n) for n in ("t", "u", "x", "z")))


@query(
    f"""
WITH {t.STREETS}, {t.POINTS}, d AS (
  SELECT id, src, ax, az, bx, bz, x, z, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)))) AS t FROM pts, st WHERE id % 10 = 0
), e AS (SELECT id, src, sqrt((x - (ax + (bx - ax) * t)) * (x - (ax + (bx - ax) * t)) + (z - (az + (bz - az) * t)) * (z - (az + (bz - az) * t))) AS d FROM d)
SELECT id, {_near('min(d)')} AS d, arg_min(src, [d, src::DOUBLE]) AS src FROM e GROUP BY id""".replace("WHERE id % 10 = 0", "")
)
def street_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest street of every point (GEO-7, JN-5, JN-11)."""
    from loomgrid.operators.lines import nearest_lines

    found = nearest_lines(t.points(spark, sf_dir).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("z").alias("pz")), t.streets(spark, sf_dir).select(F.col("src").alias("line"), "ax", "az", "bx", "bz"), 64.0)
    return found.select(F.col("pid").alias("id"), F.round("d", 6).alias("d"), F.col("line").alias("src"))


# ---- rings

CENTROID = """m AS (
  SELECT id, sum(px * qz - qx * pz) / 2 AS a, sum((px + qx) * (px * qz - qx * pz)) AS cx, sum((pz + qz) * (px * qz - qx * pz)) AS cz, min(px) AS x0, min(pz) AS z0, max(px) - min(px) AS w, max(pz) - min(pz) AS d FROM ring GROUP BY id
)"""


@query(f"WITH {t.SHAPES}, {CENTROID} SELECT id, a AS signed, abs(a) AS area, {_near('cx / (6 * a)')} AS cx, {_near('cz / (6 * a)')} AS cz, x0, z0, w, d FROM m")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centroid and box of rings (GEO-8, AGG-5)."""
    r = F.col("ring")
    told = t.shapes(spark, sf_dir).select("id", rings.signed_area(r).alias("signed"), rings.centroid(r).alias("c"), rings.bounds(r).alias("b"))
    return told.select("id", "signed", F.abs("signed").alias("area"), F.round("c.x", 6).alias("cx"), F.round("c.z", 6).alias("cz"), F.col("b.x").alias("x0"), F.col("b.z").alias("z0"), F.col("b.w").alias("w"), F.col("b.d").alias("d"))


INSIDE = """ins AS (
  SELECT p.id AS pid, r.id AS area FROM pts p JOIN ring r ON (r.pz > p.z) <> (r.qz > p.z) AND p.x < (r.px - r.qx) * (p.z - r.qz) / (r.pz - r.qz) + r.qx GROUP BY p.id, r.id HAVING count(*) % 2 = 1
)"""


@query(f"WITH {t.SHAPES}, {t.POINTS}, {INSIDE} SELECT pid, area FROM ins")
def point_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that points lie in (GEO-9, JN-6)."""
    pts = t.points(spark, sf_dir).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("z").alias("pz"))
    return land.owners(pts, t.shapes(spark, sf_dir).select(F.col("id").alias("area"), "ring"), 16.0, dense=True)


@query(f"WITH {t.SHAPES}, b AS (SELECT id, x, z, w, d * 2 AS d FROM sh) SELECT a.id AS one, b.id AS two FROM b a JOIN b ON a.id < b.id AND a.x < b.x + b.w AND a.x + a.w > b.x AND a.z < b.z + b.d AND a.z + a.d > b.z")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes whose boxes overlap (GEO-19)."""
    a = t.shapes(spark, sf_dir).select(F.col("id").alias("one"), rings.bounds(F.col("ring")).alias("p"))
    b = a.select(F.col("one").alias("two"), F.col("p").alias("q"))
    box = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.z"), F.col(f"{c}.x") + F.col(f"{c}.w"), F.col(f"{c}.z") + F.col(f"{c}.d"))
    fields_of = lambda c: (F.col(f"{c}.{n}") for n in "xzwd")
    return grid_join(a, b, box("p"), box("q"), 16.0, dense=True).where((F.col("one") < F.col("two")) & rings.boxes_meet(*fields_of("p"), *fields_of("q"))).select("one", "two")


@query(f"WITH {t.SHAPES}, b AS (SELECT id, x, z, w, d FROM sh), r AS (SELECT * FROM b WHERE id % 5 = 0) SELECT id, x, z FROM b WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM r WHERE b.x < r.x + r.w AND b.x + b.w > r.x AND b.z < r.z + r.d AND b.z + b.d > r.z)")
def clear_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular lots that overlap no reserved one (JN-7, FLT-20)."""
    rows = t.shapes(spark, sf_dir).select("id", "x", "z", rings.rect(F.col("x"), F.col("z"), F.col("w"), F.col("d")).alias("ring"))
    return land.clear_of(rows.where(F.col("id") % 5 != 0), rows.where(F.col("id") % 5 == 0), "id", 16.0).select("id", "x", "z")


@query(f"WITH {t.SHAPES}, e AS (SELECT r.id, sqrt((px - qx) * (px - qx) + (pz - qz) * (pz - qz)) AS l FROM ring r) SELECT id, {_near('sum(l)')} AS around, {_near('max(l)')} AS longest FROM e GROUP BY id")
def ring_perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length around rings and their longest edge (AGG-4, WIN-1)."""
    es = F.transform(rings.edges(F.col("ring")), lambda e: scalars.distance(e["p"]["x"], e["p"]["z"], e["q"]["x"], e["q"]["z"]))
    told = t.shapes(spark, sf_dir).select("id", es.alias("l"))
    return told.select("id", F.round(F.aggregate("l", F.lit(0.0), lambda s, x: s + x), 6).alias("around"), F.round(F.array_max("l"), 6).alias("longest"))


# ---- tags

TAGS = """tg AS (
  SELECT p_partkey AS id, p_size, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN ' No ' WHEN 2 THEN '0' WHEN 3 THEN NULL WHEN 4 THEN 'house' ELSE '' END AS building,
    CASE p_partkey % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'basin' WHEN 2 THEN ' ' WHEN 3 THEN 'Grass' ELSE NULL END AS landuse, CASE p_partkey % 7 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' ELSE NULL END AS "natural", CASE p_partkey % 11 WHEN 0 THEN 'park' WHEN 1 THEN 'building' WHEN 2 THEN 'water' ELSE NULL END AS kind,
    CASE p_partkey % 9 WHEN 0 THEN 'no' WHEN 1 THEN 'stream' ELSE NULL END AS waterway, CASE p_partkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN '-3' WHEN 2 THEN '9 m' ELSE NULL END AS height, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR ELSE NULL END AS levels FROM part
)"""
OFF = "('', '0', 'false', 'no', 'off')"
WET = "('water', 'reservoir', 'basin', 'pond', 'lake', 'river', 'riverbank', 'canal', 'wetland', 'marsh', 'swimming_pool')"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    choose = lambda n, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % n + 1).cast("int"))
    made = {
        "building": choose(6, "yes", " No ", "0", None, "house", ""),
        "landuse": choose(5, "forest", "basin", " ", "Grass", None),
        "natural": choose(7, "water", "wood", None, None, None, None, None),
        "kind": choose(11, "park", "building", "water", *[None] * 8),
        "waterway": choose(9, "no", "stream", *[None] * 7),
        "height": choose(4, "12.5", "-3", "9 m", None),
        "building:levels": F.when(k % 3 == 0, F.col("p_size").cast("string")),
    }
    every = F.map_from_arrays(F.array(*(F.lit(n) for n in made)), F.array(*made.values()))
    return t.read(spark, sf_dir, "part").select(k.alias("id"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("tags"))


@query(
    f"""
WITH {TAGS}, c AS (
  SELECT id, CASE WHEN coalesce(kind = 'building', false) OR (building IS NOT NULL AND lower(trim(building)) NOT IN {OFF}) THEN 'building' WHEN kind = 'park' THEN 'park'
    WHEN kind = 'water' OR (waterway IS NOT NULL AND lower(trim(waterway)) NOT IN {OFF}) OR lower(trim("natural")) IN {WET} OR lower(trim(landuse)) IN {WET} THEN 'water' WHEN trim(landuse) <> '' THEN 'park' ELSE 'water' END AS class, height, levels, landuse, {FNV.format("'|' || id || '|0'")} % 25 AS drawn FROM tg
)
SELECT id, class, CASE WHEN class = 'building' THEN coalesce(CASE WHEN height = '12.5' THEN 12.5::DOUBLE END, CASE WHEN levels::DOUBLE > 0 THEN levels::DOUBLE * 3 END, 12.0::DOUBLE + drawn) END AS height,
  CASE WHEN class = 'park' THEN CASE WHEN trim(landuse) <> '' THEN landuse ELSE 'park' END END AS land_use FROM c"""
)
def polygon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, height and use of polygons by their tags (FLT-5, 6, 7)."""
    told = _tagged(spark, sf_dir).withColumn("class", tags.polygon_class(F.col("tags")))
    height = tags.building_height(F.col("tags"), F.lit(None).cast("string"), F.col("id"), F.lit(0))
    return told.select("id", "class", F.when(F.col("class") == "building", height).alias("height"), F.when(F.col("class") == "park", tags.land_use(F.col("tags"))).alias("land_use"))


ROAD_TAGS = """rt AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_suppkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'Tertiary' WHEN 2 THEN 'service' WHEN 3 THEN 'footway' ELSE NULL END AS highway,
    CASE l_partkey % 9 WHEN 0 THEN 'collector' WHEN 1 THEN 'avenue' ELSE NULL END AS class, CASE l_linenumber WHEN 1 THEN '7.5' WHEN 2 THEN '8 m' WHEN 3 THEN 'wide' WHEN 4 THEN '-2' ELSE NULL END AS width,
    CASE l_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '0' WHEN 2 THEN '3 lanes' ELSE NULL END AS lanes, CASE l_orderkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'viaduct' WHEN 2 THEN 'no' ELSE NULL END AS bridge,
    CASE l_partkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN '' WHEN 2 THEN 'culvert' ELSE NULL END AS tunnel, CASE l_suppkey % 8 WHEN 0 THEN '2' WHEN 1 THEN 'up' WHEN 2 THEN '-1' WHEN 3 THEN '' ELSE NULL END AS level, CASE l_suppkey % 3 WHEN 0 THEN '1' ELSE NULL END AS layer
  FROM lineitem
), md AS (
  SELECT *, CASE WHEN class = 'collector' THEN 'collector' END AS own, CASE lower(highway) WHEN 'primary' THEN 'arterial' WHEN 'tertiary' THEN 'collector' WHEN 'service' THEN 'local' END AS way, CASE width WHEN '7.5' THEN 7.5::DOUBLE WHEN '8 m' THEN 8.0::DOUBLE END AS w,
    CASE lanes WHEN '2' THEN 7.0::DOUBLE END AS lw, coalesce(bridge = 'yes', false) AS br, coalesce(tunnel = 'TRUE', false) AS tu, CASE WHEN level <> '' THEN level ELSE layer END AS lv FROM rt
), mt AS (SELECT *, coalesce(own, way, 'local') AS cls, coalesce(CASE lv WHEN '2' THEN 2.0::DOUBLE WHEN '-1' THEN -1.0::DOUBLE WHEN '1' THEN 1.0::DOUBLE END, CASE WHEN br THEN 1.0::DOUBLE WHEN tu THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lvl FROM md)"""


def _road_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    choose = lambda c, n, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values), *(F.lit(None).cast("string") for _ in range(n - len(values)))), (F.col(c) % n + 1).cast("int"))
    made = {
        "highway": choose("l_suppkey", 5, "primary", "Tertiary", "service", "footway"),
        "class": choose("l_partkey", 9, "collector", "avenue"),
        "width": F.coalesce(*(F.when(F.col("l_linenumber") == n, F.lit(v)) for n, v in ((1, "7.5"), (2, "8 m"), (3, "wide"), (4, "-2")))),
        "lanes": choose("l_orderkey", 4, "2", "0", "3 lanes"),
        "bridge": choose("l_orderkey", 7, "yes", "viaduct", "no"),
        "tunnel": choose("l_partkey", 6, "TRUE", "", "culvert"),
        "level": choose("l_suppkey", 8, "2", "up", "-1", ""),
        "layer": choose("l_suppkey", 3, "1"),
    }
    every = F.map_from_arrays(F.array(*(F.lit(n) for n in made)), F.array(*made.values()))
    told = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("tags"))
    return told.select("id", tags.road_metadata(F.col("tags")).alias("m"))


@query(f"WITH {ROAD_TAGS} SELECT id, cls, coalesce(w, lw, CASE cls WHEN 'arterial' THEN 20.0::DOUBLE WHEN 'collector' THEN 13.0::DOUBLE ELSE 9.0::DOUBLE END) AS width, br AS bridge, tu AS tunnel, lvl AS level, NOT br AND NOT tu AND lvl = 0 AS face_eligible FROM mt")
def road_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, width and level of roads by their tags (FLT-11, FLT-12)."""
    return _road_tags(spark, sf_dir).select("id", *(F.col(f"m.{n}") for n in ("cls", "width", "bridge", "tunnel", "level", "face_eligible")))


@query(
    f"""
WITH {ROAD_TAGS}, f AS (
  SELECT id, 'invalid-class' AS code FROM mt WHERE class = 'avenue' UNION ALL SELECT id, 'invalid-class' FROM mt WHERE own IS NULL AND highway = 'footway' UNION ALL SELECT id, 'invalid-width' FROM mt WHERE width IN ('wide', '-2')
  UNION ALL SELECT id, 'invalid-lanes' FROM mt WHERE w IS NULL AND lanes IN ('0', '3 lanes') UNION ALL SELECT id, 'invalid-bridge' FROM mt WHERE bridge = 'viaduct' UNION ALL SELECT id, 'invalid-tunnel' FROM mt WHERE tunnel = 'culvert' UNION ALL SELECT id, 'invalid-level' FROM mt WHERE lv = 'up'
)
SELECT code, count(*) AS n, count(DISTINCT id) AS roads, min(id) AS first_id FROM f GROUP BY code"""
)
def metadata_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not understood in road tags, by code (AGG-11)."""
    # explode() would have the faults' number as a filter, which is pushed down with all that the faults and tags are made of in it, many times over
    each = _road_tags(spark, sf_dir).select("id", F.explode_outer("m.faults").alias("code")).where("code is not null")
    return each.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("id").alias("roads"), F.min("id").alias("first_id"))


# ---- joins and aggregates over points

@query(
    f"""
WITH {t.POINTS}, s AS (SELECT id AS sid, x AS sx, z AS sz FROM pts WHERE segment = 'BUILDING'), d AS (SELECT id, sid, sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz)) AS d FROM pts, s WHERE segment <> 'BUILDING')
SELECT id, arg_min(sid, [d, sid::DOUBLE]) AS sid, {_near('min(d)')} AS d FROM d WHERE d <= 60 GROUP BY id"""
)
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest site within sixty metres (JN-4)."""
    p = t.points(spark, sf_dir)
    found = nearest(p.where("segment <> 'BUILDING'").select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("z").alias("pz")), p.where("segment = 'BUILDING'").select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("z").alias("sz")), [], 60.0)
    return found.select(F.col("pid").alias("id"), "sid", F.round("d", 6).alias("d"))


# ---- graphs

@query(f"WITH RECURSIVE {t.LINKS}, n AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), r AS (SELECT x, x AS y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of linked parts (GR-4)."""
    return connected_components(t.links(spark, sf_dir), "a", "b")


@query(f"WITH RECURSIVE {t.LINKS}, n AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), r AS (SELECT x, x AS y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x), s AS (SELECT c, count(*) AS edges, round(sum(weight), 2) AS weight, min(edge) AS first_edge FROM lk JOIN c ON lk.a = c.x GROUP BY c) SELECT c AS component, edges, weight, first_edge, row_number() OVER (ORDER BY edges DESC, first_edge) AS rank FROM s")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by size, the first of equals first (AGG-7, AGG-12)."""
    e = t.links(spark, sf_dir)
    reach = connected_components(e, "a", "b")
    sized = e.join(reach, e["a"] == reach["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 2).alias("weight"), F.min("edge").alias("first_edge"))
    return numbered(sized, [F.desc("edges"), F.col("first_edge")], "rank", 1)


@query(f"WITH {t.LINKS} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM lk UNION ALL SELECT b FROM lk) GROUP BY node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at each node (AGG-6)."""
    return network.degrees(t.links(spark, sf_dir).withColumn("cls", F.lit("local")))


def _roads(spark: SparkSession, sf_dir: str) -> noding.RoadGraph:
    s = t.streets(spark, sf_dir)
    widths = F.coalesce(*(F.when(F.col("cls") == c, F.lit(w)) for c, w in tags.WIDTHS.items()))
    pts = F.array(rings.point(F.col("ax"), F.col("az")), rings.point(F.col("bx"), F.col("bz")))
    return noding.import_roads(s.select("src", F.lit(None).cast("string").alias("source_id"), "part", pts.alias("pts"), "level", "cls", widths.alias("width"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel")), cell=40.0)


# clipping, grid, contacts, cuts and first-wins edges, all pairs
GRID = "greatest(-450.0::DOUBLE, least(450.0::DOUBLE, floor(({0}) / 0.25 + 0.5) * 0.25))"
ROADS = f"""{t.STREETS}, k0 AS (
  SELECT *, bx - ax AS dx, bz - az AS dz FROM st
), k1 AS (
  SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (-450 - ax) / dx ELSE 0 END, CASE WHEN dz > 0 THEN (-450 - az) / dz ELSE 0 END) AS lo, least(1.0, CASE WHEN dx > 0 THEN (450 - ax) / dx ELSE 1 END, CASE WHEN dz > 0 THEN (450 - az) / dz ELSE 1 END) AS hi FROM k0
), sg AS (
  SELECT src, level, cls, {GRID.format('ax + dx * lo')} AS ax, {GRID.format('az + dz * lo')} AS az, {GRID.format('ax + dx * hi')} AS bx, {GRID.format('az + dz * hi')} AS bz FROM k1 WHERE hi - lo > 1e-12 AND NOT (dx = 0 AND (ax < -450 OR ax > 450)) AND NOT (dz = 0 AND (az < -450 OR az > 450))
), sq AS (SELECT * FROM sg WHERE ax <> bx OR az <> bz), pr AS (
  SELECT a.src AS s1, b.src AS s2, a.ax, a.az, a.bx, a.bz, b.ax AS cx, b.az AS cz, b.bx AS dx, b.bz AS dz, (a.bx - a.ax) * (b.bz - b.az) - (a.bz - a.az) * (b.bx - b.ax) AS den,
    (b.ax - a.ax) * (b.bz - b.az) - (b.az - a.az) * (b.bx - b.ax) AS tn, (b.ax - a.ax) * (a.bz - a.az) - (b.az - a.az) * (a.bx - a.ax) AS un FROM sq a JOIN sq b ON a.src < b.src AND a.level = b.level
), x AS (SELECT *, tn / den AS t, un / den AS u FROM pr WHERE abs(den) >= 1e-9), xx AS (SELECT * FROM x WHERE t BETWEEN -1e-7 AND 1 + 1e-7 AND u BETWEEN -1e-7 AND 1 + 1e-7), en AS (
  SELECT s2 AS own, cx AS ax, cz AS az, dx AS bx, dz AS bz, ax AS px, az AS pz FROM pr UNION ALL SELECT s2, cx, cz, dx, dz, bx, bz FROM pr UNION ALL SELECT s1, ax, az, bx, bz, cx, cz FROM pr UNION ALL SELECT s1, ax, az, bx, bz, dx, dz FROM pr
), et AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)))) AS t FROM en
), cuts AS (
  SELECT s1 AS src, greatest(0.0, least(1.0, t)) AS t, {GRID.format('ax + (bx - ax) * t')} AS x, {GRID.format('az + (bz - az) * t')} AS z FROM xx UNION SELECT s2, greatest(0.0, least(1.0, u)), {GRID.format('ax + (bx - ax) * t')}, {GRID.format('az + (bz - az) * t')} FROM xx
  UNION SELECT own, t, px, pz FROM et WHERE sqrt((px - (ax + (bx - ax) * t)) ** 2 + (pz - (az + (bz - az) * t)) ** 2) <= 0.125 + 1e-9
  UNION SELECT src, 0.0, ax, az FROM sq UNION SELECT src, 1.0, bx, bz FROM sq
), c1 AS (SELECT *, lag(x) OVER w AS lx, lag(z) OVER w AS lz FROM cuts WINDOW w AS (PARTITION BY src ORDER BY t, x, z)), c2 AS (SELECT * FROM c1 WHERE lx IS NULL OR lx <> x OR lz <> z),
c3 AS (SELECT *, lead(x) OVER w AS qx, lead(z) OVER w AS qz, row_number() OVER w AS nth FROM c2 WINDOW w AS (PARTITION BY src ORDER BY t, x, z)),
sub AS (SELECT c3.src, nth, x, z, qx, qz, level, cls, CASE WHEN x < qx OR (x = qx AND z < qz) THEN [x, z, qx, qz] ELSE [qx, qz, x, z] END AS k FROM c3 JOIN sq USING (src) WHERE qx IS NOT NULL AND (qx <> x OR qz <> z)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY src, nth) AS dup FROM sub), ed AS (SELECT * FROM ranked WHERE dup = 1)"""


@query(f"WITH {ROADS} SELECT src, level, cls, x AS ax, z AS az, qx AS bx, qz AS bz FROM ed")
def noded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the streets cut at every contact (GR-2, WIN-2 to WIN-4, SET-3)."""
    g = _roads(spark, sf_dir)
    return network.with_ends(g.edges, g.nodes.drop("level")).select("src", "level", "cls", "ax", "az", "bx", "bz")


@query(
    f"""
WITH RECURSIVE {ROADS}, n AS (SELECT [level, x, z] AS a, [level, qx, qz] AS b FROM ed UNION SELECT [level, qx, qz], [level, x, z] FROM ed), r AS (SELECT a, a AS b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
s AS (SELECT c, count(*) AS k FROM ed JOIN c ON [ed.level, ed.x, ed.z] = c.a GROUP BY c)
SELECT (SELECT count(*) FROM st) AS records, (SELECT count(*) FROM st) AS line_records, (SELECT count(*) FROM st) AS source_parts, 0::BIGINT AS skipped_records, greatest(0, (SELECT count(*) FROM s) - 1)::BIGINT AS disconnected_components, (SELECT count(*) FROM sq) AS segments, (SELECT count(*) FROM sub) AS subsegments, (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM s) AS components, (SELECT max(k) FROM s) AS largest, (SELECT count(*) FROM sub) - (SELECT count(*) FROM ed) AS duplicates, (SELECT count(*) FROM ed) - (SELECT max(k) FROM s) AS disconnected_edges"""
)
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the import (AGG-8)."""
    return _roads(spark, sf_dir).stats.drop("diagnostics")


@query(
    f"""
WITH RECURSIVE {ROADS}, n AS (SELECT [level, x, z] AS a, [level, qx, qz] AS b FROM ed UNION SELECT [level, qx, qz], [level, x, z] FROM ed), r AS (SELECT a, a AS b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
s AS (SELECT c, count(*) AS k, min([src, nth]) AS f FROM ed JOIN c ON [ed.level, ed.x, ed.z] = c.a GROUP BY c), m AS (SELECT c FROM s ORDER BY k DESC, f LIMIT 1)
SELECT cls, count(*) AS edges, {_near('sum(sqrt((qx - x) ** 2 + (qz - z) ** 2))')} AS length FROM ed JOIN c ON [ed.level, ed.x, ed.z] = c.a JOIN m ON m.c = c.c GROUP BY cls"""
)
def largest_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and length by class of the largest component of the imported streets."""
    g = _roads(spark, sf_dir)
    told = network.with_ends(noding.largest_component(g), g.nodes.drop("level"))
    return told.groupBy("cls").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 6).alias("length"))


def _fine_roads(spark: SparkSession, sf_dir: str):
    g = _roads(spark, sf_dir)
    return g.nodes.drop("level"), g.edges


@query(
    f"""
WITH RECURSIVE {ROADS}, w AS (SELECT [level, x, z] AS a, [level, qx, qz] AS b, sqrt((qx - x) ** 2 + (qz - z) ** 2) AS l FROM ed), n AS (SELECT a, b, l FROM w UNION ALL SELECT b, a, l FROM w), v0 AS (SELECT min([src::DOUBLE, nth::DOUBLE]) AS f, [level, x, z] AS v FROM ed GROUP BY level, x, z ORDER BY f LIMIT 1),
r AS (SELECT v AS here, 0.0::DOUBLE AS d, 0 AS k FROM v0 UNION SELECT n.b, d + l, k + 1 FROM r JOIN n ON r.here = n.a WHERE d + l <= 150 + 1e-12 AND k < 12)
SELECT here[2] AS x, here[3] AS z, {_near('min(d)')} AS distance FROM r GROUP BY here"""
)
def walkshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within 150 metres' walk of the first node (NET-1, NET-2, NET-6)."""
    nodes, edges = _fine_roads(spark, sf_dir)
    start = edges.orderBy("edge").limit(1).select(F.col("a").alias("start"))
    found = network.reach(nodes, edges, start, 150.0)
    return found.join(nodes, "node").select("x", "z", F.round("distance", 6).alias("distance"))


ROUTES = """rs AS (SELECT o_custkey AS route, l_suppkey AS edge, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route, pos, edge: a customer's shipments as a route over suppliers' streets."""
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("route"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber")) - 1).alias("pos"), F.col("l_suppkey").alias("edge"))


@query(f"WITH {ROUTES}, c AS (SELECT s_suppkey::BIGINT AS edge, count(r.edge) AS traffic FROM supplier LEFT JOIN rs r ON r.edge = s_suppkey GROUP BY 1) SELECT edge, traffic, {_near('sqrt(traffic::DOUBLE / max(traffic) OVER ())')} AS heat FROM c")
def edge_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each edge and its heat (AGG-1, AGG-17, JN-13)."""
    edges = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("edge"))
    heat = network.traffic_heat(network.edge_traffic(edges, _routes(spark, sf_dir)))
    return heat.select("edge", "traffic", F.round("heat", 6).alias("heat"))


@query(f"WITH {ROUTES} SELECT s_nationkey::BIGINT AS corridor, count(r.edge) AS traffic FROM supplier LEFT JOIN rs r ON r.edge = s_suppkey GROUP BY 1")
def corridor_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of corridors (AGG-2, JN-12)."""
    owners = t.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("corridor"), F.col("s_suppkey").cast("long").alias("edge"))
    return network.corridor_traffic(owners, _routes(spark, sf_dir))


@query(f"WITH {t.STREETS}, l AS (SELECT n_name AS name, n_nationkey AS seq, sum(sqrt((bx - ax) ** 2 + (bz - az) ** 2)) AS length FROM st JOIN supplier ON s_suppkey = src JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL) SELECT name, seq, {_near('length')} AS length FROM l ORDER BY length DESC, seq LIMIT 6")
def top_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six longest corridors (SRT-1, SRT-2)."""
    s = t.streets(spark, sf_dir).withColumn("l", scalars.distance(*(F.col(n) for n in ("ax", "az", "bx", "bz"))))
    owned = s.join(t.read(spark, sf_dir, "supplier"), F.col("src") == F.col("s_suppkey")).join(t.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sums = owned.groupBy(F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq")).agg(F.sum("l").alias("length"))
    return network.top_streets(sums).withColumn("length", F.round("length", 6))


@query(
    f"""
WITH {t.STREETS}, r AS (SELECT src AS route, src % 50 AS car, ax, az, bx, bz, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS len FROM st), p AS (SELECT *, row_number() OVER w - 1 AS pos, sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t1 FROM r WINDOW w AS (PARTITION BY car ORDER BY route)),
q AS (SELECT *, t1 - len AS t0, sum(len) OVER (PARTITION BY car) AS total, pos = max(pos) OVER (PARTITION BY car) AS last FROM p), e AS (SELECT unnest([0, 7, 40, 133]) AS elapsed),
m AS (SELECT *, fmod(car * 3.25::DOUBLE + elapsed * (1 + car % 3), total * 2) AS phase FROM q, e), f AS (SELECT *, phase <= total AS fwd, CASE WHEN phase <= total THEN phase ELSE total * 2 - phase END AS travel FROM m), h AS (SELECT *, row_number() OVER (PARTITION BY car, elapsed ORDER BY pos) AS k FROM f WHERE travel <= t1 OR last),
u AS (SELECT *, greatest(0.0, least(1.0, (travel - t0) / len)) AS u, greatest(0.0, least(8.0 / 4, 8.0 / 2 - 1.9)) AS lane, least(4.0, len / 2) AS ease FROM h WHERE k = 1), i AS (SELECT *, lane * least(1.0, u * len / ease, (1 - u) * len / ease) * CASE WHEN fwd THEN 1 ELSE -1 END AS ins FROM u)
SELECT car, elapsed, route AS edge, {_near('ax + (bx - ax) * u + (bz - az) / len * ins', 5)} AS x, {_near('az + (bz - az) * u - (bx - ax) / len * ins', 5)} AS z FROM i"""
)
def positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where cars are at four times (NET-7, WIN-6)."""
    s = t.streets(spark, sf_dir)
    w = Window.partitionBy("car").orderBy("src")
    steps = s.withColumn("car", F.col("src") % 50).withColumn("pos", F.row_number().over(w) - 1)
    steps = steps.select("car", "pos", F.col("src").alias("edge"), F.col("ax").alias("fx"), F.col("az").alias("fz"), F.col("bx").alias("tx"), F.col("bz").alias("tz"), F.lit(8.0).alias("width"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), F.lit(0.0).alias("level"))
    cars = steps.select("car").distinct().select("car", (F.col("car") * 3.25).alias("t"), (1 + F.col("car") % 3).cast("double").alias("speed"), F.explode(F.array(*map(F.lit, (0, 7, 40, 133)))).alias("elapsed"))
    return network.positions(cars, steps).select("car", "elapsed", "edge", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


# ---- fields

CENTERS = [{"x": 0.0, "z": 50.0, "w": 1.0, "sigma": 180.0}, {"x": -250.0, "z": 200.0, "w": 0.6, "sigma": 90.0}]


def _most() -> float:
    raw = lambda x, z: sum(c["w"] * math.exp(-((x - c["x"]) ** 2 + (z - c["z"]) ** 2) / (2 * c["sigma"] ** 2)) for c in CENTERS)
    grid = [-450 + k * 30 for k in range(31)]
    return max([raw(x, z) for x in grid for z in grid] + [raw(c["x"], c["z"]) for c in CENTERS])


@query(f"WITH {t.POINTS} SELECT id, {_near('least(1.0, (' + ' + '.join(f'{c["w"]} * exp(-((x - {c["x"]}) * (x - {c["x"]}) + (z - {c["z"]}) * (z - {c["z"]})) / {2 * c["sigma"] ** 2})' for c in CENTERS) + f') / {_most()!r})')} AS population FROM pts")
def population_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population at points (FLD-5, AGG-14)."""
    f = fields.population(CENTERS)
    return t.points(spark, sf_dir).select("id", F.round(f(F.col("x"), F.col("z")), 6).alias("population"))


def noise_sql(seed: str, x: str, z: str) -> str:
    base = randoms.hash_value(seed)
    m = "4294967296"
    p32 = lambda a, b: f"(({a}) * {b} % {m})"
    u = lambda a: f"((({a}) + {m} * 4) % {m})"

    def lat(dx: int, dz: int) -> str:
        ix, iz = u(f"(CAST(floor({x}) AS BIGINT) + {dx})"), u(f"(CAST(floor({z}) AS BIGINT) + {dz})")
        h = f"xor(xor({p32(ix, randoms.NOISE_X)}, {p32(iz, randoms.NOISE_Z)}), {base}::BIGINT)"
        g = p32(f"xor({h}, ({h}) >> 13)", randoms.NOISE_MIX)
        return f"(xor({g}, ({g}) >> 16) / 4294967296.0::DOUBLE * 2 - 1)"

    fade = lambda v: f"((({v}) - floor({v})) * (({v}) - floor({v})) * (3 - 2 * (({v}) - floor({v}))))"
    fx, fz, a, b, c, d = fade(x), fade(z), lat(0, 0), lat(1, 0), lat(0, 1), lat(1, 1)
    return f"(({a} + ({b} - {a}) * {fx}) * (1 - {fz}) + ({c} + ({d} - {c}) * {fx}) * {fz})"


@query(f"WITH {t.POINTS} SELECT id, round(greatest(0.0, least(72.0, ({noise_sql('town:elevation:macro', '(x / 240)', '(z / 240)')} * 0.72 + {noise_sql('town:elevation:detail', '(x / 96 + 13.7)', '(z / 96 - 8.2)')} * 0.28 + 1) * 0.5 * 72)), 6) AS elevation FROM pts")
def elevation_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain at points (SCL-3, FLD-1)."""
    f = fields.elevation("town")
    return t.points(spark, sf_dir).select("id", F.round(f(F.col("x"), F.col("z")), 6).alias("elevation"))


@query(
    f"""
WITH {t.POINTS}, s AS (SELECT id, x, z, exp(-((x - 100) * (x - 100) + (z + 50) * (z + 50)) / 40000.0) * 0.8 AS w, CASE WHEN x = 100 AND z = -50 THEN 0.0 ELSE atan2(z + 50, x - 100) END AS a FROM pts),
v AS (SELECT id, cos(0.6) + cos(2 * a) * w AS c, sin(0.6) + sin(2 * a) * w AS s FROM s), h AS (SELECT id, atan2(s, c) / 2 AS h FROM v) SELECT id, round(CASE WHEN h < 0 THEN h + {PI} ELSE h END, 6) AS heading FROM h"""
)
def direction_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading of streets at points (FLD-6)."""
    f = fields.direction([{"type": "grid", "angle": 0.3}, {"type": "radial", "x": 100.0, "z": -50.0, "sigma": 200.0, "weight": 0.8}])
    return t.points(spark, sf_dir).select("id", F.round(f(F.col("x"), F.col("z")), 6).alias("heading"))


@query(f"WITH {t.POINTS} SELECT id, CASE WHEN x <= -60 OR x >= 35.5 THEN 1 ELSE -1 END * least(abs(x + 60), abs(x - 35.5)) AS river, x - 120 AS coast, (x BETWEEN -10 AND 30 AND z BETWEEN 5 AND 105) OR (x BETWEEN 200 AND 260 AND z BETWEEN -300 AND -250) AS reserved FROM pts")
def water_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distance to a river and a coast, and reserved ground (FLD-2, FLD-7, FLT-21)."""
    river, coast = fields.water_distance({"kind": "river", "x0": -60.0, "x1": 35.5}), fields.water_distance({"kind": "coast", "edge": 120.0})
    kept = fields.exclusion([(-10, 5, 40, 100), (200, -300, 60, 50)])
    x, z = F.col("x"), F.col("z")
    return t.points(spark, sf_dir).select("id", river(x, z).alias("river"), coast(x, z).alias("coast"), kept(x, z).alias("reserved"))


# ---- reports

META = {"num": (10, 99), "spec": (1000, 9999), "sys": (10000, 99999), "series": None, "azimuth": (0, 359), "elevation": (20, 60), "footfall": (20, 90), "sub": (40, 80)}
SERIES = ("A", "B", "C", "E")


def _meta_sql() -> str:
    steps, columns = [], []
    before = "CASE WHEN s = 0 THEN 2654435769 ELSE s END"
    for n, (name, bounds) in enumerate(META.items()):
        steps.append(f"m{n + 1} AS (SELECT *, {STEP.format(before)} AS d{n + 1} FROM m{n})")
        before = f"d{n + 1}"
        u = f"d{n + 1} / 4294967296.0::DOUBLE"
        columns.append(f"['A', 'B', 'C', 'E'][CAST(floor({u} * 4) + 1 AS INTEGER)] AS {name}" if bounds is None else f"CAST({bounds[0]} + floor({u} * {bounds[1] - bounds[0] + 1}) AS BIGINT) AS {name}")
    first = f"m0 AS (SELECT c_custkey, {FNV.format(chr(39) + 'c' + chr(39) + ' || c_custkey::VARCHAR || ' + chr(39) + ':meta' + chr(39))} AS s FROM customer)"
    return f"WITH {first}, {', '.join(steps)} SELECT c_custkey, {', '.join(columns)} FROM m{len(META)}"


@query(_meta_sql())
def poster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poster says of a seed, in a fixed order of draws (TER-10)."""
    told = t.read(spark, sf_dir, "customer").select("c_custkey", randoms.draws(randoms.stream(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "meta"), len(META)).alias("u"))
    at = lambda n: F.element_at("u", n + 1)
    return told.select("c_custkey", *((randoms.pick(at(n), F.array(*map(F.lit, SERIES))) if b is None else randoms.whole(at(n), *b).cast("long")).alias(name) for n, (name, b) in enumerate(META.items())))


@query("WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_totalprice AS upper_median, n FROM r WHERE k = n // 2 + 1")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of each customer's orders (AGG-18)."""
    w = Window.partitionBy("o_custkey")
    ranked = t.read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w.orderBy("o_totalprice"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.expr("k = n div 2 + 1")).select("o_custkey", F.col("o_totalprice").alias("upper_median"), "n")


@query("WITH f AS (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY l_partkey) SELECT l_partkey, row_number() OVER (ORDER BY seen, l_partkey) - 1 AS id FROM f")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in order of first appearance, without one task for all (WIN-4)."""
    first = t.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return numbered(first, [F.col("seen"), F.col("l_partkey")], "id").select("l_partkey", "id")


@query(
    f"""
WITH {t.STREETS}, e AS (SELECT *, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS len FROM st)
SELECT src, cls, {_near('len')} AS len, {_near('len / CASE cls WHEN ' + chr(39) + 'arterial' + chr(39) + ' THEN 1.45 WHEN ' + chr(39) + 'collector' + chr(39) + ' THEN 1.12 ELSE 0.86 END')} AS cost, {_near('atan2(bz - az, bx - ax)')} AS angle, (ax + bx) / 2 AS cx, (az + bz) / 2 AS cz, CASE WHEN level > 0 THEN 'bridge' ELSE 'road' END AS kind FROM e"""
)
def street_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ribbons and driving costs of streets (FAB-4, NET-1)."""
    s = t.streets(spark, sf_dir)
    at = lambda side, x, z: s.select((F.col("src") * 2 + side).alias("node"), F.col(x).alias("x"), F.col(z).alias("z"))
    nodes = at(0, "ax", "az").unionAll(at(1, "bx", "bz"))
    edges = s.select(F.col("src").alias("edge"), (F.col("src") * 2).alias("a"), (F.col("src") * 2 + 1).alias("b"), "cls", F.lit(8.0).alias("width"), "level")
    cost = network.adjacency(nodes, edges).groupBy("edge").agg(F.min("cost").alias("cost"))
    told = network.ribbons(nodes, edges).join(cost, "edge")
    return told.select(F.col("edge").alias("src"), "cls", F.round("len", 6).alias("len"), F.round("cost", 6).alias("cost"), F.round("angle", 6).alias("angle"), "cx", "cz", "kind")
