"""Queries of measures over segments, rings and imported streets, each with SQL that goes over all pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import fields, randoms, rings, scalars, segments, tags
from loomgrid.functions.exact import clip_exactly
from loomgrid.operators import land, network, noding, polygons, terrain
from loomgrid.plans import tables as t
from loomgrid.plans.cities import HEIGHT
from loomgrid.plans.polygons import BRICKS, bricks
from loomgrid.plans.queries import FNV, INSIDE, ROADS, STEP, TURN, _roads, query

# ---- segments


def _sides(a: str, b: str, c: str) -> str:
    """The side of the line a b that c lies on; coordinates are multiples of a quarter, so it is exact."""
    return f"sign(({b}x - {a}x) * ({c}z - {a}z) - ({b}z - {a}z) * ({c}x - {a}x))"


def _touch_sql(ahead: str, named: str) -> str:
    """Pairs of segments a b and c d that share a point other than one common end: of those on one line, the ends' places along it tell."""
    place = lambda p: f"(({p}x - ax) * (bx - ax) + ({p}z - az) * (bz - az))"
    return f"""
{ahead}, side AS (
  SELECT *, {_sides('a', 'b', 'c')} AS sc, {_sides('a', 'b', 'd')} AS sd, {_sides('c', 'd', 'a')} AS sa, {_sides('c', 'd', 'b')} AS sb,
    least({place('c')}, {place('d')}) AS low, greatest({place('c')}, {place('d')}) AS high, {place('b')} AS whole,
    (ax = cx AND az = cz) OR (ax = dx AND az = dz) OR (bx = cx AND bz = cz) OR (bx = dx AND bz = dz) AS joined FROM {named}
), touching AS (
  SELECT *, CASE WHEN sc = 0 AND sd = 0 THEN CASE WHEN joined THEN greatest(0, low) < least(whole, high) ELSE greatest(0, low) <= least(whole, high) END ELSE sc * sd <= 0 AND sa * sb <= 0 AND NOT joined END AS hit FROM side
)"""


@query(f"WITH {t.STREETS}{_touch_sql(', pairs AS (SELECT a.src AS s1, b.src AS s2, a.ax, a.az, a.bx, a.bz, b.ax AS cx, b.az AS cz, b.bx AS dx, b.bz AS dz FROM st a JOIN st b ON a.src < b.src AND a.level = b.level)', 'pairs')} SELECT s1, s2 FROM touching WHERE hit")
def touching_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of streets of one level that touch (GEO-6)."""
    s = t.streets(spark, sf_dir).withColumnRenamed("src", "sid")
    return noding.touching(s, 40.0).toDF("s1", "s2")


#: Coordinates in eighths and less have halves of the last place that is kept; this decides them whichever way they were computed.
TIE = 1e-8

# Inclusive: what only touches the window is kept as a point.
WINDOW = """cw0 AS (
  SELECT uid, seq, ax, az, bx - ax AS dx, bz - az AS dz FROM mv
), cw1 AS (
  SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (-450 - ax) / dx WHEN dx < 0 THEN (450 - ax) / dx ELSE 0 END, CASE WHEN dz > 0 THEN (-450 - az) / dz WHEN dz < 0 THEN (450 - az) / dz ELSE 0 END) AS lo,
    least(1.0, CASE WHEN dx > 0 THEN (450 - ax) / dx WHEN dx < 0 THEN (-450 - ax) / dx ELSE 1 END, CASE WHEN dz > 0 THEN (450 - az) / dz WHEN dz < 0 THEN (-450 - az) / dz ELSE 1 END) AS hi FROM cw0
  WHERE NOT (dx = 0 AND abs(ax) > 450) AND NOT (dz = 0 AND abs(az) > 450)
)
SELECT uid, seq, round(ax + dx * lo + {0}, 6) + 0.0 AS cax, round(az + dz * lo + {0}, 6) + 0.0 AS caz, round(ax + dx * hi + {0}, 6) + 0.0 AS cbx, round(az + dz * hi + {0}, 6) + 0.0 AS cbz FROM cw1 WHERE lo <= hi""".format(TIE)


def _clipped(moves: DataFrame, c) -> DataFrame:
    told = moves.withColumn("c", c).where("c.ax is not null")
    return told.select("uid", "seq", *((F.round(F.col(f"c.{n}") + TIE, 6) + 0.0).alias(f"c{n}") for n in ("ax", "az", "bx", "bz")))


@query(f"WITH {t.MOVES}, {WINDOW}")
def closed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves clipped to the viewport, those that touch it included (GEO-2)."""
    m = t.moves(spark, sf_dir)
    return _clipped(m, segments.clip_closed(*map(F.col, ("ax", "az", "bx", "bz")), -450, 450, -450, 450))


@query(f"WITH {t.MOVES}, {WINDOW}")
def exact_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rational arithmetic (GEO-2, SCL-11)."""
    m = t.moves(spark, sf_dir)
    return _clipped(m, clip_exactly(*map(F.col, ("ax", "az", "bx", "bz")), (-450.0, 450.0, -450.0, 450.0)))


QUARTER = repr(math.pi / 2)
HALF_TURN = repr(math.pi)


@query(
    f"""
WITH {t.MOVES}, h AS (SELECT uid, seq, atan2(bz - az, bx - ax) AS heading, (seq % 7) * 0.37::DOUBLE AS major, ax * 1.7 AS lon FROM mv WHERE ax <> bx OR az <> bz),
o AS (SELECT *, unnest(range(4)) AS k FROM h), r AS (SELECT *, fmod(major + k * {QUARTER} - heading, {TURN}) AS r FROM o), g AS (SELECT *, abs(CASE WHEN r > {HALF_TURN} THEN r - {TURN} WHEN r <= -{HALF_TURN} THEN r + {TURN} ELSE r END) AS gap FROM r)
SELECT uid, seq, round(any_value(major) + arg_min(k, gap) * {QUARTER}, 6) AS aligned, round(any_value(lon) - 360 * floor((any_value(lon) + 180) / 360), 6) + 0.0 AS wrapped, round((any_value(lon) - 12.5) - 360 * floor((any_value(lon) - 12.5 + 180) / 360), 6) + 0.0 AS delta FROM g GROUP BY uid, seq"""
)
def aligned_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves' headings along a grid, and longitudes wrapped (SCL-8, SCL-9)."""
    m = t.moves(spark, sf_dir).where("ax <> bx or az <> bz")
    heading = F.atan2(F.col("bz") - F.col("az"), F.col("bx") - F.col("ax"))
    lon = F.col("ax") * 1.7
    near = lambda c: F.round(c, 6) + 0.0
    return m.select("uid", "seq", F.round(scalars.nearest_aligned(F.col("seq") % 7 * 0.37, heading), 6).alias("aligned"), near(scalars.wrap_longitude(lon)).alias("wrapped"), near(scalars.longitude_delta(lon, 12.5)).alias("delta"))


@query(f"WITH {t.POINTS}, d AS (SELECT id, (x - 40) * (x - 40) + (z + 90) * (z + 90) AS d2 FROM pts) SELECT id, round(exp(-d2 / 22500), 6) AS near, 1.0::DOUBLE AS everywhere, CASE WHEN d2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS here FROM d")
def falloffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Influence of a source on points: over a distance, without end, and in its own place only (SCL-13)."""
    d2 = (F.col("x") - 40) * (F.col("x") - 40) + (F.col("z") + 90) * (F.col("z") + 90)
    return t.points(spark, sf_dir).select("id", F.round(scalars.rbf_weight(d2, 150.0), 6).alias("near"), scalars.rbf_weight(d2, math.inf).alias("everywhere"), scalars.rbf_weight(d2, 0.0).alias("here"))


# ---- rings

QUADS = """qd AS (
  SELECT id, j, x, z FROM (SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS s, unnest(range(4)) AS j, ((p_partkey::BIGINT * (7 + 6 * j) + p_size * (3 + j)) % 11)::DOUBLE AS x, ((p_partkey::BIGINT * (5 + 4 * j) + p_size * (2 + 3 * j)) % 13)::DOUBLE AS z FROM part)
), qe AS (
  SELECT p.id, p.j, p.x AS ax, p.z AS az, q.x AS bx, q.z AS bz FROM qd p JOIN qd q ON q.id = p.id AND q.j = (p.j + 1) % 4
), qp AS (
  SELECT a.id, a.ax, a.az, a.bx, a.bz, b.ax AS cx, b.az AS cz, b.bx AS dx, b.bz AS dz FROM qe a JOIN qe b ON b.id = a.id AND b.j = a.j + 2
)"""


@query(f"WITH {QUADS}{_touch_sql('', 'qp')} SELECT id, NOT bool_or(hit) AND NOT any_value(flat) AS simple FROM touching JOIN (SELECT id, bool_or(ax = bx AND az = bz) AS flat FROM qe GROUP BY id) USING (id) GROUP BY id")
def simple_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four corners drawn for each part bound a ring that doesn't meet itself (GEO-10)."""
    k, s = F.col("p_partkey").cast("long"), F.col("p_size")
    corner = lambda j: ((k * (7 + 6 * j) + s * (3 + j)) % 11, (k * (5 + 4 * j) + s * (2 + 3 * j)) % 13)
    return t.read(spark, sf_dir, "part").select(k.alias("id"), rings.of(*map(corner, range(4))).alias("ring")).select("id", rings.is_simple(F.col("ring")).alias("simple"))


CLEAR = 6.0


@query(
    f"""
WITH {t.SHAPES}, {t.POINTS}, e AS (
  SELECT p.id AS pid, r.id AS shape, x, z, px, pz, qx - px AS ux, qz - pz AS uz FROM pts p JOIN ring r ON x BETWEEN least(px, qx) - {CLEAR} AND greatest(px, qx) + {CLEAR} AND z BETWEEN least(pz, qz) - {CLEAR} AND greatest(pz, qz) + {CLEAR}
), f AS (
  SELECT *, greatest(0.0, least(1.0, ((x - px) * ux + (z - pz) * uz) / (ux * ux + uz * uz))) AS s FROM e
)
SELECT pid, shape, round(min(sqrt((x - px - ux * s) ** 2 + (z - pz - uz * s) ** 2)), 6) AS d FROM f GROUP BY pid, shape HAVING min(sqrt((x - px - ux * s) ** 2 + (z - pz - uz * s) ** 2)) <= {CLEAR}"""
)
def shape_clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far points lie from the outlines of shapes around them (GEO-11)."""
    pts = t.points(spark, sf_dir).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("z").alias("pz"))
    sides = t.shapes(spark, sf_dir).select(F.col("id").alias("shape"), F.explode(rings.edges(F.col("ring"))).alias("e"))
    sides = sides.select("shape", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "pq" for c in "xz")).withColumnsRenamed({"px": "ax", "pz": "az", "qx": "bx", "qz": "bz"})
    told = land.clearances(pts, sides, CLEAR)
    return told.select("pid", "shape", F.round("d", 6).alias("d"))


@query(
    f"""
WITH {t.SHAPES}, l AS (
  SELECT id, arg_max(atan2(qz - pz, qx - px), [(qx - px) ** 2 + (qz - pz) ** 2, -pos]) AS a FROM ring GROUP BY id
), uv AS (SELECT id, a, px * cos(a) + pz * sin(a) AS u, pz * cos(a) - px * sin(a) AS v FROM ring JOIN l USING (id)), b AS (
  SELECT id, any_value(a) AS a, (min(u) + max(u)) / 2 AS u, (min(v) + max(v)) / 2 AS v, max(u) - min(u) AS w, max(v) - min(v) AS d FROM uv GROUP BY id
)
SELECT id, round(u * cos(a) - v * sin(a) + {TIE}, 6) + 0.0 AS cx, round(u * sin(a) + v * cos(a) + {TIE}, 6) + 0.0 AS cz, round(w + {TIE}, 6) AS w, round(d + {TIE}, 6) AS d, round(a, 6) + 0.0 AS angle, round(w * d + {TIE}, 6) AS area FROM b"""
)
def oriented_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of shapes along their longest edges (GEO-12)."""
    b = t.shapes(spark, sf_dir).select("id", rings.oriented_box(F.col("ring")).alias("b")).select("id", "b.*")
    ring = rings.oriented_rect(*(F.col(n) for n in ("cx", "cz", "w", "d", "angle")))
    near = lambda c: F.round(c + TIE, 6) + 0.0
    return b.select("id", *(near(F.col(c)).alias(c) for c in ("cx", "cz", "w", "d")), (F.round("angle", 6) + 0.0).alias("angle"), near(rings.area(ring)).alias("area"))


@query(
    f"""
WITH {t.SHAPES}, near AS (
  SELECT a.id AS one, b.id AS two FROM sh a JOIN sh b ON a.id < b.id AND a.x < b.x + b.w AND a.x + a.w > b.x AND a.z < b.z + b.d * 2 AND a.z + a.d * 2 > b.z
), ed AS (
  SELECT one, two, (a.qx - a.px) * (b.qz - b.pz) - (a.qz - a.pz) * (b.qx - b.px) AS den, (b.px - a.px) * (b.qz - b.pz) - (b.pz - a.pz) * (b.qx - b.px) AS tn, (b.px - a.px) * (a.qz - a.pz) - (b.pz - a.pz) * (a.qx - a.px) AS un FROM near JOIN ring a ON a.id = one JOIN ring b ON b.id = two
), crossing AS (
  SELECT DISTINCT one, two FROM ed WHERE abs(den) >= 1e-9 AND tn / den BETWEEN -1e-7 AND 1 + 1e-7 AND un / den BETWEEN -1e-7 AND 1 + 1e-7
), pts AS (SELECT id, px AS x, pz AS z FROM ring WHERE pos = 0), {INSIDE}
SELECT * FROM crossing UNION SELECT one, two FROM near JOIN ins ON (pid = one AND area = two) OR (pid = two AND area = one)"""
)
def overlapping_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of shapes that overlap (GEO-20)."""
    return polygons.overlaps(t.shapes(spark, sf_dir), "id", cell=16.0)


@query(
    f"""
WITH {BRICKS}, placed AS (SELECT wall, brick, (i % 5) * 8 + (i // 5) % 2 * 4 AS x, i // 5 * 4 AS z FROM bricks)
SELECT a.wall, least(a.brick, b.brick) AS a, greatest(a.brick, b.brick) AS b, CASE WHEN a.z = b.z THEN 4.0::DOUBLE ELSE (8 - abs(a.x - b.x))::DOUBLE END AS shared
FROM placed a JOIN placed b ON a.wall = b.wall AND ((a.z = b.z AND b.x = a.x + 8) OR (b.z = a.z + 4 AND abs(a.x - b.x) < 8))"""
)
def brick_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of a wall that share boundary, and how much (JN-9, GEO-18)."""
    lots = bricks(spark, sf_dir).select(F.col("wall").alias("piece"), F.col("brick").alias("parcel"), "ring")
    return land.adjacent(lots).select(F.col("piece").alias("wall"), "a", "b", F.round("shared", 6).alias("shared"))


# ---- terrain

BANKS = (-60.0, 35.5)
RIVER = f"(CASE WHEN {{x}} <= {BANKS[0]} OR {{x}} >= {BANKS[1]} THEN 1 ELSE -1 END * least(abs({{x}} - {BANKS[0]}), abs({{x}} - {BANKS[1]})))"


def _river() -> fields.Field:
    return fields.water_distance({"kind": "river", "x0": BANKS[0], "x1": BANKS[1]})


@query(
    f"""
WITH {t.STREETS}, n AS (SELECT *, greatest(1, ceil(sqrt((bx - ax) ** 2 + (bz - az) ** 2) / 0.125))::BIGINT AS n FROM st WHERE level = 0), p AS (SELECT *, unnest(range(n + 1)) AS k FROM n), q AS (SELECT src, k, ax + (bx - ax) * k / n AS x, az + (bz - az) * k / n AS z FROM p)
SELECT src, round(arg_min(x, k), 6) + 0.0 AS x, round(arg_min(z, k), 6) + 0.0 AS z FROM q WHERE {RIVER.format(x='x')} < -0.25 GROUP BY src"""
)
def wet_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets at grade that run into a river, and where (FLT-17)."""
    s = t.streets(spark, sf_dir).where("level = 0").select(F.col("src").alias("edge"), "ax", "az", "bx", "bz")
    found = terrain.water_offences(s, _river())
    return found.select(F.col("edge").alias("src"), (F.round("x", 6) + 0.0).alias("x"), (F.round("z", 6) + 0.0).alias("z"))


GROUND = f"({HEIGHT} * least(1.0, greatest(0.0, {RIVER.format(x='x')} / 36.0)) ** 2 * (3 - 2 * least(1.0, greatest(0.0, {RIVER.format(x='x')} / 36.0))))"


# Corners and points along the edges, cells of a grid whose middles lie inside, and the centroid.
@query(
    f"""
WITH {t.SHAPES}, along AS (
  SELECT id, px + (qx - px) * k / n AS x, pz + (qz - pz) * k / n AS z FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, greatest(1, ceil(sqrt((qx - px) ** 2 + (qz - pz) ** 2) / 8))::BIGINT AS n FROM ring))
), cells AS (
  SELECT id, x + w * (i + 0.5) / nx AS x, z + d * 2 * (j + 0.5) / nz AS z FROM (SELECT *, unnest(range(nz)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM (SELECT *, greatest(1, ceil(w / 8))::BIGINT AS nx, greatest(1, ceil(d * 2 / 8))::BIGINT AS nz FROM sh)))
), inner_ AS (
  SELECT c.id, c.x, c.z FROM cells c JOIN ring r ON r.id = c.id AND (r.pz > c.z) <> (r.qz > c.z) AND c.x < (r.px - r.qx) * (c.z - r.qz) / (r.pz - r.qz) + r.qx GROUP BY ALL HAVING count(*) % 2 = 1
), middle AS (
  SELECT id, sum((px + qx) * (px * qz - qx * pz)) / (3 * sum(px * qz - qx * pz)) AS x, sum((pz + qz) * (px * qz - qx * pz)) / (3 * sum(px * qz - qx * pz)) AS z FROM ring GROUP BY id
), every AS (SELECT * FROM along UNION ALL SELECT * FROM inner_ UNION ALL SELECT * FROM middle)
SELECT id, round(min({GROUND}), 6) AS low, round(max({GROUND}), 6) AS high FROM every GROUP BY id"""
)
def house_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest ground under shapes, on terrain that runs down to a river (AGG-15, TER-1, TER-2, TER-9)."""
    told = terrain.anchors(t.shapes(spark, sf_dir), terrain.ground(fields.elevation("town"), _river()), ["id"])
    return told.select("id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# ---- imported streets

SURFACE = f"""{ROADS}, surface AS (
  SELECT row_number() OVER (ORDER BY src, nth) - 1 AS e, level, cls, x, z, qx, qz, CASE cls WHEN 'arterial' THEN 20.0::DOUBLE WHEN 'collector' THEN 13.0::DOUBLE ELSE 9.0::DOUBLE END AS width, sqrt((qx - x) ** 2 + (qz - z) ** 2) AS len FROM ed
)"""


@query(f"WITH {SURFACE} SELECT x AS ax, z AS az, qx AS bx, qz AS bz, CASE WHEN level > 0 THEN 'bridge' ELSE 'road' END AS kind, width, round(len, 6) AS len, round(len * width + {TIE}, 6) AS area FROM surface")
def road_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ribbons of the imported streets' edges (FAB-4)."""
    g = _roads(spark, sf_dir)
    ends = network.with_ends(g.edges, g.nodes.drop("level")).select("edge", "ax", "az", "bx", "bz")
    told = network.ribbons(g.nodes.drop("level"), g.edges).join(ends, "edge")
    return told.select("ax", "az", "bx", "bz", "kind", "width", F.round("len", 6).alias("len"), F.round(rings.area(F.col("ring")) + TIE, 6).alias("area"))


@query(
    f"""
WITH {SURFACE}, ends AS (
  SELECT level, x, z, width, (qx - x) / len AS c, (qz - z) / len AS s FROM surface UNION ALL SELECT level, qx, qz, width, (x - qx) / len, (z - qz) / len FROM surface
), met AS (SELECT level, x, z, count(*) AS n, max(width) AS most, min(width) AS least, sqrt(sum(c) ** 2 + sum(s) ** 2) AS bend FROM ends GROUP BY level, x, z)
SELECT x, z, most / 2 AS r, n FROM met WHERE n >= 2 AND NOT (n = 2 AND most = least AND bend < 1e-6)"""
)
def road_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps of the imported streets' junctions, with the edges that meet there (GR-8, AGG-6)."""
    g = _roads(spark, sf_dir)
    return network.junction_caps(g.nodes.drop("level"), g.edges).join(network.degrees(g.edges), "node").select("x", "z", "r", F.col("degree").alias("n"))


@query(
    f"""
WITH {t.STREETS}, l AS (SELECT s_nationkey::BIGINT AS corridor, src AS edge, sqrt((bx - ax) ** 2 + (bz - az) ** 2) AS length FROM st JOIN supplier ON s_suppkey = src WHERE cls <> 'local')
SELECT corridor, arg_max(edge, [length, -edge]) AS edge, round(max(length), 6) AS length FROM l GROUP BY corridor HAVING max(length) >= 120"""
)
def street_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge of each corridor that bears its name (SRT-13)."""
    s = t.streets(spark, sf_dir).select(F.col("src").alias("edge"), "cls", scalars.distance(*map(F.col, ("ax", "az", "bx", "bz"))).alias("length"))
    owned = t.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("corridor"), F.col("s_suppkey").cast("long").alias("edge"), F.col("s_suppkey").cast("long").alias("pos"))
    return network.label_edges(owned, s).select("corridor", "edge", F.round("length", 6).alias("length"))


@query(f"WITH {t.LINKS}, w AS (SELECT edge, a AS node, b AS other FROM lk UNION ALL SELECT edge, b, a FROM lk) SELECT node, string_agg(edge::VARCHAR || '>' || other::VARCHAR, ',' ORDER BY edge, other) AS steps, count(*) AS n FROM w GROUP BY node")
def link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each part, by link (SRT-4)."""
    links = t.links(spark, sf_dir).withColumn("cls", F.lit("local"))
    k = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    lists = network.adjacency_lists(network.adjacency(k, links))
    told = F.array_join(F.transform("steps", lambda s: F.concat(s["edge"].cast("string"), F.lit(">"), s["next"].cast("string"))), ",")
    return lists.select("node", told.alias("steps"), F.size("steps").cast("long").alias("n"))


# ---- zones

ZONES = (0.48, "residential"), (0.70, "mixed"), (0.84, "commercial"), (0.94, "industrial")


@query(
    f"""
WITH s AS (SELECT c_custkey, (c_custkey % 9) / 10.0::DOUBLE AS dist, {FNV.format("c_custkey::VARCHAR || ':zones'")} AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 'civic' ELSE 'mixed' END AS sector FROM customer), u AS (SELECT *, ({STEP.format("CASE WHEN s = 0 THEN 2654435769 ELSE s END")}) / 4294967296.0::DOUBLE AS u FROM s)
SELECT c_custkey, CASE WHEN sector <> 'mixed' THEN sector WHEN dist < 0.22 AND u < 0.62 THEN 'commercial' {' '.join(f"WHEN u < {most} THEN '{zone}'" for most, zone in ZONES)} ELSE 'civic' END AS zone FROM u"""
)
def site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of sites by sector, distance and a draw (FLT-19)."""
    u = F.element_at(randoms.draws(randoms.stream(F.col("c_custkey"), "zones"), 1), 1)
    told = t.read(spark, sf_dir, "customer").withColumn("u", u).withColumn("sector", F.when(F.col("c_mktsegment") == "BUILDING", "civic").otherwise("mixed"))
    return told.select("c_custkey", tags.zone_of(F.col("sector"), F.col("c_custkey") % 9 / 10.0, F.col("u")).alias("zone"))
