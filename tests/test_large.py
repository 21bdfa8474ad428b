"""What a query may cost as its tables grow: jobs, joins and rows that meet."""

import math
import random

from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators import parcels, polygons


def jobs(spark, f):
    """The result of f and the jobs it started."""
    sc = spark.sparkContext
    name = f"jobs-{f.__name__}"
    sc.setJobGroup(name, name)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_rings_are_cut_in_one_pass(spark):
    ring = rings.of((0, 0), (9, 0), (9, 4), (7, 4), (7, 1), (5, 1), (5, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4))
    items = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"), F.lit(0.0).alias("nx"), F.lit(-1.0).alias("nz"), F.lit(-2.0).alias("c"))

    def cut():
        return polygons.half_plane_pieces(items, "id")

    found, started = jobs(spark, cut)
    assert started == 0 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.groupBy("id").agg(F.count("*").alias("n"), F.sum(rings.area(F.col("ring"))).alias("a")).collect()
    assert len(got) == 50 and all(r.n == 3 and abs(r.a - 10.0) < 1e-9 for r in got)


def test_pieces_of_odd_rings(spark):
    """Rings that are null, empty, of two points, beyond the line, on it, or all the same point; no planes; equal keys of any type."""
    rows = [("null", None, 1.0), ("none", [], 1.0), ("two", [(0, 0), (1, 0)], 1.0), ("out", [(5, 0), (6, 0), (6, 1)], 1.0), ("in", [(0, 0), (1, 0), (1, 1)], 1.0), ("flat", [(2, 2)] * 4, 9.0), ("edge", [(1, 0), (3, 0), (3, 2), (1, 2)], 1.0), ("plane", [(0, 0), (1, 0), (1, 1)], None)]
    items = spark.createDataFrame([(k, r and [(float(x), float(z)) for x, z in r] if r else r, c) for k, r, c in rows], "k string, ring array<struct<x:double,z:double>>, c double")
    got = polygons.half_plane_pieces(items.withColumn("nx", F.lit(1.0)).withColumn("nz", F.lit(0.0)), "k").collect()
    assert [(r.k, [(p.x, p.z) for p in r.ring]) for r in got] == [("in", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]


def test_rings_are_halved_in_a_job_or_two_a_round(spark):
    """Bent rings too: before, a round had a job for each step of pointer doubling."""
    bay = rings.of((0, 0), (12, 0), (12, 9), (8, 9), (8, 3), (4, 3), (4, 9), (0, 9))
    blocks = spark.range(40).select("id", bay.alias("ring"))

    def halve():
        return parcels.subdivide(blocks, "id", 12.0, 1.0, least_area=0.0)

    found, started = jobs(spark, halve)
    assert started <= 4 * 10
    assert all(abs(r.a - 84.0) < 1e-6 for r in found.groupBy("id").agg(F.sum(rings.area(F.col("ring"))).alias("a")).collect())
    assert not found.where(rings.area(F.col("ring")) >= 24).count() and found.select("id", "path").distinct().count() == found.count()


def test_a_cut_beside_a_corner_takes_no_area(spark):
    """A house of 1.2 million whose cut ran within a millionth of its corner: it lost area beyond the rounding."""
    x, z = 383876 * 37 % 3401 / 4 - 450, 383876 * 91 % 3401 / 4 - 450
    d = 383876 % 17 / 4 + 2
    w = 121.5 / 1.5 / d
    house = spark.range(383876, 383877).select("id", rings.of((x, z), (x + w, z), (x + w, z + d), (x + w / 2, z + d * 2), (x, z + d)).alias("ring"))
    found = parcels.subdivide(house, "id", 12.0, 1.0, least_area=0.0).agg(F.sum(rings.area(F.col("ring"))).alias("a")).first()
    assert abs(found.a - 121.5) < 1e-7


def test_a_right_of_way_is_cut_off_in_a_job(spark):
    house = rings.of((0, 0), (6, 0), (6, 4), (3, 8), (0, 4))
    items = spark.range(30).select("id", house.alias("ring"), F.lit(4.0).alias("x"), F.lit(-1.0).alias("z"), F.lit(9.0).alias("w"), F.lit(3.0).alias("d"))

    def trim():
        return polygons.trimmed(items, "id", ("x", "z", "w", "d"), 0.0, 3.0)

    found, started = jobs(spark, trim)
    got = found.select(rings.area(F.col("ring")).alias("a")).collect()
    assert started <= 2 and len(got) == 30 and all(abs(r.a - 76 / 3) < 1e-9 for r in got)


def test_limits_of_water_measure_few_sides(monkeypatch):
    """Fields.below tells what water() does, and measures only the sides that are near."""
    import random

    from loomgrid.kernel import city, plane

    rng = random.Random(5)
    lakes = []
    for _ in range(30):
        x, z, w = rng.uniform(-460, 440), rng.uniform(-460, 440), rng.choice([3, 12, 60])
        outer = [(x, z), (x + w, z), (x + w, z + 9), (x + w / 2, z + 18), (x, z + 9)]
        lakes.append([outer, [(x + 1, z + 1), (x + 2, z + 1), (x + 2, z + 2)]] if w > 3 else [outer])
    kinds = [{"kind": "imported", "water": lakes}, {"kind": "imported", "water": []}, {"kind": "river", "x0": -60, "x1": 35.5}, {"kind": "island", "rx": 387.0, "rz": 342.0}]
    for land in kinds:
        f = city.Fields({"seed": "s"}, land, None)
        spots = [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(500)] + [(p[0] + rng.uniform(-0.6, 0.6), p[1] + rng.uniform(-0.6, 0.6)) for side in f.sides for p in side for _ in range(4)]
        for limit in (-0.25, 0.0, 0.5):
            assert [f.below(x, z, limit) for x, z in spots] == [f.water(x, z) < limit for x, z in spots]
    f, calls = city.Fields({"seed": "s"}, kinds[0], None), []
    monkeypatch.setattr(plane, "foot", lambda p, a, b, foot=plane.foot: calls.append(1) or foot(p, a, b))
    for _ in range(1000):
        f.below(rng.uniform(-400, 400), rng.uniform(-400, 400), 0.5)
    assert len(calls) < 5000 < 1000 * len(f.sides)


def test_sizes_of_cities_are_those_of_their_tables(spark):
    from loomgrid.operators import cities

    configs = spark.createDataFrame([("a", "graph", "low"), ("b", "none", "low"), ("c", "bsp", "low")], "city_id string, engine string, density string").withColumn("seed", F.col("city_id"))
    names = ["blocks", "edges", "faults"]
    got = {r.city_id: tuple(r[n] for n in names) for r in cities.sizes(configs, names, 2).collect()}
    rows = cities.Cities(configs).rows.groupBy("city_id").pivot("name", names).count().na.fill(0).collect()
    assert got == {r.city_id: tuple(r[n] for n in names) for r in rows} and len(got) == 3


def test_overlaps_of_pairs_are_those_of_the_expression(spark):
    import random

    rng = random.Random(8)
    blob = lambda n: (lambda x, z: [(x + rng.randint(-4, 4) / 2, z + rng.randint(-4, 4) / 2) for _ in range(n)])(rng.randint(0, 6), rng.randint(0, 6))
    rows = [(k, k + 1000, blob(rng.choice([3, 4, 5, 7])), blob(rng.choice([3, 4, 6]))) for k in range(400)] + [(900, 901, None, blob(3)), (902, 903, [], blob(3))]
    told = spark.createDataFrame(rows, "one long, two long, ra array<struct<x:double,z:double>>, rb array<struct<x:double,z:double>>").repartition(3)
    got = polygons.overlapping(told.withColumn("p", rings.bounds(F.col("ra"))).withColumn("q", rings.bounds(F.col("rb"))), "one", "two", "ra", "rb")
    want = {r.one for r in told.where("size(ra) > 0").where(rings.meet(F.col("ra"), F.col("rb"))).collect()}
    assert {r.one for r in got.collect()} == want and 50 < len(want) < 380


def test_cells_of_a_join_of_many_pairs_are_dealt_to_many_tasks(spark):
    """A few bytes of rows were put together in a task or two, however many pairs they make."""
    from loomgrid.operators.grid_join import grid_join

    a = spark.range(400).select(F.col("id").alias("one"), (F.col("id") % 20 * 10.0).alias("x"), (F.col("id") / 20 * 10.0).alias("z"))
    b = a.toDF("two", "u", "w")
    at = lambda *c: tuple(F.col(n) for n in c)
    met = grid_join(a, b, at("x", "z", "x", "z"), at("u", "w", "u", "w"), 16.0, dense=True)
    assert met.select(F.spark_partition_id()).distinct().count() > 16
    assert met.count() == grid_join(a, b, at("x", "z", "x", "z"), at("u", "w", "u", "w"), 16.0).count()


def test_shared_boundary_is_measured_where_boxes_touch(spark):
    """As the expression has it, and that expression isn't in the join any more, where it went over all parcels of a cell."""
    from loomgrid.operators import land

    lots = spark.range(60).select((F.col("id") % 2).alias("piece"), F.col("id").alias("parcel"), rings.rect(F.floor(F.col("id") / 10) * 4.0, F.col("id") % 10 * 3.0, F.lit(4.0), F.lit(6.0)).alias("ring"))
    found = land.adjacent(lots)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    a, b = lots.toDF("piece", "a", "ra"), lots.toDF("piece", "b", "rb")
    want = a.join(b, "piece").where("a < b").select("a", "b", rings.shared_length(F.col("ra"), F.col("rb")).alias("shared")).where("shared > 1e-6").collect()
    assert {(r.a, r.b, round(r.shared, 9)) for r in found.collect()} == {(r.a, r.b, round(r.shared, 9)) for r in want} and len(want) > 60


def test_shapes_are_dealt_to_all_cores(spark, tmp_path):
    """A file of parts has a partition or two, and all that is made of its shapes ran in them."""
    from loomgrid.plans import polygons as plans
    from loomgrid.plans import tables as t

    spark.range(2000).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size", "'n' as p_name", "'b' as p_brand", "'t' as p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (t.shapes, plans.combs, plans.bricks):
        assert made(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_streets_that_lie_in_each_other_meet_by_lots(spark):
    """As the expression has it over all pairs, whose join held all streets of a cell against each other; a start with more streets than a lot too."""
    import random

    from loomgrid.functions import segments
    from loomgrid.operators import noding

    rng = random.Random(3)
    one = lambda: (rng.randint(0, 9) * 4.0, rng.randint(0, 9) * 4.0, rng.choice([-1, 0, 1]), rng.choice([-1, 1]), rng.randint(1, 24) / 2)
    told = [one() for _ in range(150)] + [(8.0, 8.0, 1, 1, k % 40 + 1.0) for k in range(150)] + [(8.0, 12.0, 1, 0, k + 1.0) for k in range(8)]
    rows = [(k * 5 % len(told), float(k % 5 == 0), x, z, x + ux * n, z + uz * n) for k, (x, z, ux, uz, n) in enumerate(told)] + [(None, 0.0, 1.0, 1.0, 9.0, 1.0), (999, 0.0, 1.0, 1.0, None, 1.0)]
    streets = spark.createDataFrame(rows, "sid long, level double, ax double, az double, bx double, bz double").repartition(3)
    whole = streets.dropna()
    other = whole.toDF("s2", "l2", "cx", "cz", "dx", "dz")
    eight = map(F.col, ("ax", "az", "bx", "bz", "cx", "cz", "dx", "dz"))
    want = whole.crossJoin(other).where("sid < s2 and level = l2").where(segments.touch(*eight)).select("sid", "s2").collect()
    found = noding.touching(streets, 10.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 9_000
    assert found.rdd.getNumPartitions() > 16


def test_tags_are_made_and_read_once(spark, tmp_path):
    """The number of faults was a filter that held all tags over again, wherever they were named; null tags and repeated ids too."""
    from loomgrid.functions import tags
    from loomgrid.plans import queries

    spark.range(400).selectExpr("id div 4 as l_orderkey", "cast(id % 5 as int) as l_linenumber", "id * 7 % 90 as l_partkey", "id * 11 % 80 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries.metadata_diagnostics(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1 and "filter(array" not in plan
    each = [(r.id, f) for r in queries._road_tags(spark, str(tmp_path)).select("id", "m.faults").collect() for f in r.faults]
    want = {c: (sum(f == c for _, f in each), len({i for i, f in each if f == c}), min(i for i, f in each if f == c)) for c in {f for _, f in each}}
    assert {r.code: (r.n, r.roads, r.first_id) for r in found.collect()} == want and len(want) == 6
    odd = spark.createDataFrame([(1, None), (2, {}), (3, {"class": "x", "highway": "y", "width": "0", "lanes": "no", "bridge": "2", "tunnel": "?", "layer": "up"}), (4, {"class": "local", "highway": "y", "width": "3 m", "lanes": "no"})], "id int, tags map<string,string>")
    got = [r.faults for r in odd.select("id", tags.road_metadata(F.col("tags"))["faults"].alias("faults")).orderBy("id").collect()]
    assert got == [[], [], ["invalid-class", "invalid-class", "invalid-width", "invalid-lanes", "invalid-bridge", "invalid-tunnel", "invalid-level"], []]


def test_parcels_are_made_once_and_rings_straightened_once(spark):
    """What parcels are made of ran again for their shapes; a ring that is itself an expression was put together some sixty times."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lots = spark.range(40).select((F.col("id") % 2).alias("g"), F.col("id").alias("p"), rings.rect(F.floor(F.col("id") / 10) * 4.0, F.floor(F.col("id") % 10 / 2) * 4.0, F.lit(4.0), F.lit(4.0)).alias("ring"), (F.col("id") < 2).alias("frontage"))
    got = parcels.merge_landlocked(lots.mapInArrow(counted, lots.schema), "g", "p").collect()
    assert made.value == 40 and sorted((r.g, r.members, r.frontage) for r in got) == [(0, 20, True), (1, 20, True)]
    ring = rings.of((0, 0), (1, 0), (2, 0), (2, 2), (2, 2), (0, 2))
    told = spark.range(1).select(rings.straightened(F.transform(ring, lambda p: rings.point(p["x"] + F.col("id"), p["z"]))).alias("r"))
    assert told._jdf.queryExecution().analyzed().toString().count("array(struct") < 3
    assert [tuple(p) for p in told.first().r] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


def test_rings_are_shrunk_within_their_tasks(spark, monkeypatch):
    """A ring is a row: neither the jobs nor the joins go by the rings, and what comes out is what the rounds over all of them give."""
    rng = random.Random(8)
    star = lambda n: [(math.cos(k / n * math.tau) * (r := rng.uniform(3, 12)), math.sin(k / n * math.tau) * r) for k in range(n)]
    neck = [(float(x), float(z)) for x, z in ((0, 0), (12, 0), (12, 4.5), (20, 4.5), (20, 0), (32, 0), (32, 12), (20, 12), (20, 7.5), (12, 7.5), (12, 12), (0, 12))]
    each = [star(rng.randint(3, 14)) for _ in range(60)] + [neck, neck[::-1], [neck[0], *neck], [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)]]
    rows = [(n, s, [rng.choice([0.0, 0.3, 0.9, 1.75]) for _ in s]) for n, s in enumerate(each)] + [(100 + n, neck, [d] * 12) for n, d in enumerate((0.5, 1.5, 2.0, 7.0))]
    rows += [(200, None, [1.0]), (201, neck, None), (202, neck, [1.0]), (203, neck, [None] * 12)]
    told = spark.createDataFrame(rows, f"id long, ring {rings.RING}, distances array<double>").repartition(2)

    def shrink():
        return polygons.inset(told, "id").collect()

    found, started = jobs(spark, shrink)
    assert started <= 6  # rounds took more than fifty
    size = lambda rows: sorted((r.id, len(r.ring), round(sum(p.x * q.z - q.x * p.z for p, q in zip(r.ring, r.ring[1:] + r.ring[:1], strict=True)) / 2, 6)) for r in rows)
    monkeypatch.setattr(polygons, "FEW", 0)
    assert size(found) == size(polygons.inset(told, "id").collect()) and len(found) > 40
