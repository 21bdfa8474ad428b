"""Road-network analytics over nodes (node, x, z, level) and edges (edge, a, b, cls, width, ...).

Edges of the classes VIRTUAL and removed edges are no roads and take no part. Iterations are joins and aggregations with
a checkpoint a round, so graphs may be larger than any task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.functions.scalars import right_lane_offset
from loomgrid.operators.components import connected_components
from loomgrid.operators.shared import Rounds, cut

# Classes that are no roads, driving speeds, and the tolerance of a budget.
VIRTUAL = ("boundary", "shore")
SPEEDS = {"arterial": 1.45, "collector": 1.12, "local": 0.86}
BUDGET_SLACK = 1e-12
EASE = 4.0


def _flag(edges: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in edges.columns else F.lit(False)


def drivable(edges: DataFrame) -> DataFrame:
    return edges.where(~_flag(edges, "removed") & ~F.col("cls").isin(*VIRTUAL))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ax, az, bx, bz and their length."""
    end = lambda n, x, z: nodes.select(F.col("node").alias(n), F.col("x").alias(x), F.col("z").alias(z))
    joined = edges.join(end("a", "ax", "az"), "a").join(end("b", "bx", "bz"), "b")
    return joined.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2))


def adjacency(nodes: DataFrame, edges: DataFrame, speeds: Mapping[str, float] = SPEEDS) -> DataFrame:
    """(node, edge, next, length, cost): every drivable edge from both ends; cost is length over the class's speed."""
    speed = F.coalesce(*(F.when(F.col("cls") == c, F.lit(v)) for c, v in speeds.items()), F.lit(speeds.get("local", 1.0)))
    told = with_ends(drivable(edges), nodes).select("edge", "a", "b", "length", (F.col("length") / speed).alias("cost"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("w")
    return told.select("edge", "length", "cost", ways).select("w.node", "edge", "w.next", "length", "cost")


def adjacency_lists(steps: DataFrame) -> DataFrame:
    """One row a node with its steps by edge, then node."""
    return steps.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("edge", "next", "length", "cost"))).alias("steps"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = drivable(edges).select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


PLAIN = 3  # rounds that take off one edge a dead end, before whole chains are


def _loose(left: DataFrame, whole_chains: bool) -> DataFrame:
    """(edge) with a loose end; or all edges of the chains that have one. A chain is edges that follow each other over nodes of two."""
    ends = left.select("edge", F.explode(F.array("a", "b")).alias("node"))
    at = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("edge").alias("edge"), F.max("edge").alias("other"))
    loose = at.where("n = 1").select("edge").distinct()
    if not whole_chains:
        return loose
    chains = connected_components(at.where("n = 2 and edge <> other"), "edge", "other").withColumnRenamed("node", "edge")
    named = loose.join(chains.hint("merge"), "edge", "left")
    members = chains.join(named.where("component is not null").select("component").distinct().hint("merge"), "component", "left_semi").select("edge")
    return members.unionAll(named.where("component is null").select("edge"))


def spurs(edges: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """Edges that hang on a dead end: those that fall away when edges with a loose end are taken off again and again. After some
    rounds whole chains fall at once, so the rounds grow with the branching of a dead end, not with its length."""
    left = cut(edges.select("edge", "a", "b"))
    taken = []
    for n in range(most_rounds):
        loose = cut(_loose(left, n >= PLAIN))
        if loose.isEmpty():
            return reduce(DataFrame.unionAll, taken) if taken else loose
        taken.append(loose)
        left = cut(left.join(loose.hint("merge"), "edge", "left_anti"))
    raise RuntimeError(f"dead ends did not settle in {most_rounds} rounds")


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, budget: float, most_rounds: int = 10_000) -> DataFrame:
    """(start, node, distance) within a budget of walked length from each of starts (start), by rounds of relaxation.
    Only the nodes that a round has brought nearer go on in the next one. Unknown starts have no rows."""
    if not (math.isfinite(budget) and budget >= 0):
        raise ValueError("the budget is finite and not negative")
    steps = cut(adjacency(nodes, edges).select("node", "next", "length"))
    known = cut(starts.select("start").distinct().join(nodes.select(F.col("node").alias("start")), "start", "left_semi").select("start", F.col("start").alias("node"), F.lit(0.0).alias("distance")))
    front = known
    for _ in range(most_rounds):
        found = front.join(steps, "node").select("start", F.col("next").alias("node"), (F.col("distance") + F.col("length")).alias("distance")).where(F.col("distance") <= budget + BUDGET_SLACK)
        best = found.groupBy("start", "node").agg(F.min("distance").alias("distance"))
        old = known.select("start", "node", F.col("distance").alias("old"))
        front = cut(best.join(old, ["start", "node"], "left").where(F.col("old").isNull() | (F.col("distance") < F.col("old") - BUDGET_SLACK)).select("start", "node", "distance"))
        if front.isEmpty():
            return known
        known = cut(known.unionAll(front).groupBy("start", "node").agg(F.min("distance").alias("distance")))
    raise RuntimeError(f"distances did not settle in {most_rounds} rounds")


def reached_edges(reached: DataFrame, nodes: DataFrame, edges: DataFrame, budget: float) -> DataFrame:
    """(start, edge) of edges that can be walked to their far end within the budget."""
    steps = adjacency(nodes, edges).select("node", "edge", "length")
    return reached.join(steps, "node").where(F.col("distance") + F.col("length") <= budget + BUDGET_SLACK).select("start", "edge").distinct()


def edge_traffic(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(edge, traffic): how often routes (route, pos, edge) use each edge, zero included."""
    used = steps.groupBy("edge").agg(F.count("*").alias("traffic"))
    return edges.select("edge").join(used, "edge", "left").select("edge", F.coalesce("traffic", F.lit(0)).cast("long").alias("traffic"))


def corridor_traffic(corridor_edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(corridor, traffic); an edge of several corridors counts for the last one."""
    owner = corridor_edges.groupBy("edge").agg(F.max("corridor").alias("corridor"))
    used = steps.join(owner, "edge").groupBy("corridor").agg(F.count("*").alias("traffic"))
    every = corridor_edges.select("corridor").distinct()
    return every.join(used, "corridor", "left").select("corridor", F.coalesce("traffic", F.lit(0)).cast("long").alias("traffic"))


def traffic_heat(traffic: DataFrame) -> DataFrame:
    """Level of the heat overlay: the root of the share of the busiest edge."""
    told = traffic.withColumn("most", traffic.agg(F.max("traffic")).scalar())
    return told.select("edge", "traffic", F.when(F.col("most") > 0, F.sqrt(F.col("traffic") / F.col("most"))).otherwise(0.0).alias("heat"))


def ribbons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An oriented rectangle per surface edge; kind is bridge for elevated ones."""
    live = drivable(edges)
    surface = live.where(~_flag(live, "tunnel") & (F.coalesce("level", F.lit(0.0)) >= 0))
    told = with_ends(surface, nodes)
    cx, cz, angle = (F.col("ax") + F.col("bx")) / 2, (F.col("az") + F.col("bz")) / 2, F.atan2(F.col("bz") - F.col("az"), F.col("bx") - F.col("ax"))
    elevated = _flag(edges, "bridge") | (F.coalesce("level", F.lit(0.0)) > 0)
    return told.select("edge", "cls", F.when(elevated, "bridge").otherwise("road").alias("kind"), "width", F.col("length").alias("len"), angle.alias("angle"), cx.alias("cx"), cz.alias("cz"), rings.oriented_rect(cx, cz, F.col("length"), F.col("width"), angle).alias("ring"))


def junction_caps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x, z, r): round caps where two or more surface edges meet, but not where a street of one width goes straight on."""
    live = drivable(edges)
    told = with_ends(live.where(~_flag(live, "tunnel") & (F.coalesce("level", F.lit(0.0)) >= 0)), nodes)
    heading = F.atan2(F.col("bz") - F.col("az"), F.col("bx") - F.col("ax"))
    ends = told.select("width", F.explode(F.array(F.struct(F.col("a").alias("node"), F.cos(heading).alias("c"), F.sin(heading).alias("s")), F.struct(F.col("b").alias("node"), (-F.cos(heading)).alias("c"), (-F.sin(heading)).alias("s")))).alias("e")).select("width", "e.*")
    met = ends.groupBy("node").agg(F.count("*").alias("n"), F.max("width").alias("most"), F.min("width").alias("least"), F.sqrt(F.sum("c") ** 2 + F.sum("s") ** 2).alias("bend"))
    caps = met.where("n >= 2").where(~((F.col("n") == 2) & (F.col("most") == F.col("least")) & (F.col("bend") < 1e-6)))
    return caps.join(nodes, "node").select("node", "x", "z", (F.col("most") / 2).alias("r"))


def route_lengths(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(route, length) of steps (route, pos, edge), added up in order."""
    told = steps.join(lengths.select("edge", "length"), "edge")
    ordered = told.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("s"))
    return ordered.select("route", F.aggregate("s", F.lit(0.0), lambda t, s: t + s["length"]).alias("length"))


def positions(cars: DataFrame, steps: DataFrame) -> DataFrame:
    """Where cars are. cars: car, t, speed, elapsed (several rows a car are fine). steps: car, pos, edge, fx, fz, tx, tz, width,
    bridge, tunnel, level, from the start of the route on. Cars turn back at either end, keep right and ease into junctions."""
    along = Window.partitionBy("car").orderBy("pos")
    length = F.sqrt((F.col("tx") - F.col("fx")) ** 2 + (F.col("tz") - F.col("fz")) ** 2)
    laid = steps.withColumn("len", length).withColumn("to", F.sum("len").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("from", F.col("to") - F.col("len")).withColumn("last", F.lead("pos").over(along).isNull())
    total = laid.groupBy("car").agg(F.max("to").alias("total")).where("total > 0")
    number = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).otherwise(0.0)
    moved = cars.join(total, "car").withColumn("phase", F.pmod(number("t") + number("elapsed") * number("speed"), F.col("total") * 2))
    moved = moved.withColumn("forward", F.col("phase") <= F.col("total")).withColumn("travel", F.when(F.col("forward"), F.col("phase")).otherwise(F.col("total") * 2 - F.col("phase")))
    here = moved.join(laid, "car").where(((F.col("travel") <= F.col("to")) | F.col("last")) & ((F.col("travel") > F.col("from")) | (F.col("pos") == 0)))
    first = here.groupBy(*cars.columns, "phase", "forward", "travel").agg(F.min_by(F.struct(*(c for c in laid.columns if c != "car")), "pos").alias("s"))
    s = lambda c: F.col(f"s.{c}")
    long = F.when(s("len") > 0, s("len")).otherwise(1.0)
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("travel") - s("from")) / long))
    ease = F.least(F.lit(EASE), long / 2)
    inset = right_lane_offset(s("width"), s("bridge")) * F.least(F.lit(1.0), u * long / ease, (1 - u) * long / ease)
    side = F.when(F.col("forward"), 1.0).otherwise(-1.0)
    dx, dz = s("tx") - s("fx"), s("tz") - s("fz")
    level = F.coalesce(s("level"), F.lit(0.0))
    return first.select(
        *cars.columns,
        s("edge").alias("edge"),
        (s("fx") + dx * u + dz / long * inset * side).alias("x"),
        (s("fz") + dz * u - dx / long * inset * side).alias("z"),
        (-(F.atan2(dz, dx) + F.when(F.col("forward"), 0.0).otherwise(math.pi))).alias("rot"),
        F.coalesce(s("bridge"), F.lit(False)).alias("bridge"),
        (F.coalesce(s("bridge"), F.lit(False)) | (level > 0)).alias("elevated"),
        (F.coalesce(s("tunnel"), F.lit(False)) | (level < 0)).alias("below_grade"),
    )


def car_heights(placed: DataFrame, ground: Column, deck: Column, surface_offset: float, deck_offset: float) -> DataFrame:
    """y and visible of placed cars: on the deck, on the ground, or below grade and unseen."""
    y = F.when(F.col("below_grade"), 0.0).when(F.col("elevated"), deck + deck_offset).otherwise(ground + surface_offset)
    return placed.withColumn("y", y).withColumn("visible", ~F.col("below_grade"))


def top_streets(corridors: DataFrame, n: int = 6) -> DataFrame:
    """The n longest corridors; of equals the earlier."""
    return corridors.orderBy(F.desc("length"), "seq").limit(n)


def top_traffic(corridors: DataFrame, n: int = 3) -> DataFrame:
    return corridors.orderBy(F.desc("traffic"), "seq").limit(n)


def label_edges(corridor_edges: DataFrame, lengths: DataFrame, least: float = 120.0) -> DataFrame:
    """The longest edge of each corridor that isn't local, where it is long enough for a name."""
    told = corridor_edges.join(lengths.select("edge", "length", "cls"), "edge").where(F.col("cls") != "local")
    longest = told.groupBy("corridor").agg(F.max_by(F.struct("edge", "length"), F.struct("length", (-F.col("pos")).alias("first"))).alias("e"))
    return longest.where(F.col("e.length") >= least).select("corridor", "e.edge", "e.length")


def least_cost(steps: DataFrame, pairs: DataFrame, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(reached, pairs): for each of pairs (start, goal) what a search from start has reached on its cheapest ways: (start, node, cost,
    before, edge, hops), before and edge being the last step; and the pairs themselves, made distinct.

    steps: (node, edge, next, cost), costs not negative. All searches go on together, a step a round; only nodes that came nearer go on,
    and only while they are cheaper than the dearest goal of their search, once that has found them all. Of ways that cost the same the
    first that is found stays, of those of one round the one over the least node and edge."""
    pairs = cut(pairs.select("start", "goal").distinct())
    steps = cut(steps.select("node", "edge", "next", "cost"))
    spark = pairs.sparkSession
    goals = pairs.groupBy("start").agg(F.count("*").alias("goals"))
    nothing = F.lit(None).cast(steps.schema["node"].dataType), F.lit(None).cast(steps.schema["edge"].dataType)
    begin = pairs.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), nothing[0].alias("before"), nothing[1].alias("edge"), F.lit(0).alias("hops"), F.lit(True).alias("new")).distinct()
    rounds = Rounds(spark, "least-cost")
    known = rounds.put(begin)
    for _ in range(most_rounds):
        met = known.join(pairs.hint("merge"), (known["start"] == pairs["start"]) & (known["node"] == pairs["goal"])).groupBy(known["start"]).agg(F.count("*").alias("found"), F.max("cost").alias("dearest"))
        bound = F.when(F.col("found") == F.col("goals"), F.col("dearest")).otherwise(float("inf"))
        limits = goals.join(met.hint("merge"), "start", "left").select("start", bound.alias("bound"))
        front = known.where("new").join(limits.hint("merge"), "start").where(F.col("cost") < F.col("bound"))
        stepped = front.join(steps.withColumnsRenamed({"node": "from", "cost": "more", "edge": "by"}).hint("merge"), F.col("node") == F.col("from"))
        found = stepped.select("start", F.col("next").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.col("from").alias("before"), F.col("by").alias("edge"), (F.col("hops") + 1).alias("hops"))
        both = known.withColumn("old", F.lit(True)).unionByName(found.withColumns({"new": F.lit(True), "old": F.lit(False)}))
        way = F.struct("cost", "before", "edge", "hops")
        best = both.groupBy("start", "node").agg(F.min(F.when(~F.col("old"), way)).alias("found"), F.max(F.when(F.col("old"), way)).alias("kept"))
        nearer = F.col("kept").isNull() | (F.col("found.cost") < F.col("kept.cost"))  # to the last digit, or a dearer way could stay
        best = best.withColumn("new", F.coalesce(nearer & F.col("found").isNotNull(), F.lit(False))).withColumn("way", F.when(F.col("new"), F.col("found")).otherwise(F.col("kept")))
        known = rounds.put(best.select("start", "node", "way.*", "new").select("start", "node", "cost", "before", "edge", "hops", "new"))
        if known.where("new").isEmpty():
            return rounds.end(known.drop("new")), pairs
    raise RuntimeError(f"costs did not settle in {most_rounds} rounds")


def paths(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, pos, node, edge, cost) of least_cost(): the way of each pair in order, edge being the one that leads to the node; a
    goal that can't be reached has no rows.

    The way back is read by doubling: with the nodes 2^k steps before each node known, a goal's way is marked from the longest jumps to
    the shortest, in as many rounds as the longest way has binary digits."""
    jumps = [cut(reached.where("before is not null").select("start", "node", F.col("before").alias("back")))]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(cut(last.join(last.select("start", F.col("node").alias("back"), F.col("back").alias("further")).hint("merge"), ["start", "back"]).select("start", "node", F.col("further").alias("back"))))
    on = cut(pairs.join(reached.hint("merge"), (pairs["start"] == reached["start"]) & (pairs["goal"] == reached["node"])).select(pairs["start"], "goal", "node"))
    for jump in reversed(jumps[:-1]):
        on = cut(on.unionAll(on.join(jump.hint("merge"), ["start", "node"]).select("start", "goal", F.col("back").alias("node"))).distinct())
    told = on.join(reached.hint("merge"), ["start", "node"])
    pos = F.row_number().over(Window.partitionBy("start", "goal").orderBy("cost", "hops")) - 1
    return told.select("start", "goal", pos.cast("long").alias("pos"), "node", "edge", "cost")


def shortest_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, speeds: Mapping[str, float] = SPEEDS) -> DataFrame:
    """The fastest ways of pairs (start, goal) over drivable edges, as paths(); nodes that aren't in the graph have none."""
    known = nodes.select(F.col("node").alias("start"))
    real = pairs.join(known, "start", "left_semi").join(known.withColumnRenamed("start", "goal"), "goal", "left_semi")
    return paths(*least_cost(adjacency(nodes, edges, speeds), real))
