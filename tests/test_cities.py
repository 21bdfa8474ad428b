import math

import pytest

from loomgrid.kernel import plane
from loomgrid.kernel.city import City
from loomgrid.kernel.roads import VIRTUAL
from loomgrid.operators.cities import SCHEMAS, Cities, contact_sheet, poster

SWEEP = [
    {"seed": f"s{k}", "engine": "bsp" if k % 4 == 3 else "graph", "pattern": p, "land": land, "density": "low", "rail": rail, "massing": mass, "life": "low"}
    for k, (p, land, rail, mass) in enumerate(zip(["manhattan", "paris", "tokyo", "medieval", "atlanta"] * 4, ["flat", "river", "coast", "island"] * 5, ["none", "terminal", "metro", "elevated", "terminal"] * 4, ["mixed", "core", "euro", "lowrise", "industrial"] * 4))
]


@pytest.mark.parametrize("config", SWEEP, ids=lambda c: f"{c['engine']}-{c['pattern']}-{c['land']}-{c['rail']}-{c['seed']}")
def test_invariants(config):
    c = City(config)
    rings = lambda t, key="ring": [[(p["x"], p["z"]) for p in r[key]] for r in c.rows[t]]
    for ring in rings("buildings", "footprint"):
        assert c.on_land(ring, 0.0)
        assert c.off_reserve(ring) or config["engine"] == "bsp"
    for r in c.rows["parcels"]:
        if r["state"] == "built":
            assert r["front_length"] >= 4
    assert c.rows["buildings"] and c.rows["blocks"]
    assert City(config).rows == c.rows
    if config["engine"] == "bsp":
        return
    s = c.sheet
    live = s.live()
    reach, todo = set(), [s.edges[live[0]].a]
    while todo:
        n = todo.pop()
        if n not in reach:
            reach.add(n)
            todo += [m for k in s.at[n] if not s.edges[k].removed and s.edges[k].cls not in VIRTUAL for m in (s.edges[k].a, s.edges[k].b)]
    assert all(s.edges[k].a in reach for k in live)
    for i, k in enumerate(live):
        p, q = s.ends(k)
        e = s.edges[k]
        if not e.bridge:
            assert c.fields.water(*p) >= -0.5 and c.fields.water(*q) >= -0.5
        for f in s.edges_near(p, q, 0.0):
            o = s.edges[f]
            if f > k and not {o.a, o.b} & {e.a, e.b} and o.cls not in VIRTUAL:
                hit = plane.cross_at(p, q, *s.ends(f), tol=-1e-6)
                assert hit is None
    chained = [k for r in c.rows["corridors"] for k in r["edge_ids"]]
    assert len(chained) == len(set(chained)) and len(chained) + sum(r["orphan"] for r in c.rows["corridors"]) == len(live)
    assert len({r["name"] for r in c.rows["corridors"]}) == len(c.rows["corridors"])
    for r in c.rows["routes"]:
        assert r["origin"] != r["goal"] and all(k in set(live) for k in r["edge_ids"])
    used = sum(len(r["edge_ids"]) for r in c.rows["routes"])
    assert used == sum(e.get("traffic", 0) for e in c.rows["edges"])
    for r in c.rows["walk"]:
        assert r["distance"] <= 300 + 1e-9


def test_few_landlocked():
    lots = [r for k in range(6) for r in City({"seed": f"x{k}", "density": "low", "pattern": ["manhattan", "tokyo"][k % 2]}).rows["parcels"]]
    assert sum(r["landlocked"] for r in lots) < 0.05 * len(lots)


def test_plane():
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]
    parts = plane.convex_parts(ell)
    assert len(parts) == 2 and math.isclose(sum(map(plane.area, parts)), 12.0)
    assert plane.inset([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [1, 2, 3, 4]) and math.isclose(plane.area(plane.inset([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [1, 2, 3, 4])), 4 * 6)


def test_tables(spark):
    configs = spark.createDataFrame([("a", "s1", "graph", "low", "terminal"), ("b", "s2", "bsp", "low", "none"), ("c", "s3", "graph", "none such", "none")], "city_id string, seed string, engine string, density string, rail string")
    one, two = Cities(configs, 1), Cities(configs, 3)
    order = lambda c: sorted(map(tuple, c.rows.collect()))
    assert order(one) == order(two)
    assert [r.city_id for r in one.faults().collect()] == ["c"]
    for name in SCHEMAS:
        one.table(name).collect()
    assert one.table("nodes").where("city_id = 'a'").count() > 100
    sheet = {r.city_id: r for r in contact_sheet(one).collect()}
    assert sheet["a"].blocks > 10 and sheet["b"].buildings > 10
    assert {r.panel for r in poster(one).collect()} == {"streets", "traffic"}


def _pt(*points):
    return [{"x": float(x), "z": float(z)} for x, z in points]


def _imported(source="geographic", rail="none"):
    lines = [{"src": k, "cls": "collector", "width": 13.0, "level": 0.0, "pts": _pt((a, -300), (a, 300)) if k % 2 else _pt((-300, a), (300, a))} for k, a in enumerate([-150, -150, -50, -50, 50, 50, 150, 150])]
    lines += [{"src": 20, "cls": "local", "width": 9.0, "level": 1.0, "bridge": True, "pts": _pt((-300, 0), (300, 0))}, {"src": 21, "cls": "local", "width": 9.0, "level": 0.0, "pts": _pt((0, -20), (0, 20))}]
    ring = lambda x, z, d: _pt((x, z), (x + d, z), (x + d, z + d), (x, z + d))
    polygons = [{"src": 30, "kind": "water", "ring": ring(-20, -20, 40), "holes": []}, {"src": 31, "kind": "building", "ring": ring(70, 70, 20), "holes": [ring(75, 75, 5)], "height": 20.0}, {"src": 32, "kind": "building", "ring": ring(10, 10, 20), "holes": []}, {"src": 33, "kind": "park", "ring": ring(-140, 60, 80), "holes": []}]
    return City({"seed": "g", "source": source, "lines": lines, "polygons": polygons, "rail": rail, "density": "low"})


def test_imported_city():
    c = _imported()
    assert sorted((r["src"], r["code"]) for r in c.rows["diagnostics"]) == [(21, "road-in-water"), (32, "imported-building-water")]
    assert len(c.rows["overpasses"]) == 1 and c.stats["components"] == 1
    given = [b for b in c.rows["buildings"] if b["style"] == "imported"]
    assert len(given) == 1 and given[0]["h"] == 20.0 and given[0]["courtyard"]
    claims = [[(70.0, 70.0), (90.0, 70.0), (90.0, 90.0), (70.0, 90.0)], [(-140.0, 60.0), (-60.0, 60.0), (-60.0, 140.0), (-140.0, 140.0)]]
    from loomgrid.kernel.city import overlap

    for b in c.rows["buildings"]:
        ring = [(p["x"], p["z"]) for p in b["footprint"]]
        assert b["style"] == "imported" or not any(overlap(ring, k) for k in claims)
        assert c.on_land(ring, 0.0)
    assert "imported-building-reserved" in {r["code"] for r in _imported("hybrid", "terminal").rows["diagnostics"]}
    with pytest.raises(ValueError):
        City({"seed": "x", "density": "none such"})


def test_lots():
    from loomgrid.kernel.lots import fold, shared_length, union

    a, b, far = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(2.0, 1.0), (5.0, 1.0), (5.0, 4.0), (2.0, 4.0)], [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]
    assert shared_length(a, b) == 1.0 and math.isclose(plane.area(union(a, b)), 13.0)
    assert union(a, far) is None and union(a, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]) is None
    row = [[(float(k), 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0), (float(k), 1.0)] for k in range(4)]
    front = lambda r: (1.0, 0.0) if any(x == 0.0 for x, _ in r) else None
    merged = fold(row + [far], front)
    assert [f for _, f in merged] == [(1.0, 0.0), None] and math.isclose(plane.area(merged[0][0]), 4.0)


def test_thin_shores():
    from loomgrid.functions.rings import circle
    from loomgrid.kernel.shores import over_land, thin

    ring = circle(200.0, 200.0, 500)
    lake = lambda x, z: math.hypot(x, z) - 200.0  # noqa: E731  land outside
    (points, closed), = thin(ring, True, lake)
    assert closed and len(points) <= 24 and not any(over_land(p, q, lake) for p, q in zip(points, points[1:] + points[:1]))
    island = lambda x, z: 200.0 - math.hypot(x, z)  # noqa: E731  land inside: chords would cut it
    pieces = thin(ring, True, island)
    assert all(not over_land(p, q, island) for pts, _ in pieces for p, q in zip(pts, pts[1:])) and sum(len(p) for p, _ in pieces) <= 48
    line = [(float(k), 0.0) for k in range(100)]
    assert thin(line, False, lambda x, z: -1.0)[0][1] is False and thin(line[:5], False, lake) == [(line[:5], False)]
