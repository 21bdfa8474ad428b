import json

import pytest
from pyspark.sql import functions as F

from loomgrid.functions.projection import Projection
from loomgrid.functions.tags import flag, number, polygon_class, road_metadata
from loomgrid.sources import provider
from loomgrid.sources.geojson import normalize, osm_features, read_features

P = Projection(0.0, 0.0)


def feature(kind, coordinates, **more):
    return {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": kind, "coordinates": coordinates}} | more


RING = [[0, 0], [1, 0], [1, 1], [0, 0]]
GOOD = [feature("LineString", [[0, 0], [1, 1, 99]], id=0), feature("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], id=""), feature("Polygon", [RING, RING], id="p"), feature("MultiPolygon", [[RING], [RING]], properties=None)]
BAD = [
    ("entry", "invalid-feature"), ({"type": "Other"}, "invalid-feature"), ({"type": "Feature", "geometry": None}, "missing-geometry"), (feature("Point", [0, 0]), "unsupported-geometry"), (feature("LineString", []), "empty-geometry"),
    (feature("LineString", [[0, 0]]), "invalid-coordinate"), (feature("Polygon", [RING[:3]]), "invalid-coordinate"), (feature("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 1]]]), "invalid-coordinate"), (feature("LineString", [[0, 0], [0, 91]]), "invalid-coordinate"),
    (feature("LineString", "none"), "invalid-coordinate"), (feature("MultiPolygon", [[]]), "empty-geometry"), (feature("LineString", [[0], [1, 1]]), "invalid-coordinate"),
]


def test_good_and_bad_rows(spark):
    both = GOOD + [b for b, _ in BAD]
    text = json.dumps({"type": "FeatureCollection", "features": both})
    records, diagnostics = normalize(read_features(spark.createDataFrame([(text,)], "value string")), P)
    got = {r.idx: r for r in records.collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0].source_id, got[0].id_kind, got[1].source_id, got[1].id_kind, got[3].source_id) == ("0", "number", "", "string", None)
    assert len(got[1].parts) == 2 and len(got[2].polygons[0]) == 2 and got[3].tags == {} and got[0].tags == {"a": "1"}
    assert [(r.idx, r.code) for r in diagnostics.orderBy("idx").collect()] == [(k + 4, c) for k, (_, c) in enumerate(BAD)]


def test_single_feature_and_misuse(spark):
    one = spark.createDataFrame([(json.dumps(GOOD[0]),)], "value string")
    assert normalize(read_features(one), P)[0].count() == 1
    for text in ("[]", "no json", '{"type":"Topology"}'):
        with pytest.raises(Exception, match="no Feature"):
            read_features(spark.createDataFrame([(text,)], "value string")).collect()


def way(tags, pts, ident=1):
    return {"type": "way", "id": ident, "tags": tags, "geometry": [{"lon": x, "lat": z} for x, z in pts]}


def test_osm(spark):
    tri = [(0, 0), (0.1, 0), (0.1, 0.1)]
    elements = [way({"highway": "primary", "building": "yes"}, tri), way({"natural": "water"}, tri[:2]), way({"water": "no", "landuse": "salt_pond"}, tri), {"type": "node"}, way({"highway": "x"}, [(0, "n"), (1, 1)]), way({"natural": "wood"}, tri), way({"highway": "no"}, tri)]
    found = osm_features(spark.createDataFrame([(json.dumps({"elements": elements}),)], "value string"))
    records, diagnostics = normalize(found, P)
    got = [(r.geom_type, r.tags.get("kind")) for r in records.orderBy("idx").collect()]
    assert got == [("line", None), ("polygon", "building"), ("polygon", None)] and diagnostics.count() == 0


def test_tags(spark):
    t = lambda **k: F.create_map(*(F.lit(x) for p in k.items() for x in p)) if k else F.create_map().cast("map<string,string>")
    row = spark.range(1).select(
        polygon_class(t(building="no", natural="lake")).alias("a"), polygon_class(t()).alias("b"), polygon_class(t(landuse="salt_pond")).alias("c"), polygon_class(t(kind="park", water="yes")).alias("d"),
        number(F.lit(" 12.5 m ")).alias("n"), number(F.lit("12d")).alias("x"), flag(F.lit("viaduct")).alias("f"),
        road_metadata(t(highway="trunk", width="x", lanes="2", bridge="yes", layer="3")).alias("m"), road_metadata(t(**{"class": "Collector", "width": "7"})).alias("k"), road_metadata(t(tunnel="true")).alias("u"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.n, row.x, tuple(row.f)) == ("water", "water", "park", "park", 12.5, None, (False, False))
    assert (row.m.cls, row.m.width, row.m.level, row.m.faults, row.m.face_eligible) == ("arterial", 7.0, 3.0, ["invalid-width"], False)
    assert (row.k.cls, row.k.width, row.k.face_eligible, row.u.level) == ("collector", 7.0, True, -1.0)


def test_provider_arguments():
    assert provider.coordinates(" 13.4 ; 52.5 ") == (13.4, 52.5) and provider.coordinates("Berlin") is None
    for bad in ("", "200, 0", (1, 2, 3), None):
        with pytest.raises(provider.ProviderError) as e:
            provider.coordinates(bad)
        assert e.value.code == "invalid-location"
    with pytest.raises(provider.ProviderError):
        provider.crop_radius(10)
    q = provider.overpass_query("13.4,52.5", 100)
    assert "(around:100,52.5,13.4)" in q and q.count("way(") == 7
    assert provider.geocoding_url("https://g/{query}", "a b", "t") == "https://g/a%20b?limit=1&access_token=t"


@pytest.mark.parametrize(("status", "code"), [(401, "missing-token"), (403, "missing-token"), (429, "rate-limit"), (500, "http")])
def test_provider_failures(status, code):
    with pytest.raises(provider.ProviderError) as e:
        provider.request_json(lambda *_: (status, ""), "u", None, "s")
    assert e.value.code == code


def fake_fetch(url, body):
    if "geo" in url:
        return 200, json.dumps({"features": [{"center": [1.0, 2.0], "place_name": "Town"}]})
    return 200, json.dumps({"elements": [way({"highway": "primary"}, [(0, 0), (0.1, 0.1)])]})


class FakeProvider(provider.ProviderSource):
    fetch = staticmethod(fake_fetch)


def test_provider_source(spark):
    assert provider.resolve("Town", "https://geo", "t", fake_fetch)["label"] == "Town"
    with pytest.raises(provider.ProviderError):
        provider.resolve("Town", "https://geo", "", fake_fetch)
    spark.dataSource.register(FakeProvider)
    got = spark.read.format("map_provider").option("locations", "0,0|0.05,0.05").option("endpoint", "https://x").option("radius", 300).load()
    assert normalize(osm_features(got.select("value")), P)[0].count() == 2
