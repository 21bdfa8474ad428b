"""GeoJSON and map-provider JSON to records and row-level diagnostics, in DataFrame operations throughout.

A good feature gives one record, any other exactly one diagnostic; nothing a feature holds makes a job fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.projection import Projection
from loomgrid.functions.scalars import finite
from loomgrid.functions.tags import active, provider_class, tag

TYPES = ("LineString", "MultiLineString", "Polygon", "MultiPolygon")
INVALID, MISSING, UNSUPPORTED, EMPTY, COORDINATE = "invalid-feature", "missing-geometry", "unsupported-geometry", "empty-geometry", "invalid-coordinate"
POINTS = "array<struct<x:double,z:double>>"


def read_features(texts: DataFrame, text: str = "value") -> DataFrame:
    """(doc, idx, feature) of the features of whole GeoJSON texts; a Feature is a collection of one. Raises on other input
    when the result is used."""
    v = F.try_parse_json(F.col(text))
    kind = F.try_variant_get(v, "$.type", "string")
    many = F.try_variant_get(v, "$.features", "array<variant>")
    none = F.raise_error(F.concat(F.lit("no Feature or FeatureCollection: "), F.substring(F.coalesce(F.col(text), F.lit("null")), 1, 60))).cast("array<variant>")
    features = F.when((kind == "FeatureCollection") & many.isNotNull(), many).when(kind == "Feature", F.array(v)).otherwise(none)
    doc = F.col("doc") if "doc" in texts.columns else F.lit(0).cast("long").alias("doc")
    return texts.select(doc, F.posexplode(features).alias("idx", "feature"))


def _ring_fault(ring: Column) -> Column:
    n = F.size(ring)
    first, last = F.element_at(ring, 1), F.try_element_at(ring, F.lit(-1))
    open_ = ~(F.try_element_at(first, F.lit(1)).eqNullSafe(F.try_element_at(last, F.lit(1))) & F.try_element_at(first, F.lit(2)).eqNullSafe(F.try_element_at(last, F.lit(2))))
    return F.when(ring.isNull(), COORDINATE).when(n == 0, EMPTY).when(n < 4, COORDINATE).when(open_, COORDINATE)


def _line_fault(line: Column) -> Column:
    return F.when(line.isNull(), COORDINATE).when(F.size(line) == 0, EMPTY).when(F.size(line) < 2, COORDINATE)


def _first(items: Column, fault) -> Column:
    """The first fault of a list; an unreadable list is one itself, as is an empty one."""
    found = F.filter(F.transform(items, fault), lambda f: f.isNotNull())
    return F.when(items.isNull(), COORDINATE).when(F.size(items) == 0, EMPTY).when(F.size(found) > 0, F.element_at(found, 1))


def normalize(features: DataFrame, projection: Projection) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of features (doc, idx, feature variant). Records: doc, idx, source_id, id_kind, tags, geom_type,
    parts (lines), polygons (rings of points). The first fault of a feature, in the order of the checks, is its code."""
    get = lambda path, kind: F.try_variant_get("feature", path, kind)
    told = features.select(
        "doc", "idx",
        F.schema_of_variant("feature").alias("shape"),
        get("$.type", "string").alias("ftype"),
        get("$.id", "string").alias("raw_id"),
        F.schema_of_variant(get("$.id", "variant")).alias("id_shape"),
        get("$.properties", "map<string,variant>").alias("props"),
        F.schema_of_variant(get("$.geometry", "variant")).alias("gshape"),
        get("$.geometry.type", "string").alias("gtype"),
        get("$.geometry.coordinates", "array<array<double>>").alias("c1"),
        get("$.geometry.coordinates", "array<array<array<double>>>").alias("c2"),
        get("$.geometry.coordinates", "array<array<array<array<double>>>>").alias("c3"),
    )
    kind = F.when(F.col("id_shape") == "STRING", "string").when(F.col("id_shape").rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|SMALLINT|TINYINT)"), "number")
    told = told.withColumn("id_kind", kind).withColumn("source_id", F.when(F.col("id_kind").isNotNull(), F.col("raw_id")))
    # every geometry as lines or polygons of positions
    lines = F.when(F.col("gtype") == "LineString", F.when(F.col("c1").isNotNull(), F.array("c1"))).when(F.col("gtype") == "MultiLineString", F.col("c2"))
    polygons = F.when(F.col("gtype") == "Polygon", F.when(F.col("c2").isNotNull(), F.array("c2"))).when(F.col("gtype") == "MultiPolygon", F.col("c3"))
    told = told.withColumn("lines", lines).withColumn("polys", polygons)
    is_line = F.col("gtype").isin("LineString", "MultiLineString")
    shape_fault = F.when(is_line, _first(F.col("lines"), _line_fault)).otherwise(_first(F.col("polys"), lambda p: _first(p, _ring_fault)))
    project = lambda p: F.when((F.size(p) >= 2) & finite(F.try_element_at(p, F.lit(1))) & finite(F.try_element_at(p, F.lit(2))), projection.forward(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))))
    told = told.withColumn("parts", F.transform("lines", lambda part: F.transform(part, project))).withColumn("polygons", F.transform("polys", lambda poly: F.transform(poly, lambda ring: F.transform(ring, project))))
    missing = F.when(is_line, F.exists(F.flatten("parts"), lambda p: p.isNull())).otherwise(F.exists(F.flatten(F.flatten("polygons")), lambda p: p.isNull()))
    code = F.coalesce(
        F.when(~F.col("shape").startswith("OBJECT") | F.col("ftype").isNull() | (F.col("ftype") != "Feature"), INVALID),
        F.when(F.col("gshape").isNull() | ~F.col("gshape").startswith("OBJECT"), MISSING),
        F.when(F.col("gtype").isNull() | ~F.col("gtype").isin(*TYPES), UNSUPPORTED),
        shape_fault,
        F.when(F.coalesce(missing, F.lit(True)), COORDINATE),
    )
    told = told.withColumn("code", code)
    tags = F.transform_values("props", lambda _, v: v.cast("string"))
    records = told.where("code is null").select("doc", "idx", "source_id", "id_kind", F.coalesce(tags, F.create_map().cast("map<string,string>")).alias("tags"), F.when(is_line, "line").otherwise("polygon").alias("geom_type"), F.when(is_line, F.col("parts")).alias("parts"), F.when(~is_line, F.col("polygons")).alias("polygons"))
    says = {INVALID: "entry is no Feature object", MISSING: "feature has no geometry object", UNSUPPORTED: "geometry type is not supported", EMPTY: "coordinates are empty", COORDINATE: "coordinates can't be read or projected"}
    message = F.coalesce(*(F.when(F.col("code") == c, F.lit(m)) for c, m in says.items()))
    diagnostics = told.where("code is not null").select("doc", "idx", "source_id", F.col("gtype").alias("geometry_type"), "code", message.alias("message"))
    return records, diagnostics


def lines_of(records: DataFrame) -> DataFrame:
    """(src, source_id, part, pts, tags): one row a part of a line record; other records keep one row without points."""
    return records.select(F.col("idx").cast("long").alias("src"), "source_id", "tags", F.posexplode_outer("parts").alias("part", "pts"))


def osm_features(payload: DataFrame, text: str = "value") -> DataFrame:
    """(doc, idx, feature) of the ways of a map provider's JSON. A way gives a line if it is a highway, and a polygon if it closes
    and is a building, water or a park, in this order; ways with unreadable points give nothing."""
    v = F.try_parse_json(F.col(text))
    doc = F.col("doc") if "doc" in payload.columns else F.lit(0).cast("long").alias("doc")
    ways = payload.select(doc, F.posexplode(F.try_variant_get(v, "$.elements", "array<variant>")).alias("el", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    told = ways.where(get("$.type", "string") == "way").select("doc", "el", get("$.id", "variant").alias("id"), F.coalesce(get("$.tags", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("tags"), get("$.geometry", "array<struct<lon:double,lat:double>>").alias("g"))
    ok = (F.size("g") >= 2) & F.forall("g", lambda p: p.isNotNull() & finite(p["lon"]) & finite(p["lat"]))
    told = told.where(F.coalesce(ok, F.lit(False))).withColumn("pts", F.transform("g", lambda p: F.array(p["lon"], p["lat"])))
    n = F.size("pts")
    closed = F.element_at("pts", 1) == F.element_at("pts", -1)
    ring = F.when(closed, F.col("pts")).otherwise(F.concat("pts", F.slice("pts", 1, 1)))
    told = told.withColumn("ring", F.when((n >= 3) & (F.size(ring) >= 4), ring)).withColumn("cls", provider_class(F.col("tags")))
    none = F.lit(None).cast("struct<kind:string,order:int>")
    shapes = F.array(F.when(active(tag(F.col("tags"), "highway")), F.struct(F.lit("LineString").alias("kind"), F.lit(0).alias("order"))).otherwise(none), F.when(F.col("ring").isNotNull() & F.col("cls").isNotNull(), F.struct(F.lit("Polygon").alias("kind"), F.lit(1).alias("order"))).otherwise(none))
    each = told.select("doc", "el", "id", "tags", "pts", "ring", "cls", F.explode(F.filter(shapes, lambda s: s.isNotNull())).alias("s"))
    props = F.when((F.col("s.kind") == "Polygon") & (F.col("cls") == "building"), F.map_concat(F.map_filter("tags", lambda k, _: k != "kind"), F.create_map(F.lit("kind"), F.lit("building")))).otherwise(F.col("tags"))
    coordinates = F.when(F.col("s.kind") == "LineString", F.to_json("pts")).otherwise(F.to_json(F.array("ring")))
    text_ = F.concat(F.lit('{"type":"Feature","id":'), F.coalesce(F.to_json("id"), F.lit("null")), F.lit(',"properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), F.col("s.kind"), F.lit('","coordinates":'), coordinates, F.lit("}}"))
    rows = each.select("doc", (F.col("el") * 2 + F.col("s.order")).alias("idx"), F.parse_json(text_).alias("feature"))
    return rows
