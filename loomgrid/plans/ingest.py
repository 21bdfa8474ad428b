"""Queries that read GeoJSON and map-provider texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.projection import Projection
from loomgrid.operators.land import classify_polygons
from loomgrid.plans import tables as t
from loomgrid.plans.queries import query
from loomgrid.sources.geojson import lines_of, normalize, osm_features, read_features

#: What is wrong with a part's feature, by its key modulo ten; three of ten are good.
CASES = {
    0: ("LineString", "[[{x},{z}],[{x1},{z}]]"),
    1: ("Polygon", "[[[{x},{z}],[{x1},{z}],[{x1},{z1}],[{x},{z}]]]"),
    2: ("MultiLineString", "[[[{x},{z}],[{x1},{z1}]],[[{x},{z1}],[{x1},{z}],[{x},{z}]]]"),
    3: ("Point", "[{x},{z}]"),
    4: ("LineString", "[]"),
    5: ("Polygon", "[[[{x},{z}],[{x1},{z}],[{x1},{z1}],[{x},{z1}]]]"),
    6: ("LineString", "[[{x},{z}]]"),
    7: ("LineString", "[[{x},{z}],[181,{z}]]"),
    8: (None, ""),
    9: ("Polygon", "[[[{x},{z}],[{x1},{z}],[{x},{z}]]]"),
}
CODES = {3: "unsupported-geometry", 4: "empty-geometry", 5: "invalid-coordinate", 6: "invalid-coordinate", 7: "invalid-coordinate", 8: "missing-geometry", 9: "invalid-coordinate"}


def _filled(pattern: str, **values: Column) -> Column:
    parts, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: one GeoJSON Feature a part; doc is its key."""
    k = F.col("p_partkey")
    x, z = (k % 100) / 100.0, (k * 7 % 100) / 100.0
    values = {"x": x, "z": z, "x1": x + 0.25, "z1": z + 0.5}
    geometry = F.coalesce(*(F.when(k % 10 == n, F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), _filled(shape, **values), F.lit("}")) if kind else F.lit("null")) for n, (kind, shape) in CASES.items()))
    ident = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit('"p'), k.cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"type":"Feature","id":'), ident, F.lit(',"properties":{"name":"'), F.col("p_name"), F.lit('","height":'), F.col("p_size").cast("string"), F.lit('},"geometry":'), geometry, F.lit("}"))
    return t.read(spark, sf_dir, "part").select(k.alias("doc"), text.alias("value"))


def _normalized(spark: SparkSession, sf_dir: str):
    return normalize(read_features(part_features(spark, sf_dir)), Projection(0.0, 0.0))


IDENT = "CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN 'p' || p_partkey END"


@query(f"SELECT p_partkey AS doc, {IDENT} AS source_id, CASE p_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' END AS id_kind, CASE WHEN p_partkey % 10 = 1 THEN 'polygon' ELSE 'line' END AS geom_type, CASE p_partkey % 10 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS n_points, p_size::VARCHAR AS height FROM part WHERE p_partkey % 10 < 3")
def geojson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of good features (SRC-1, SRC-2, FLT-3, FLT-4)."""
    records, _ = _normalized(spark, sf_dir)
    lines, rings = F.size(F.flatten("parts")), F.size(F.flatten(F.flatten("polygons")))
    return records.select("doc", "source_id", "id_kind", "geom_type", F.when(F.col("geom_type") == "line", lines).otherwise(rings).alias("n_points"), F.element_at("tags", "height").alias("height"))


@query("SELECT p_partkey AS doc, " + IDENT + " AS source_id, CASE p_partkey % 10 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in CODES.items()) + " END AS code, CASE p_partkey % 10 " + " ".join(f"WHEN {n} THEN '{k}'" for n, (k, _) in CASES.items() if k) + " END AS geometry_type FROM part WHERE p_partkey % 10 >= 3")
def geojson_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagnostic a bad feature (FLT-1, FLT-2)."""
    return _normalized(spark, sf_dir)[1].select("doc", "source_id", "code", "geometry_type")


WAY_TAGS = {0: '{"highway":"primary"}', 1: '{"building":"yes"}', 2: '{"natural":"water"}', 3: '{"leisure":"park"}', 4: '{"highway":"service","building":"yes"}', 5: '{"building":"no","landuse":"salt_pond"}', 6: '{"natural":"wood"}'}


@query(
    """
WITH w AS (SELECT s_suppkey AS k, s_suppkey % 7 AS c, s_suppkey % 2 = 0 AS three FROM supplier WHERE s_suppkey % 13 <> 0)
SELECT k::BIGINT AS doc, 'LineString' AS geometry_type, NULL AS kind, CASE WHEN three THEN 3 ELSE 2 END AS n_points FROM w WHERE c IN (0, 4)
UNION ALL SELECT k::BIGINT, 'Polygon', CASE WHEN c IN (1, 4) THEN 'building' END, 4 FROM w WHERE three AND c IN (1, 2, 3, 4, 5)"""
)
def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of map-provider ways: a line, a polygon, or both (SRC-3, FLT-10)."""
    k = F.col("s_suppkey")
    tags = F.coalesce(*(F.when(k % 7 == n, F.lit(v)) for n, v in WAY_TAGS.items()))
    x, z = (k % 50) / 100.0, (k % 30) / 100.0
    at = lambda dx, dz: F.concat(F.lit('{"lon":'), (x + dx).cast("string"), F.lit(',"lat":'), F.when(k % 13 == 0, F.lit('"none"')).otherwise((z + dz).cast("string")), F.lit("}"))
    points = F.when(k % 2 == 0, F.concat_ws(",", at(0, 0), at(0.1, 0), at(0.1, 0.1))).otherwise(F.concat_ws(",", at(0, 0), at(0.1, 0)))
    text = F.concat(F.lit('{"elements":[{"type":"node","id":1},{"type":"way","id":'), k.cast("string"), F.lit(',"tags":'), tags, F.lit(',"geometry":['), points, F.lit("]}]}"))
    found = osm_features(t.read(spark, sf_dir, "supplier").select(k.cast("long").alias("doc"), text.alias("value")))
    records, _ = normalize(found, Projection(0.0, 0.0))
    rings, lines = F.size(F.flatten(F.flatten("polygons"))), F.size(F.flatten("parts"))
    line = F.col("geom_type") == "line"
    return records.select("doc", F.when(line, "LineString").otherwise("Polygon").alias("geometry_type"), F.element_at("tags", "kind").alias("kind"), F.when(line, lines).otherwise(rings).alias("n_points"))


@query("SELECT p_partkey AS doc, 0 AS part, 'water' AS kind, 3 AS n_points, NULL::DOUBLE AS height FROM part WHERE p_partkey % 10 = 1")
def land_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water, buildings and parks of polygon records, and the faults of their rings (FLT-8, FLT-9)."""
    records, _ = _normalized(spark, sf_dir)
    land, faults = classify_polygons(records)
    return land.select("doc", "part", "kind", F.size("ring").alias("n_points"), "height").unionByName(faults.select("doc", "part", F.concat(F.lit("fault:"), "code").alias("kind")), allowMissingColumns=True)


@query("SELECT p_partkey AS doc, part, n FROM (SELECT p_partkey, 0 AS part, 2 AS n FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 0, 2 FROM part WHERE p_partkey % 10 = 2 UNION ALL SELECT p_partkey, 1, 3 FROM part WHERE p_partkey % 10 = 2)")
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of line records, ready for the import of roads."""
    records, _ = _normalized(spark, sf_dir)
    parts = lines_of(records.where("geom_type = 'line'").withColumn("idx", F.col("doc")))
    return parts.select(F.col("src").alias("doc"), "part", F.size("pts").alias("n"))
