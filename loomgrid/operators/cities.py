"""Cities as tables: every config is generated in one task, and the city's lists become one table each, keyed by city_id."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.shared import cut

RING = "array<struct<x:double,z:double>>"
#: Columns of every table of a city.
SCHEMAS = {
    "water": "kind string, x double, z double, w double, d double",
    "rail": "kind string, upright boolean, offset double, raised boolean, `from` double, `to` double, crossing string",
    "station": "x double, z double, w double, d double",
    "centers": "x double, z double, sigma double, w double",
    "nodes": "node int, x double, z double",
    "edges": "edge int, a int, b int, cls string, width double, bridge boolean, road int, removed boolean, traffic int",
    "roads": "x double, z double, w double, d double, type string, level int, bridge boolean",
    "corridors": "corridor int, cls string, name string, length double, edge_ids array<int>, node_ids array<int>, orphan int, traffic int",
    "blocks": f"block int, face int, ring {RING}, cx double, cz double, pop double, dist double, area double, zone string, field boolean, landmark boolean, buildable double, n_pieces int",
    "parcels": f"parcel int, block int, ring {RING}, area double, front_angle double, front_length double, landlocked boolean, state string",
    "buildings": f"block int, cx double, cz double, w double, d double, h double, y double, angle double, zone string, style string, footprint {RING}, courtyard {RING}",
    "parks": f"block int, kind string, ring {RING}",
    "plazas": f"block int, ring {RING}",
    "landmarks": "x double, z double, w double, d double, h double, angle double",
    "trees": "x double, z double, s double",
    "routes": "route int, origin int, goal int, start int, edge_ids array<int>, length double",
    "walk": "node int, distance double",
    "cranes": "x double, z double, h double, jib double, dir string",
    "cars": "car int, edge_ids array<int>, start int, length double, t double, speed double, s double, x double, z double",
    "drones": "x double, z double, y double, s double",
    "overpasses": "src int, cls string, width double, level double, ax double, az double, bx double, bz double",
    "diagnostics": "src int, code string",
    "stats": "edges double, nodes double, faces double, spurs double, proposals double, rejected double, rejected_grade double, rejected_water double, bridges double, components double, disconnected double, queued double, offset_drops double, landlocked double, slivers double, n_blocks double, n_parcels double, n_buildings double, n_parks double, n_trees double, n_cars double",
}


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, list]]]:
    """The cities of each batch of configs, with the rows of all their tables."""
    from loomgrid.kernel.city import City

    for batch in batches:
        names = batch.schema.names
        for n in range(batch.num_rows):  # one at a time: a config may hold a city's whole import
            config = batch.slice(n, 1).to_pylist()[0]
            try:
                rows = City({k: config[k] for k in names if k != "city_id"}).rows
            except (KeyError, ValueError) as e:  # a config that can't be built is a row of its own
                rows = {"faults": [{"message": f"{type(e).__name__}: {e}"}]}
            yield str(config["city_id"]), rows


def _generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for city, rows in _built(batches):
        tables = [(t, n, json.dumps(r)) for t, own in rows.items() for n, r in enumerate(own)]
        columns = list(zip(*tables, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array([city] * len(tables)), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["city_id", "name", "pos", "row"])


class Cities:
    """The tables of the cities of configs (city_id, seed and any of the kernel's settings); generated once, on first use."""

    def __init__(self, configs: DataFrame, partitions: int | None = None):
        spread = configs.repartition(partitions, "city_id") if partitions else configs.repartition("city_id")
        self.rows = cut(spread.mapInArrow(_generate, "city_id string, name string, pos int, row string"))

    def table(self, name: str) -> DataFrame:
        told = self.rows.where(F.col("name") == name).select("city_id", "pos", F.from_json("row", SCHEMAS[name]).alias("r"))
        return told.select("city_id", "pos", "r.*")

    def faults(self) -> DataFrame:
        return self.rows.where("name = 'faults'").select("city_id", F.get_json_object("row", "$.message").alias("message"))


def sizes(configs: DataFrame, tables: Sequence[str], partitions: int) -> DataFrame:
    """(city_id, a column a table): how many rows the named tables of the cities of configs have. Cities are built as by Cities, but no
    row leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for city, rows in _built(batches):
            if any(rows.values()):
                yield pa.RecordBatch.from_pylist([{"city_id": city} | {t: len(rows.get(t, ())) for t in tables}], pa.schema([("city_id", pa.string()), *((t, pa.int64()) for t in tables)]))

    return configs.repartition(partitions, "city_id").mapInArrow(count, ", ".join(["city_id string", *(f"{t} long" for t in tables)]))


def geographic_configs(configs: DataFrame, lines: DataFrame, land: DataFrame) -> DataFrame:
    """Configs (city_id, seed, ...) of imported cities. lines: city_id, src, pts and road metadata; land: city_id and the rows of
    classify_polygons. A city's records fit in its task, as its viewport bounds them."""
    roads = lines.where("pts is not null").groupBy("city_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), "part", "cls", "width", "level", "bridge", "tunnel", "pts"))).alias("lines"))
    areas = land.groupBy("city_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), "part", "kind", "ring", "holes", "height"))).alias("polygons"))
    told = configs.join(roads, "city_id", "left").join(areas, "city_id", "left")
    return told.withColumn("source", F.coalesce("source", F.lit("geographic")) if "source" in configs.columns else F.lit("geographic"))


def layer_features(cities: Cities) -> DataFrame:
    """(city_id, layer, features): what each map layer would draw."""
    layers = {"water": "water", "parks": "parks", "plazas": "plazas", "blocks": "blocks", "parcels": "parcels", "buildings": "buildings", "landmarks": "landmarks", "trees": "trees", "cars": "cars", "drones": "drones", "rail": "rail", "cranes": "cranes", "corridors": "corridors", "walk": "walkshed"}
    known = F.create_map(*(F.lit(x) for pair in layers.items() for x in pair))
    return cities.rows.where(F.col("name").isin(*layers)).groupBy("city_id", known[F.col("name")].alias("layer")).agg(F.count("*").alias("features"))


def contact_sheet(cities: Cities) -> DataFrame:
    """Blocks, buildings and landlocked parcels of each city."""
    n = lambda t, c=None: F.count_if((F.col("name") == t) if c is None else (F.col("name") == t) & c)
    return cities.rows.groupBy("city_id").agg(n("blocks").alias("blocks"), n("buildings").alias("buildings"), n("parcels", F.get_json_object("row", "$.landlocked") == "true").alias("landlocked"))


def poster(cities: Cities, streets: int = 6, busy: int = 3) -> DataFrame:
    """(city_id, panel, place, name, value): the longest streets and the busiest ones of each city."""
    from pyspark.sql import Window

    c = cities.table("corridors")
    by = lambda column: F.row_number().over(Window.partitionBy("city_id").orderBy(F.desc(column), "pos"))
    long = c.withColumn("place", by("length")).where(F.col("place") <= streets).select("city_id", F.lit("streets").alias("panel"), "place", "name", F.col("length").alias("value"))
    used = c.withColumn("place", by("traffic")).where(F.col("place") <= busy).select("city_id", F.lit("traffic").alias("panel"), "place", "name", F.col("traffic").cast("double").alias("value"))
    return long.unionAll(used)


def building_colours(buildings: DataFrame, palette: int = 6) -> DataFrame:
    """(city_id, colour, buildings): the bucket of a hash of zone, style and place."""
    from loomgrid.functions.randoms import hash_text

    return buildings.groupBy("city_id", (hash_text(F.concat("zone", "style", F.col("pos").cast("string"))) % palette).alias("colour")).agg(F.count("*").alias("buildings"))
