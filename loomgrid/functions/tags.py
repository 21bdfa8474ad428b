"""Reading of map tags: truth, numbers, road metadata and polygon classes. Tags are map<string,string> columns of JSON texts:
a string keeps its quotes away, numbers and booleans come as JSON writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions.randoms import hash_text

# Words that switch a tag off; the values that mean water or park; road classes by highway value and their widths.
DISABLED = ("", "0", "false", "no", "off")
WATER_NATURAL = ("water", "wetland")
MODEL_WATER = ("water", "reservoir", "basin", "pond", "lake", "river", "riverbank", "canal", "wetland", "marsh", "swimming_pool")
PROVIDER_WATER_LANDUSE = ("reservoir", "basin", "salt_pond")
PARK_LANDUSE = ("allotments", "cemetery", "churchyard", "forest", "garden", "grass", "meadow", "orchard", "park", "recreation_ground", "village_green", "wood")
PARK_LEISURE = ("garden", "golf_course", "park", "pitch", "recreation_ground")
ROAD_CLASSES = ("arterial", "collector", "local")
ARTERIAL = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
COLLECTOR = ("secondary", "secondary_link", "tertiary", "tertiary_link")
LOCAL = ("residential", "living_street", "service", "unclassified", "road", "track")
WIDTHS = {"arterial": 20.0, "collector": 13.0, "local": 9.0}
LANE_WIDTH = 3.5
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
WITH_UNIT = NUMBER + r"(\s*(m|metre|metres|meter|meters))?$"
CODES = {"class": "invalid-class", "width": "invalid-width", "lanes": "invalid-lanes", "bridge": "invalid-bridge", "tunnel": "invalid-tunnel", "level": "invalid-level"}


def tag(tags: Column, name: str) -> Column:
    return F.element_at(tags, name)


def _word(v: Column) -> Column:
    return F.lower(F.trim(v))


def active(v: Column) -> Column:
    """Set to anything but a word for off."""
    return v.isNotNull() & ~_word(v).isin(*DISABLED)


def number(v: Column) -> Column:
    """A number with an optional unit of metres; null otherwise."""
    return F.when(_word(v).rlike("(?i)" + WITH_UNIT), F.regexp_extract(F.trim(v), NUMBER, 0).cast("double"))


def flag(v: Column) -> Column:
    """struct(value, valid): yes, true, 1 and no, false, 0; unset is a valid false."""
    w = _word(v)
    unset = v.isNull() | (v == "")
    return F.struct((~unset & w.isin("yes", "true", "1")).alias("value"), (unset | w.isin("yes", "true", "1", "no", "false", "0")).alias("valid"))


def _set(v: Column) -> Column:
    return v.isNotNull() & (v != "")


def road_class(explicit: Column, highway: Column) -> Column:
    """struct(cls, faults): an explicit class, else that of the highway value, else local; each unknown value is a fault."""
    own = F.when(_word(explicit).isin(*ROAD_CLASSES), _word(explicit))
    by_way = F.when(_word(highway).isin(*ARTERIAL), "arterial").when(_word(highway).isin(*COLLECTOR), "collector").when(_word(highway).isin(*LOCAL), "local")
    bad_own = _set(explicit) & own.isNull()
    bad_way = own.isNull() & _set(highway) & by_way.isNull()
    return F.struct(F.coalesce(own, by_way, F.lit("local")).alias("cls"), (F.coalesce(bad_own, F.lit(False)).cast("int") + F.coalesce(bad_way, F.lit(False)).cast("int")).alias("faults"))


def road_metadata(tags: Column, widths: dict[str, float] = WIDTHS, lane_width: float = LANE_WIDTH) -> Column:
    """struct(cls, width, bridge, tunnel, level, face_eligible, faults): faults are the codes of what was not understood, in order."""
    explicit = F.coalesce(tag(tags, "class"), tag(tags, "roadClass"), tag(tags, "road_class"))
    cls = road_class(explicit, tag(tags, "highway"))
    width, lanes = number(tag(tags, "width")), number(tag(tags, "lanes"))
    good_width, good_lanes = F.when(width > 0, width), F.when(lanes > 0, lanes)
    bridge, tunnel = flag(tag(tags, "bridge")), flag(tag(tags, "tunnel"))
    told = F.when(_set(tag(tags, "level")), tag(tags, "level")).otherwise(tag(tags, "layer"))
    level = F.coalesce(number(told), F.when(bridge["value"], 1.0).when(tunnel["value"], -1.0).otherwise(0.0)) + 0.0
    by_class = F.coalesce(*(F.when(cls["cls"] == c, F.lit(w)) for c, w in widths.items()))
    bad_width = _set(tag(tags, "width")) & good_width.isNull()
    bad_lanes = good_width.isNull() & _set(tag(tags, "lanes")) & good_lanes.isNull()
    found = [(cls["faults"] > 0, "class"), (cls["faults"] > 1, "class"), (bad_width, "width"), (bad_lanes, "lanes"), (~bridge["valid"], "bridge"), (~tunnel["valid"], "tunnel"), (_set(told) & number(told).isNull(), "level")]
    # not by a filter of an array, in which all of this would be interpreted
    faults = F.concat(*(F.when(c, F.array(F.lit(CODES[n]))).otherwise(F.array().cast("array<string>")) for c, n in found))
    return F.struct(
        cls["cls"].alias("cls"),
        F.coalesce(good_width, good_lanes * lane_width, by_class).alias("width"),
        bridge["value"].alias("bridge"),
        tunnel["value"].alias("tunnel"),
        level.alias("level"),
        (~bridge["value"] & ~tunnel["value"] & (level == 0)).alias("face_eligible"),
        faults.alias("faults"),
    )


def provider_class(tags: Column) -> Column:
    """building, water or park of a closed way, or null."""
    low = lambda n: F.lower(tag(tags, n))
    water = low("natural").isin(*WATER_NATURAL) | (tag(tags, "waterway") == "riverbank") | active(tag(tags, "water")) | low("landuse").isin(*PROVIDER_WATER_LANDUSE)
    park = low("landuse").isin(*PARK_LANDUSE) | low("leisure").isin(*PARK_LEISURE)
    return F.when(active(tag(tags, "building")), "building").when(F.coalesce(water, F.lit(False)), "water").when(F.coalesce(park, F.lit(False)), "park")


def polygon_class(tags: Column) -> Column:
    """building, park or water of a polygon record; without a telling tag it is water."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = tag(tags, "kind")
    building = yes(kind == "building") | yes(active(tag(tags, "building")))
    water = yes(kind == "water") | yes(active(tag(tags, "water"))) | yes(active(tag(tags, "waterway")))
    for name in ("natural", "water", "landuse", "leisure"):
        water = water | yes(_word(tag(tags, name)).isin(*MODEL_WATER))
    park = yes(F.trim(tag(tags, "landuse")) != "") | yes(F.trim(tag(tags, "leisure")) != "")
    return F.when(building, "building").when(yes(kind == "park"), "park").when(water, "water").when(park, "park").otherwise("water")


def land_use(tags: Column) -> Column:
    filled = lambda n: F.when(F.trim(tag(tags, n)) != "", tag(tags, n))
    return F.coalesce(filled("landuse"), filled("leisure"), F.lit("park"))


def positive(v: Column) -> Column:
    """A finite number above zero, without a unit; null otherwise."""
    n = F.when(F.trim(v).rlike(NUMBER + "([eE][+-]?[0-9]+)?$"), F.trim(v).cast("double"))
    return F.when((n > 0) & (n < float("inf")), n)


def building_height(tags: Column, source_id: Column, index: Column, part: Column) -> Column:
    """Height in metres: the tag, three metres a level, or 12 to 36 by a hash of the record."""
    drawn = F.lit(12.0) + hash_text(F.concat_ws("|", F.coalesce(source_id, F.lit("")), index, part)) % 25
    levels = positive(tag(tags, "building:levels")) * 3
    return F.coalesce(positive(tag(tags, "height")), F.when(levels < float("inf"), levels), drawn)


def zone_of(sector: Column, dist: Column, u: Column) -> Column:
    """Zone of a block from one uniform draw; a fixed sector decides alone."""
    ladder = F.when((dist < 0.22) & (u < 0.62), "commercial").when(u < 0.48, "residential").when(u < 0.70, "mixed").when(u < 0.84, "commercial").when(u < 0.94, "industrial").otherwise("civic")
    return F.when(sector != "mixed", sector).otherwise(ladder)
