"""A map provider as a PySpark data source: a place or coordinates and a radius go in, features come out.

All network access goes through one function that callers can put in place of the default, so that jobs and tests run
without a network. Failures carry a stable code.
"""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The range of the radius, and what is asked of the provider.
LEAST_RADIUS, MOST_RADIUS = 25.0, 450.0
WAYS = (
    '["highway"]',
    '["building"]',
    '["natural"~"^(water|wetland|wood)$"]',
    '["waterway"="riverbank"]',
    '["water"="yes"]',
    '["landuse"~"^(allotments|basin|cemetery|churchyard|forest|garden|grass|meadow|orchard|park|recreation_ground|reservoir|village_green|wood)$"]',
    '["leisure"~"^(garden|golf_course|park|pitch|recreation_ground)$"]',
)

Fetch = Callable[[str, bytes | None], tuple[int, str]]


class ProviderError(Exception):
    def __init__(self, code: str, message: str, status: int | None = None):
        super().__init__(message)
        self.code, self.status = code, status


def _pair(text: str) -> list[str] | None:
    """The two numbers that a text is made of, apart by a comma or a semicolon; None for any other text."""
    parts = [part.strip() for part in text.replace(";", ",").split(",")]
    plain = all(part and not part.lower().strip("+-.0123456789e") and part[-1] in ".0123456789" for part in parts)
    return parts if len(parts) == 2 and plain else None


def coordinates(value) -> tuple[float, float] | None:
    """(lon, lat) of a pair, a mapping or a text "lon, lat"; None for a place's name."""
    if isinstance(value, str):
        if not value.strip():
            raise ProviderError("invalid-location", "a place or longitude, latitude is needed")
        value = _pair(value)
        if value is None:
            return None
    if isinstance(value, dict):
        value = (value.get("lon"), value.get("lat"))
    try:
        lon, lat = map(float, value)
    except (TypeError, ValueError):
        raise ProviderError("invalid-location", "coordinates are two numbers") from None
    if not (math.isfinite(lon) and math.isfinite(lat) and -180 <= lon <= 180 and -90 <= lat <= 90):
        raise ProviderError("invalid-location", "coordinates are out of range")
    return lon, lat


def crop_radius(value=MOST_RADIUS) -> float:
    try:
        radius = float(value)
    except (TypeError, ValueError):
        radius = math.nan
    if not LEAST_RADIUS <= radius <= MOST_RADIUS:
        raise ProviderError("invalid-radius", f"the radius is between {LEAST_RADIUS:g} and {MOST_RADIUS:g} metres")
    return radius


def overpass_query(location, radius=MOST_RADIUS) -> str:
    """The filters that the provider applies before it sends anything."""
    lon, lat = coordinates(location) or (None, None)
    if lon is None:
        raise ProviderError("invalid-location", "the query needs coordinates")
    around = f"(around:{crop_radius(radius):g},{lat:g},{lon:g})"
    return "[out:json][timeout:25];\n(\n" + "".join(f"  way{around}{w};\n" for w in WAYS) + ");\nout tags geom;"


def geocoding_url(endpoint: str, query: str, token: str) -> str:
    quoted = urllib.parse.quote(query, safe="!'()*~")
    url = endpoint.replace("{query}", quoted) if "{query}" in endpoint else f"{endpoint.rstrip('/')}/{quoted}.json"
    return url + ("&" if "?" in url else "?") + urllib.parse.urlencode({"limit": 1, "access_token": token})


def default_fetch(url: str, body: bytes | None) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=60) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def request_json(fetch: Fetch, url: str, body: bytes | None, service: str):
    try:
        status, text = fetch(url, body)
    except Exception as e:
        raise ProviderError("network", f"{service} can't be reached") from e
    if status in (401, 403):
        raise ProviderError("missing-token", f"{service} does not accept the token", status)
    if status == 429:
        raise ProviderError("rate-limit", f"{service} asks to wait", status)
    if not 200 <= status < 300:
        raise ProviderError("http", f"{service} failed with status {status}", status)
    try:
        return json.loads(text)
    except ValueError as e:
        raise ProviderError("invalid-response", f"{service} gave no JSON") from e


def resolve(location, endpoint: str = "", token: str = "", fetch: Fetch = default_fetch) -> dict:
    """lon, lat, label and bbox of a location; coordinates need no geocoder."""
    at = coordinates(location)
    if at:
        return {"lon": at[0], "lat": at[1], "label": f"{at[0]:g}, {at[1]:g}", "bbox": None}
    if not token:
        raise ProviderError("missing-token", "a place's name needs a token")
    found = (request_json(fetch, geocoding_url(endpoint, location.strip(), token), None, "geocoder").get("features") or [None])[0] or {}
    center = found.get("center") or (found.get("geometry") or {}).get("coordinates")
    if not isinstance(center, list) or len(center) < 2:
        raise ProviderError("location-not-found", f"no place {location!r}")
    lon, lat = coordinates(center[:2])
    return {"lon": lon, "lat": lat, "label": found.get("place_name") or location, "bbox": found.get("bbox")}


def says(error: Exception) -> str:
    return str(error) if isinstance(error, ProviderError) else "the location can't be loaded"


class At(InputPartition):
    def __init__(self, location: str):
        super().__init__(location)
        self.location = location


class ProviderSource(DataSource):
    """spark.read.format("map_provider").option("locations", "lon,lat|lon,lat").option("radius", 300): one partition a location.

    fetch: a class attribute, so that tests can put their own in its place before registering a subclass."""

    fetch: Fetch = staticmethod(default_fetch)

    @classmethod
    def name(cls) -> str:
        return "map_provider"

    def schema(self) -> str:
        return "location string, value string"

    def reader(self, schema) -> DataSourceReader:
        return ProviderReader(dict(self.options), type(self).fetch)


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch
        crop_radius(options.get("radius", MOST_RADIUS))

    def partitions(self) -> list[At]:
        return [At(x) for x in self.options["locations"].split("|")]

    def read(self, partition: At) -> Iterator[tuple]:
        at = resolve(partition.location, self.options.get("geocoder", ""), self.options.get("token", ""), self.fetch)
        body = urllib.parse.urlencode({"data": overpass_query((at["lon"], at["lat"]), self.options.get("radius", MOST_RADIUS))}).encode()
        yield partition.location, json.dumps(request_json(self.fetch, self.options["endpoint"], body, "map data"))
