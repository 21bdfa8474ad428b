"""Registered queries. Importing this package registers all of them."""

from loomgrid.plans import checks, cities, ingest, measures, polygons, queries, routes

QUERIES, SQL = queries.QUERIES, queries.SQL
__all__ = ["QUERIES", "SQL", "checks", "cities", "ingest", "measures", "polygons", "routes"]
