"""The registered queries of the territorial operators."""

from __future__ import annotations

from parcelwise.plans import attribute_queries, catalog_queries, layer_queries, road_queries, spatial_queries, street_queries, suite_queries, upload_queries

MODULES = (attribute_queries, catalog_queries, layer_queries, road_queries, spatial_queries, street_queries, suite_queries, upload_queries)

FLAGSHIP = "indicator_values"


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
