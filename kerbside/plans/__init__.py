"""The query catalogue: each query with its DataFrame plan and its oracle in SQL."""

from kerbside.plans import (
    block_queries,
    geometry_queries,
    index_queries,
    raster_queries,
    robustness_queries,
    settings_queries,
    source_queries,
    spatial_queries,
    text_queries,
    time_queries,
)

_MODULES = (index_queries, time_queries, text_queries, raster_queries, spatial_queries, robustness_queries, geometry_queries, source_queries, block_queries, settings_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
