"""All queries of the library and their SQL."""

from __future__ import annotations

from . import cluster_queries, feature_queries, lookup_queries, nested_queries, schema_queries, tree_queries, weighted_queries

MODULES = (tree_queries, feature_queries, cluster_queries, weighted_queries, lookup_queries, nested_queries, schema_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
