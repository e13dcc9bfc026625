"""All registered queries outside the subpackage for texts."""

from __future__ import annotations

from waymesh.plans import domain_queries, function_queries, graph_queries, problem_queries, relational_queries, route_queries, space_time_queries

_MODULES = (problem_queries, graph_queries, relational_queries, domain_queries, space_time_queries, route_queries, function_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
