"""All registered queries of the engine and their SQL, by name."""

from heliograph.plans import behaviour_queries, engine_queries, retrieval_queries, search_queries, source_queries, store_queries

MODULES = (retrieval_queries, search_queries, behaviour_queries, source_queries, engine_queries, store_queries)

QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
