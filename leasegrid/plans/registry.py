"""All queries and all SQL of the lease operators."""

from __future__ import annotations

from leasegrid.plans import chain_queries, custom_queries, file_queries, intake_queries, option_queries, oracle, queries, text_queries, wording_queries

QUERIES = {name: queries.named(plan) for name, plan in queries.PLANS.items()}
ORACLE_SQL = oracle.ORACLE_SQL | text_queries.ORACLE_SQL | intake_queries.ORACLE_SQL | wording_queries.ORACLE_SQL | custom_queries.ORACLE_SQL | chain_queries.ORACLE_SQL | option_queries.ORACLE_SQL | file_queries.ORACLE_SQL
