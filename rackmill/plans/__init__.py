"""The registered queries, and the same as SQL."""

from . import oracles, queries, report_queries, trees

QUERIES = {**queries.QUERIES, **trees.QUERIES, **report_queries.QUERIES}
SQL = {**oracles.SQL, **trees.SQL, **report_queries.SQL}
