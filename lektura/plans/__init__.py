"""The registered queries and the SQL that says the same."""

from lektura.plans import aggregates, checks, extraction, joins, matching, projections, ranking, retrieval, rules, sources, streams  # noqa: F401
from lektura.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
