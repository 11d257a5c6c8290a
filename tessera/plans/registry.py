"""All queries on the driver tables."""

from tessera.plans import case_queries, domain_queries, scenario_queries, service_queries, store_queries, write_queries  # noqa: F401  register their queries
from tessera.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
