"""Every registered query of the library."""

from . import detail_queries, flow_queries, format_queries, queries  # noqa: F401  (each registers its own)

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
