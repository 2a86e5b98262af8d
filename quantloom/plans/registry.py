"""Every query of the library by name, with its DuckDB twin."""

from . import density_queries, entry_queries, model_queries, monitoring_queries, performance_queries, portfolio_queries, relational_queries, report_queries, tick_queries, validation_queries  # noqa: F401
from .common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
