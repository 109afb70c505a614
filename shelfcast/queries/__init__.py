"""Every operator as a query over the test tables, most with a DuckDB statement that must agree."""

from shelfcast.queries import auditing, cleaning, demand, enrichment, learning, planning  # noqa: F401
from shelfcast.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
