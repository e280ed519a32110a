"""Every operator and analysis as a named query over the given tables, with its SQL twin."""

from threadlens.catalog import analyses, models, relational, sources, textual  # noqa: F401
from threadlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
