"""All registered queries of the code graph and their SQL."""

from . import catalog_more, catalog_reports  # noqa: F401  register their queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
