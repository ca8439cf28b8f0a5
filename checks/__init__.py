"""Queries over the driver's tables with their DuckDB twins."""

from checks import changes, flows, reads, scalars  # noqa: F401  (importing them fills the register)
from checks.catalog import CHECKS

__all__ = ["CHECKS"]
