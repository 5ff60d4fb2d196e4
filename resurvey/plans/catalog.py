"""All registered queries."""

from resurvey.plans import catalog_agree, catalog_joins, catalog_regen, catalog_rows  # noqa: F401
from resurvey.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
