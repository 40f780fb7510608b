"""Registered queries of the core and their SQL oracles."""

from paperloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
