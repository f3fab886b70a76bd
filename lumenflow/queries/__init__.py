"""Queries that apply the operators to the driver's tables; importing this registers them."""

from lumenflow.plans.registry import ORACLES, QUERIES
from lumenflow.queries import media, more, relational, rows, scalars, timelines, vectorsets

__all__ = ["ORACLES", "QUERIES", "media", "more", "relational", "rows", "scalars", "timelines", "vectorsets"]
