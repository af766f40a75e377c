"""All registered queries."""

from veilspan.plans import detection, extend, joins, limits, processing, shapes, state  # noqa: F401
from veilspan.plans.base import QUERIES

__all__ = ["QUERIES"]
