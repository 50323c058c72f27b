"""Predicates, aggregates and vector functions with NA rules."""

from . import na
from .agg import Agg
from .do import Do

__all__ = ["Agg", "Do", "na"]
