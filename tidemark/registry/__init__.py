"""All registered queries."""

from tidemark.registry import behaviour, features, forecasts, recipes, reports  # noqa: F401
from tidemark.registry.base import REGISTRY, Query, Tables

__all__ = ["REGISTRY", "Query", "Tables"]
