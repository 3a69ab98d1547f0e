"""All registered queries."""
from tallyloom.catalog import (  # noqa: F401
    aggregates, cleaning, distributions, editing, filtering, forecasts, profiles, questions, series,
)
from tallyloom.catalog.registry import QUERIES

__all__ = ["QUERIES"]
