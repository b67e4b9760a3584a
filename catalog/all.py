"""Import every query module so the registry is complete."""

from catalog import bars, cleaning, evaluation, features, gaps, indicators, labels, models, signals, streams  # noqa: F401
from catalog.base import REGISTRY

__all__ = ["REGISTRY"]
