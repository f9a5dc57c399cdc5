"""All driver queries by name."""

from . import choosing, matching, models, natural, places, rasters, records, texts  # noqa: F401
from .shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
