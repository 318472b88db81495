"""All queries of the engine and their SQL."""

from __future__ import annotations

from palimpsest.plans import detection, forgery, homographies, raster, reports, scoring, search, superpixels, tabular
from palimpsest.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "detection", "forgery", "homographies", "raster", "reports", "scoring", "search", "superpixels", "tabular"]
