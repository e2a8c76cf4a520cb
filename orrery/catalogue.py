"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from .plans import catalog_queries, results_queries, scalar_queries, spec_queries, text_queries, traffic_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
