"""All registered queries of the matching engine."""

from kinelink.plans import analysis_queries, contract_queries, matching_queries, series_queries, signal_queries, source_queries, stream_queries  # noqa: F401
from kinelink.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
