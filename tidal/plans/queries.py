"""All registered queries of the series engine."""

from . import inference_queries, lag_queries, phase_queries, series_queries, source_queries, spectral_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
