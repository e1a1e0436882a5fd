"""All registered queries and oracles."""

from . import annotation_queries, kernel_queries, list_queries, pair_queries, peak_queries, psm_queries, report_queries, sequence_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
