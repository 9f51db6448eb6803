"""All queries of the analytics library and the SQL they are held against."""

from ledgerline.plans import cleaning, composites, files, keys, linking, profiling, sampling, statistics, texts  # noqa: F401
from ledgerline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
