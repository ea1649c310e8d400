"""Registered queries of the signal operators and their SQL."""

from __future__ import annotations

from . import annotation_queries, chrom_queries, report_queries, series_queries, spectra_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
