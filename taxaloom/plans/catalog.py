"""All annotation queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q
from .oracles import ORACLES

_ROWS_ONLY = ["kmeans_clusters", "qmer_clusters", "qmer_spearman", "iter_merge", "pe_merge_ordered"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(q, name) for name in [*ORACLES, *_ROWS_ONLY]}
