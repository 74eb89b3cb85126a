"""Registered queries: each module offers ``QUERIES`` and ``ORACLE`` keyed by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
