"""The library's own registered queries: golden ones (parity on fixture trees), kernel ones (scale), and
the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy import corpora, golden, kernels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**golden.QUERIES, **kernels.QUERIES, **corpora.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**golden.ORACLE, **kernels.ORACLE, **corpora.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page trees of all hosts, each within its budget of tokens."""
    return corpora.t_budget_hosts(spark, sf_dir)
