"""The registered queries of the library, by module, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "style_scorecard"


def _modules():
    from veridraft.plans import core_training, reference

    return [core_training, reference]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.SQL
    return out
