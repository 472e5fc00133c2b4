"""Columns common to result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft.session import table

RESULT_TABLES = ("analysis_results", "generation_results")


def both_results(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of both result tables, with the table's name as ``tab``."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), *columns) for t in RESULT_TABLES]
    return parts[0].unionAll(parts[1])


def epoch_day(column: str) -> Column:
    """The UTC day of epoch seconds, whatever the session's time zone; NULL where there is none."""
    x = F.col(column)
    return F.when(~F.isnan(x) & (F.abs(x) < 1e11), F.date_from_unix_date(F.floor(x / 86400).cast("int")))
