"""Queries of the general operators for training data, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft.operators import exactly_once, log_percentiles
from veridraft.operators.results import RESULT_TABLES, both_results, epoch_day
from veridraft.session import RESERVED, table

#: Parts in which the tables' arrivals are read, as they would have come in. The tables' own batches interleave in the order of
#: arrival, so the parts are cut by that order.
ARRIVAL_BATCHES = 2


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = both_results(spark, sf_dir, "row_seq", "id", "model")
    return rows.select("tab", "row_seq", exactly_once.read_id("id").alias("id"), "model")


def _batches(rows: DataFrame):
    last = rows.agg(F.max("row_seq")).head()[0] or 0
    cuts = [last * i // ARRIVAL_BATCHES for i in range(1, ARRIVAL_BATCHES)]
    number = sum(((F.coalesce("row_seq", F.lit(0)) > c).cast("int") for c in cuts), F.lit(0))
    for i in range(ARRIVAL_BATCHES):
        yield rows.where(number == i)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    store, out = exactly_once.SeenStore(spark), None
    for batch in _batches(rows):
        again = store.ingest(batch, ["tab", "id", "model"], ["row_seq"]).repeated()
        out = again if out is None else out.unionAll(again)
    return out.distinct()


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row kept of each answer: its first arrival. Rows without an id are no answer."""
    rows = _arrivals(spark, sf_dir)
    store, out = exactly_once.SeenStore(spark), None
    for batch in _batches(rows):
        new = store.ingest(batch, ["tab", "id", "model"], ["row_seq"]).selected()
        out = new if out is None else out.unionAll(new)
    return out


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables with one whole row of each answer, its first arrival, and every row that is no answer."""
    parts = [table(spark, sf_dir, t).withColumn("tab", F.lit(t)).withColumn("id", exactly_once.read_id("id")) for t in RESULT_TABLES]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True)
    store, out = exactly_once.SeenStore(spark), None
    for batch in _batches(rows):
        kept = exactly_once.deduplicate(batch, ["tab", "id", "model"], ["row_seq"], store)
        out = kept if out is None else out.unionAll(kept)
    return out


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_results(spark, sf_dir, "model", "latency_ms", "started_at").withColumn("day", epoch_day("started_at"))


def p3_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of latency_ms for each model, from the joined sketches of its days."""
    days = log_percentiles.sketch(_latencies(spark, sf_dir), "latency_ms", ["model", "day"])
    return log_percentiles.percentiles(days, ["model"])


def p3_model_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = log_percentiles.sketch(_latencies(spark, sf_dir), "latency_ms", ["model", "day"])
    return log_percentiles.percentiles(days, ["model", "day"])


def p3_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch itself, which later days can join: counts for each model, day and bucket."""
    return log_percentiles.sketch(_latencies(spark, sf_dir), "latency_ms", ["model", "day"])


def p3_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each model's median keeps the stated bound, beside the exact median."""
    exact = log_percentiles.exact_percentiles(_latencies(spark, sf_dir), "latency_ms", ["model"], [50]).select(F.col("model").alias(RESERVED + "m"), F.col("p50").alias("exact"))
    found = p3_model(spark, sf_dir).select("model", "p50")
    both = found.join(exact, F.col("model").eqNullSafe(F.col(RESERVED + "m")))
    within = F.abs(F.col("p50") - F.col("exact")) <= F.col("exact") * log_percentiles.DEFAULT_ERROR + 1e-3
    return both.select("model", F.round("exact", 6).alias("exact_median"), within.alias("within_bound"))


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p2_rows": p2_rows, "p3_model_day": p3_model_day, "p3_model": p3_model, "p3_sketch": p3_sketch, "p3_bound": p3_bound}

_SPACES = " || ".join(f"chr({ord(c)})" for c in exactly_once.STRIPPED)
_ARRIVALS = f"""
  SELECT tab, row_seq, nullif(trim(id, {_SPACES}), '') AS id, model FROM (
    SELECT 'analysis_results' AS tab, row_seq, id, model FROM analysis_results
    UNION ALL SELECT 'generation_results', row_seq, id, model FROM generation_results)"""

_E = log_percentiles.DEFAULT_ERROR
_G = (1 + _E) / (1 - _E)
_SHIFT = log_percentiles._shift(_E)
_BUCKETS = f"""
  SELECT model, CASE WHEN NOT isnan(started_at) THEN DATE '1970-01-01' + CAST(floor(started_at / 86400) AS INTEGER) END AS day,
         CAST(CASE WHEN latency_ms = 0 THEN 0 ELSE ceil(ln(latency_ms) / {math.log(_G)!r}) + {_SHIFT} END AS INTEGER) AS bucket
  FROM (SELECT model, latency_ms, started_at FROM analysis_results UNION ALL SELECT model, latency_ms, started_at FROM generation_results)
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND NOT isinf(latency_ms) AND latency_ms >= 0"""


def _value(bucket: str) -> str:
    return f"(CASE WHEN {bucket} = 0 THEN 0.0 ELSE pow({_G!r}, {bucket} - {_SHIFT}) * {2 / (1 + _G)!r} END)"


def _percentile_sql(by: str) -> str:
    cols = [f"min(CASE WHEN upto > {f}((total - 1) * {q / 100!r}) THEN bucket END) AS {f}{q}" for q in log_percentiles.PERCENTILES for f in ("floor", "ceil")]
    out = [
        f"round({_value(f'floor{q}')} + ({_value(f'ceil{q}')} - {_value(f'floor{q}')}) * ((n - 1) * {q / 100!r} - floor((n - 1) * {q / 100!r})), 4) AS p{q}"
        for q in log_percentiles.PERCENTILES
    ]
    return f"""
WITH b AS ({_BUCKETS}), s AS (SELECT {by}, bucket, count(*) AS c FROM b GROUP BY ALL),
r AS (SELECT {by}, bucket, sum(c) OVER (PARTITION BY {by} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto,
             sum(c) OVER (PARTITION BY {by}) AS total FROM s),
f AS (SELECT {by}, CAST(max(total) AS BIGINT) AS n, {', '.join(cols)} FROM r GROUP BY {by})
SELECT {by}, n, {', '.join(out)}, CAST({_E} AS DOUBLE) AS relative_error FROM f"""


SQL = {
    "p2_found": f"SELECT tab, id, model FROM ({_ARRIVALS}) WHERE id IS NOT NULL AND model IS NOT NULL GROUP BY tab, id, model HAVING count(*) > 1",
    "p2_kept": f"SELECT tab, id, model, min(row_seq) AS row_seq FROM ({_ARRIVALS}) WHERE id IS NOT NULL AND model IS NOT NULL GROUP BY tab, id, model",
    "p3_model": _percentile_sql("model"),
    "p3_model_day": _percentile_sql("model, day"),
    "p3_sketch": f"SELECT model, day, bucket, count(*) AS bucket_count FROM ({_BUCKETS}) GROUP BY model, day, bucket",
    "p3_bound": f"""WITH e AS (SELECT model, quantile_cont(latency_ms, 0.5) AS exact FROM (SELECT model, latency_ms FROM analysis_results UNION ALL SELECT model, latency_ms FROM generation_results)
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND NOT isinf(latency_ms) AND latency_ms >= 0 GROUP BY model)
SELECT e.model, round(exact, 6) AS exact_median, abs(p50 - exact) <= exact * {_E} + 1e-3 AS within_bound FROM e JOIN ({_percentile_sql("model")}) p ON e.model = p.model""",
}
