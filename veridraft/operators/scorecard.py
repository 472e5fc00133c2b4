"""The scorecard of generated emails: every metric with its own denominator, missing evidence NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.operators.log_percentiles import PERCENTILES, exact_percentiles, valid_measure
from veridraft.operators.rows import portuguese, recorded_cost, successful
from veridraft.session import RESERVED

#: (metric, column, over Portuguese rows only)
MEANS = (
    ("instruction_adherence_pct", "instruction_adherence_pct", False), ("semantic_preservation_pct", "semantic_preservation_pct", False), ("local_writing_quality", "writing_quality_score", False),
    ("local_writing_quality_defect_only", "wq_defect_only_score", False), ("euptvid_probability", "euptvid_probability", True), ("ptpt_compliance_pct", "ptpt_compliance_pct", True),
    ("ptpt_compliance_graded_pct", "ptpt_compliance_graded_pct", True), ("wf_score", "wf_score", True),
)
#: Metrics whose names are listed where nothing supports them.
LISTED = ("instruction_adherence_pct", "semantic_preservation_pct", "euptvid_probability", "ptpt_compliance_pct", "ptbr_leakage_pct", "avg_ptbr_violations_per_email", "wf_score", "avg_wf_penalty_per_email", "local_writing_quality", "local_writing_quality_defect_only", "avg_grammar_errors_per_email")


def scorecard(rows: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group, in one aggregate and, for the percentiles, which are exact and interpolated, two passes that
    never gather a group's values. ``repetition_pct`` is NULL where rows carry no count of repetitions."""
    counted = rows.schema["writing_quality"].dataType.names
    base = recorded_cost(prices, rows).withColumn("ok", successful()).withColumn("pt", F.col("ok") & portuguese())

    def mean(column, when="ok"):
        return F.avg(F.when(F.col(when), column))

    def some(column, when="ok"):
        return F.count(F.when(F.col(when), column))

    def share(test, when="ok"):
        return F.avg(F.when(F.col(when) & test.isNotNull(), F.when(test, 100.0).otherwise(0.0)))

    wq, flags = F.col("writing_quality"), F.col("ptbr_leakage_detected")
    violations, leaks = F.col("dialect_evaluation.ptbr_violation_count"), F.col("wf_evaluation.weighted_leaks")
    timed = valid_measure("started_at") & valid_measure("finished_at")
    tool = F.coalesce(F.bool_or(F.when(F.col("ok"), wq["languagetool_api_used"])), F.lit(False))
    aggs = [
        F.count(F.lit(1)).alias("samples"), F.count_if("ok").alias("successful_samples"), F.count_if(~F.col("ok")).alias("failed_samples"), F.count_if("pt").alias("ptpt_samples"),
    ]
    for name, column, only in MEANS:
        aggs += [mean(F.col(column), "pt" if only else "ok").alias(name), some(F.col(column), "pt" if only else "ok").alias("n_" + name)]
    aggs += [
        share(flags, "pt").alias("ptbr_leakage_pct"), some(flags, "pt").alias("n_ptbr_leakage_pct"),
        mean(F.when(violations >= 0, violations), "pt").alias("avg_ptbr_violations_per_email"), some(F.when(violations >= 0, violations), "pt").alias("n_avg_ptbr_violations_per_email"),
        mean(leaks, "pt").alias("avg_wf_penalty_per_email"), some(leaks, "pt").alias("n_avg_wf_penalty_per_email"), tool.alias("languagetool_available"),
        F.when(tool, mean(wq["grammar_error_count"])).alias("avg_grammar_errors_per_email"), F.when(tool, some(wq["grammar_error_count"])).otherwise(0).alias("n_avg_grammar_errors_per_email"),
        mean(wq["spelling_error_count"]).alias("avg_spelling_errors_per_email"), share(wq["structural_issue_count"] > 0).alias("structural_failures_pct"), some(wq["structural_issue_count"]).alias("n_structural_failures_pct"), some(wq["spelling_error_count"]).alias("n_avg_spelling_errors_per_email"),
        (share(wq["repetition_count"] > 0) if "repetition_count" in counted else F.lit(None).cast("double")).alias("repetition_pct"), (some(wq["repetition_count"]) if "repetition_count" in counted else F.lit(0).cast("bigint")).alias("n_repetition_pct"),
        F.count_distinct(F.when(F.col("ok"), wq["wq_evaluator_version"])).alias("versions"), F.max(F.when(F.col("ok"), wq["wq_evaluator_version"])).alias("version"),
        F.count(F.when(F.col("ok") & valid_measure("latency_ms"), 1)).alias("n_latency_ms"),
        (F.greatest(F.lit(0.0), F.max(F.when(timed, F.col("finished_at"))) - F.min(F.when(timed, F.col("started_at")))) * 1000).alias("observed_wall_ms"),
        F.sum(F.when(F.col("ok"), F.coalesce("prompt_tokens", F.lit(0)))).alias("prompt_tokens"), F.sum(F.when(F.col("ok"), F.coalesce("completion_tokens", F.lit(0)))).alias("completion_tokens"),
        some(F.col("cost")).alias("known_cost_samples"), F.count_if(F.col("ok") & F.col("cost").isNull()).alias("unknown_cost_samples"), F.sum(F.when(F.col("ok"), F.col("cost"))).alias("known_cost"), mean(F.col("cost")).alias("mean_cost"),
    ]
    card = base.groupBy(*by).agg(*aggs)
    took = exact_percentiles(rows.where(successful()).select(*by, "latency_ms"), "latency_ms", by)
    took = took.select(*[F.col(c).alias(RESERVED + c) for c in by], *[F.col(f"p{p}").alias(f"latency_p{p}_ms") for p in PERCENTILES])
    on = [F.col(c).eqNullSafe(F.col(RESERVED + c)) for c in by]
    card = card.join(took, on, "left").drop(*[RESERVED + c for c in by])
    minutes = F.nullif(F.col("observed_wall_ms"), F.lit(0.0)) / 60000
    known = F.col("unknown_cost_samples") == 0
    return card.select(
        *[c for c in card.columns if c not in ("versions", "version", "known_cost", "mean_cost")],
        F.when(F.col("versions") > 1, "mixed").otherwise(F.col("version")).alias("wq_evaluator_version"),
        (F.col("successful_samples") / minutes).alias("throughput_emails_per_min"),
        ((F.col("prompt_tokens") + F.col("completion_tokens")) / (minutes * 60)).alias("tokens_per_second"),
        F.when(known, F.col("known_cost")).alias("total_cost_usd"),
        F.when(known & (F.col("successful_samples") > 0), F.col("mean_cost") * 1000).alias("cost_per_1k_emails_usd"),
        (F.col("mean_cost") * 1000).alias("cost_per_1k_emails_usd_known_only"),
    )


def denominators(card: DataFrame, by: list[str]) -> DataFrame:
    """The counts behind each metric as rows: 17 for each group."""
    card = card.withColumn("n_cost_usd", F.col("known_cost_samples"))
    names = [c for c in card.columns if c.startswith("n_") and c != "n_avg_spelling_errors_per_email"]
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(n[2:]) for n in names]), F.array(*[F.col(n) for n in names]))).alias("metric", "n")
    return card.select(*by, pairs)


def unavailable(card: DataFrame, by: list[str]) -> DataFrame:
    """For each group the sorted names of metrics nothing supports."""
    listed = [F.when(F.col("n_" + m) == 0, F.lit(m)) for m in LISTED]
    timing = [F.when(F.col(m).isNull(), F.lit(m)) for m in ("throughput_emails_per_min", "tokens_per_second")]
    return card.select(*by, F.array_join(F.array_sort(F.array_compact(F.array(*listed, *timing))), ",").alias("unavailable_metrics"))
