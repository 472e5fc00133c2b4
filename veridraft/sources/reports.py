"""Reports of scorecards and comparisons, as text and as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.functions.text import formatted

SECTIONS = {
    "Samples": ("samples", "successful_samples", "failed_samples", "ptpt_samples"),
    "Tasks": ("instruction_adherence_pct", "semantic_preservation_pct"),
    "Dialect": ("euptvid_probability", "ptpt_compliance_pct", "ptpt_compliance_graded_pct", "ptbr_leakage_pct", "avg_ptbr_violations_per_email", "wf_score", "avg_wf_penalty_per_email"),
    "Writing": ("local_writing_quality", "local_writing_quality_defect_only", "avg_grammar_errors_per_email", "avg_spelling_errors_per_email", "structural_failures_pct", "wq_evaluator_version"),
    "Operations": ("latency_p50_ms", "latency_p90_ms", "latency_p95_ms", "latency_p99_ms", "observed_wall_ms", "throughput_emails_per_min", "tokens_per_second", "total_cost_usd", "cost_per_1k_emails_usd"),
}


def tall(card: DataFrame, by: str) -> DataFrame:
    """``by, section, metric, shown`` of scorecards, formatted in the engine."""
    rows = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("string").alias("raw") if m == "wq_evaluator_version" else formatted(F.lit(m), F.col(m).cast("double")).alias("raw")) for s, ms in SECTIONS.items() for m in ms if m in card.columns]
    return card.select(by, F.explode(F.array(*rows)).alias("r")).select(by, "r.section", "r.metric", F.coalesce("r.raw", F.lit("N/A")).alias("shown"))


def text_report(card: DataFrame, by: str) -> str:
    """A report of a bounded number of runs, one row each."""
    out: list[str] = []
    last = (None, None)
    for r in tall(card, by).collect():
        if r[by] != last[0]:
            out.append(f"== {r[by]}")
        if (r[by], r["section"]) != last:
            out.append(f"-- {r['section']}")
        last = (r[by], r["section"])
        out.append(f"{r['metric']:<44}{r['shown']}")
    return "\n".join(out)


def json_report(**parts: DataFrame) -> str:
    """One sorted JSON document of small tables."""
    return json.dumps({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in parts.items()}, ensure_ascii=False, sort_keys=True, default=str)
