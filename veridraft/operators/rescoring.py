"""Recomputing what rows say about themselves: scores, criteria, status, and repaired JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.functions import text as T
from veridraft.operators import criteria, dialect, quality
from veridraft.operators.analysis import unfenced
from veridraft.operators.rows import portuguese, successful
from veridraft.session import ship


def rescored(rows: DataFrame) -> DataFrame:
    """Successful rows with content get new defect scores, Portuguese ones also new fidelity and compliance;
    all other rows pass unchanged. Row order and other columns stay."""
    fields = rows.select("dialect_evaluation.violations").schema[0].dataType.elementType.names
    scores = quality.defect_scores(rows, "content")
    fresh = successful() & F.col("defect_score").isNotNull()
    words = F.size(T.matches("content", T.WF_WORD))
    violations = F.col("dialect_evaluation.violations")
    fidelity, graded = dialect.fidelity(violations, words, fields), dialect.graded(violations, words, fields)
    spoken = fresh & portuguese() & violations.isNotNull()
    changed = scores.withColumns(
        {
            "wq_defect_only_score": F.when(fresh, F.col("defect_score")).otherwise(F.col("wq_defect_only_score")),
            "wf_score": F.when(spoken, fidelity["wf_score"]).otherwise(F.col("wf_score")),
            "ptpt_compliance_pct": F.when(spoken, graded["ptpt_compliance_pct"]).otherwise(F.col("ptpt_compliance_pct")),
            "ptpt_compliance_graded_pct": F.when(spoken, graded["ptpt_compliance_graded_pct"]).otherwise(F.col("ptpt_compliance_graded_pct")),
        }
    )
    return changed.select(*rows.columns)


def refreshed(rows: DataFrame, own: DataFrame, task: str, source: str) -> DataFrame:
    """Rows with adherence and preservation computed anew from the criteria of their tasks."""
    new = criteria.adherence(rows, own, "row_seq", task, "content", source)
    kept = rows.drop("instruction_adherence_pct", "semantic_preservation_pct")
    return kept.join(new, "row_seq", "left").select(*rows.columns)


def enriched(rows: DataFrame) -> DataFrame:
    """Rows whose provider reports an error or an unfinished answer become error rows."""
    finish = F.get_json_object("raw_response", "$.choices[0].finish_reason")
    broken = F.get_json_object("raw_response", "$.error").isNotNull() | F.coalesce(~finish.isin("stop"), F.lit(False))
    told = F.coalesce(F.get_json_object("raw_response", "$.error.message"), F.concat(F.lit("finish_reason="), finish))
    return rows.withColumn("error", F.when(broken & successful(), T.error_summary(told)).otherwise(F.col("error"))).withColumn("status", F.when(broken, F.lit("error")).otherwise(F.col("status")))


def _only_object(text: str | None) -> str | None:
    """The one top-level JSON object in a text; None if there is none or more than one."""
    if not text:
        return None
    decoder, found, at = json.JSONDecoder(), [], 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict):
            found.append(text[at:end])
        at = end
    return found[0] if len(found) == 1 else None


def repaired(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, parsed, repaired``: the JSON object of each text, as it stands, out of its fence, or the only one
    inside other words; NULL where there is none or there are several. Clean texts never leave the JVM."""
    ship(df.sparkSession)
    inside = unfenced(column)
    parsed = F.coalesce(F.schema_of_variant(F.try_parse_json(inside)).startswith("OBJECT"), F.lit(False))
    # the engine's parser stops after the first value; texts in which another might follow take the slow path
    single = inside.endswith("}") & (F.regexp_count(inside, F.lit(r"\{")) == F.regexp_count(inside, F.lit(r"\}"))) & ~inside.rlike(r"\}\s*(?:,?\s*\{|[^\s,\]}])")
    clean = parsed & F.coalesce(single, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"), inside.alias("inside"), clean.alias("clean"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [_only_object(t) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "parsed": parsed, "repaired": [p is not None for p in parsed]})

    kind = df.schema[key].dataType.simpleString()
    easy = rows.where("clean").select("key", F.col("inside").alias("parsed"), (F.trim("text") != F.col("inside")).alias("repaired"))
    hard = rows.where("NOT clean AND text IS NOT NULL").select("key", "text").mapInPandas(run, f"key {kind}, parsed string, repaired boolean")
    return easy.unionByName(hard).withColumnRenamed("key", key)
