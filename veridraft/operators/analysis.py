"""Scores of email analyses against their truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.operators.exactly_once import read_id
from veridraft.operators.rows import first_of

#: Fields compared for equality, NULL equal to NULL.
COMPARED = ("category", "urgency", "action_required", "sentiment", "language_variant")

# The closed schema of an analysis.
STRINGS = ("sender_name", "sender_email", "recipient_name", "recipient_email", "date_sent", "subject", "sub_category")
ENUMS = {
    "category": ("complaint", "support", "sales", "billing", "internal", "inquiry", "other"), "urgency": ("low", "medium", "high", "critical"),
    "sentiment": ("positive", "neutral", "negative"), "language_variant": ("pt-pt", "pt-br", "en", "other"),
}
LISTS = ("required_actions", "key_entities")
KEYS = (*STRINGS, *ENUMS, "action_required", *LISTS, "summary")


def unfenced(column: str) -> Column:
    """The text inside a Markdown fence, or the text itself, trimmed and without a byte order mark."""
    plain = F.trim(F.regexp_replace(F.col(column), "^[\\x{FEFF}\\x{200B}]+", ""))
    inside = F.regexp_extract(plain, r"(?is)^```\s*(?:json)?\s*\n?(.*?)\n?```\s*$", 1)
    return F.when(inside != "", F.trim(inside)).otherwise(plain)


def schema_valid(column: str) -> Column:
    """Whether JSON text is an object with exactly the schema's keys, their types and values. The type of
    each value decides, so "true" is no boolean."""
    v = F.try_parse_json(F.col(column))
    keys = F.json_object_keys(column)
    kind = {k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in KEYS}
    text = {k: F.try_variant_get(v, f"$.{k}", "string") for k in ENUMS}
    # the engine's parser stops after the first value; the schema has no nested objects, so nothing but a quote,
    # a bracket or a word stands before the last brace
    x = F.btrim(F.col(column), F.lit(" \t\r\n"))
    tests = [x.endswith("}") & ~x.rlike(r'\}[^"]*\}$'), keys.isNotNull(), F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(KEYS)])]
    tests += [kind[k].isin("STRING", "VOID") for k in STRINGS]
    tests += [(kind[k] == "STRING") & text[k].isin(*values) for k, values in ENUMS.items()]
    tests += [kind["action_required"] == "BOOLEAN", kind["summary"] == "STRING"]
    tests += [kind[k].isin("ARRAY<STRING>", "ARRAY<VOID>") for k in LISTS]
    out = tests[0]
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _entities(column: Column) -> Column:
    cleaned = F.transform(column, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"\s+", " "))
    return F.array_distinct(F.filter(cleaned, lambda e: e != ""))


def entity_f1(truth: Column, said: Column) -> Column:
    """Harmonic mean of precision and recall of two sets of names; two empty sets agree fully."""
    a, b = _entities(F.coalesce(truth, F.array().cast("array<string>"))), _entities(F.coalesce(said, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(a, b)).cast("double")
    f1 = 2 * both / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(f1)


_SAID = "category string, urgency string, action_required boolean, sentiment string, language_variant string, key_entities array<string>"


def matched(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Each model's first answer to each id, beside the truth where there is one."""
    fields = ["model", "id", "status", "error", "is_valid_schema", "parse_repaired"]
    parsed = results.withColumn("id", read_id("id")).where("id IS NOT NULL").select("row_seq", *fields, F.from_json("parsed", _SAID).alias("said"))
    said = first_of(parsed, ["model", "id"], "row_seq", columns=[*fields, "said"])
    return said.join(truth.select("id", "ground_truth", F.lit(True).alias("asked")), "id", "left")


def score(truth: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each model; missing, failed and scored answers add up to the truth rows."""
    rows = matched(truth, results)
    asked = F.coalesce("asked", F.lit(False))
    failed = asked & ((F.col("status") == "error") | (F.coalesce("error", F.lit("")) != ""))
    rows = rows.withColumn("failed", F.coalesce(failed, F.lit(False))).withColumn("scored", asked & ~F.col("failed"))

    def rate(test: Column) -> Column:
        return F.round(100 * F.avg(F.when(F.col("scored"), test.cast("double"))), 2)

    requested = F.lit(truth.count())
    aggs = [(requested - F.count_if(asked)).alias("missing"), F.count_if("failed").alias("failed"), F.count_if("scored").alias("scored")]
    valid = F.coalesce(F.col("is_valid_schema"), F.lit(False))
    aggs += [rate(valid).alias("schema_pct"), rate(valid & ~F.col("parse_repaired")).alias("schema_raw_pct"), rate(F.col("parse_repaired")).alias("repaired_pct")]
    aggs += [F.count_if(F.col("scored") & F.col("parse_repaired").isNotNull()).alias("n_repaired")]
    aggs += [rate(F.col(f"ground_truth.{c}").eqNullSafe(F.col(f"said.{c}"))).alias(f"{c}_pct") for c in COMPARED]
    aggs += [F.round(F.avg(F.when(F.col("scored"), entity_f1(F.col("ground_truth.key_entities"), F.col("said.key_entities")))), 4).alias("entity_f1")]
    return rows.groupBy("model").agg(requested.alias("requested"), *aggs)


def unexpected(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Ids that results have and the truth has not."""
    return results.select(read_id("id").alias("id")).where("id IS NOT NULL").join(truth.select("id"), "id", "left_anti").distinct()


def unanswered(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Ids of the truth that no result answers."""
    return truth.select("id").join(results.select(read_id("id").alias("id")), "id", "left_anti").distinct()
