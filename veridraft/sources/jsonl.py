"""JSON lines in and out, prompts, lexicons, prices, recorded responses."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veridraft.functions.text import fold_diacritics


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """One row for each non-blank line, in any order. A line that is no JSON object is an error in strict
    reading, which names file and content; otherwise it comes out with all fields NULL. Given a schema nothing is
    inferred, and Spark reads the lines once."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("path", F.input_file_name())
    if strict:
        bad = lines.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))).select("path", "value").head()
        if bad:
            raise ValueError(f"{bad['path']}: is not an object: {bad['value'][:80]}")
    schema = schema or spark.read.json(path).schema
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """Objects with sorted keys, one a line. ``single`` makes one file, for what fits one task."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    (rows.coalesce(1) if single else rows).write.mode("errorifexists").text(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``version, description, ord, id, lang, prompt`` of a prompts document."""
    doc = spark.read.schema("version string, description string, prompts array<struct<id: string, lang: string, prompt: string>>").json(path, multiLine=True)
    return doc.select("version", "description", F.posexplode("prompts").alias("ord", "p")).select("version", "description", "ord", "p.*")


def read_dictionary(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """``variant, form, folded`` of a word list with a count in its first line and flags after a slash."""
    words = spark.read.text(path).select(F.trim(F.split("value", "/")[0]).alias("form"))
    words = words.where((F.col("form") != "") & ~F.col("form").rlike(r"^\d+$")).distinct()
    return words.select(F.lit(variant).alias("variant"), F.lower("form").alias("form"), fold_diacritics(F.lower("form")).alias("folded"))


def read_schemes(path: str) -> list[str]:
    """Names of protocols from a file, one or more a line."""
    return sorted({w.lower() for w in Path(path).read_text(encoding="utf-8").split()})


def price_rows(listing: list[dict]) -> list[tuple]:
    """``model, prompt_price_per_1k, completion_price_per_1k, context_length`` from a provider's listing of
    prices a token; what is negative or no number is unknown."""

    def price(value) -> float | None:
        if isinstance(value, bool):
            return None
        try:
            x = float(value)
        except (TypeError, ValueError):
            return None
        return x * 1000 if math.isfinite(x) and x >= 0 else None

    return [(m["id"], price((m.get("pricing") or {}).get("prompt")), price((m.get("pricing") or {}).get("completion")), m.get("context_length")) for m in listing if m.get("id")]


def recorded_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses recorded elsewhere, in place of calls to a provider: Parquet, or JSON lines of result rows."""
    if path.endswith(".parquet") or Path(path.removeprefix("file://")).is_dir() and any(Path(path.removeprefix("file://")).glob("*.parquet")):
        return spark.read.parquet(path)
    return read_jsonl(spark, path)
