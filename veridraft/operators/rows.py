"""Row predicates, row validation, costs and percentages of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridraft.operators.exactly_once import read_id
from veridraft.operators.log_percentiles import valid_measure
from veridraft.session import RESERVED

#: Fields that must be finite and not negative where they are present.
MEASURES = ("latency_ms", "prompt_tokens", "completion_tokens", "cost_usd", "started_at", "finished_at")
DAMAGED = "unsuccessful finish_reason"


def successful(has_status: bool = True) -> Column:
    """A row without a status column passes, one whose status is NULL does not; a success with an error
    text is none."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    return (F.col("status").eqNullSafe(F.lit("success")) & no_error) if has_status else no_error


def portuguese(column: str = "target_lang") -> Column:
    return F.trim(F.lower(column)).eqNullSafe(F.lit("pt-pt"))


def same(a: str, b: str) -> Column:
    """Equality in which NULL equals NULL."""
    return F.col(a).eqNullSafe(F.col(b))


def safe_number(column: Column | str, default: float = 0.0) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).try_cast("double"), F.lit(default))


def percent_value(column: Column | str, kind: str) -> Column:
    """Statistics read booleans as 0 or 100, numbers as they are, anything else as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c, 100.0).when(~c, 0.0) if kind == "boolean" else c.try_cast("double")


def recorded_cost(prices: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``cost``: the recorded one, else the provider's, else tokens times price; negative or
    unreadable costs are unknown. Prices are looked up by the exact model."""
    usage = "$.usage"
    upstream = F.get_json_object("raw_response", f"{usage}.cost_details.upstream_inference_cost")
    told = F.coalesce(F.col("cost_usd"), upstream.try_cast("double"), F.get_json_object("raw_response", f"{usage}.cost").try_cast("double"))
    names = {c: RESERVED + c for c in ("prompt_price_per_1k", "completion_price_per_1k")}
    priced = rows.join(prices.select("model", *[F.col(c).alias(n) for c, n in names.items()]), "model", "left")
    computed = F.col("prompt_tokens") / 1000 * F.col(names["prompt_price_per_1k"]) + F.col("completion_tokens") / 1000 * F.col(names["completion_price_per_1k"])
    known = F.when(valid_measure(told), told)
    return priced.withColumn("cost", F.coalesce(known, F.when(F.col("cost_usd").isNull() & told.isNull(), computed))).drop(*names.values())


def row_errors(rows: DataFrame, kind: str = "generation", strict: bool = True) -> DataFrame:
    """``row_seq, rule`` for everything row validation refuses, all of it rather than the first."""
    ident = read_id("id")
    finish = F.get_json_object("raw_response", "$.choices[0].finish_reason")
    ok = F.col("status").eqNullSafe(F.lit("success"))
    response = F.col("raw_response").isNotNull()
    choices = F.get_json_object("raw_response", "$.choices[0]")
    rules = [("missing id", ident.isNull())]
    if strict:
        rules += [
            ("missing model", F.coalesce(F.trim("model"), F.lit("")) == ""),
            ("status must be success or error", ~F.coalesce(F.col("status").isin("success", "error"), F.lit(False))),
        ]
    rules += [
        ("error status lacks error detail", F.col("status").eqNullSafe(F.lit("error")) & (F.coalesce(F.trim("error"), F.lit("")) == "")),
        ("success row contains error detail", ok & (F.coalesce("error", F.lit("")) != "")),
    ]
    if strict and kind == "generation":
        refusal = F.coalesce(F.get_json_object("raw_response", "$.choices[0].message.refusal"), F.lit(""))
        rules += [
            ("successful generation lacks content", ok & (F.coalesce(F.trim("content"), F.lit("")) == "")),
            ("successful generation lacks provider choices", ok & response & choices.isNull()),
            (DAMAGED, ok & choices.isNotNull() & (finish != "stop")),
            ("provider refusal in successful generation", ok & choices.isNotNull() & (refusal != "")),
            ("provider error in successful generation", ok & choices.isNotNull() & F.get_json_object("raw_response", "$.error").isNotNull()),
        ]
    rules += [(f"{m} must be finite and non-negative", F.col(m).isNotNull() & ~valid_measure(m)) for m in MEASURES if m in rows.columns]
    found = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in rules]))
    return rows.select("row_seq", F.explode(found).alias("rule"))


def repeated_ids(rows: DataFrame, by: list[str]) -> DataFrame:
    keyed = rows.withColumn("id", read_id("id")).where("id IS NOT NULL")
    return keyed.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of(rows: DataFrame, by: list[str], order: str, last: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One row for each key: the first, or the last, by ``order``, with the ``columns`` asked for (all by default). An aggregate,
    so hot keys combine before they are moved; what is not asked for is not read."""
    whole = F.struct(*[F.col(c) for c in columns or rows.columns])
    pick = F.max_by(whole, order) if last else F.min_by(whole, order)
    return rows.groupBy(*[F.col(c).alias(RESERVED + c) for c in by]).agg(pick.alias(RESERVED + "row")).select(RESERVED + "row.*")


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
