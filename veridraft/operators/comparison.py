"""Comparison of runs: pairs by id, bootstrap intervals, separability, deltas and agreement with gold labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.operators.exactly_once import read_id
from veridraft.operators.rows import first_of, percent_value, successful
from veridraft.session import ship

REPETITIONS, SEED = 4000, 20260907


def paired(rows: DataFrame, first: str, second: str, metric: str) -> DataFrame:
    """``id, diff`` (second less first) over ids that both runs answered, the last answer of each counting."""
    kind = rows.schema[metric].dataType.typeName()
    keyed = rows.withColumn("id", read_id("id")).where("id IS NOT NULL")

    def run(model: str, name: str) -> DataFrame:
        own = first_of(keyed.where(F.col("model") == model).select("id", "row_seq", "status", "error", metric), ["id"], "row_seq", last=True)
        value = percent_value(metric, kind)
        return own.where(successful()).select("id", value.alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name))

    return run(first, "a").join(run(second, "b"), "id").select("id", (F.col("b") - F.col("a")).alias("diff"))


def summary(diffs: DataFrame) -> DataFrame:
    d = F.col("diff")
    return diffs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.expr("percentile(diff, 0.5)").alias("median_difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def bootstrap(diffs: DataFrame, repetitions: int = REPETITIONS, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """``low, high``: a percentile interval of the mean difference.

    Resampling is by independent Poisson weights, which for many rows equals drawing with replacement. Rows of the same
    difference are counted first: the sum of n weights of mean 1 is one weight of mean n, so each distinct
    difference draws once for all repetitions, seeded by its value. Each task sends ``repetitions`` sums and weights; no task
    gathers the differences, and the result does not depend on partitioning. No rows, no interval.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(repetitions), np.zeros(repetitions)
        for b in batches:
            for h, d, n in zip(b["h"], b["diff"], b["n"]):
                w = np.random.Generator(np.random.Philox(key=[seed, int(h) & 0xFFFFFFFFFFFFFFFF])).poisson(n, repetitions)
                total += w * d
                weight += w
        yield pd.DataFrame({"rep": np.arange(repetitions), "total": total, "weight": weight})

    ship(diffs.sparkSession)
    counted = diffs.where("diff IS NOT NULL").groupBy(F.col("diff").cast("double").alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.select(F.xxhash64("diff").alias("h"), "diff", "n").mapInPandas(run, "rep int, total double, weight double")
    means = parts.groupBy("rep").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m")).where("m IS NOT NULL")
    tail = (1 - level) / 2
    return means.agg(F.expr(f"percentile(m, {tail})").alias("low"), F.expr(f"percentile(m, {1 - tail})").alias("high"))


#: Runs that ``run_pairs`` compares at most; a task holds four matrices of that many rows and columns.
RUNS = 2000


def run_pairs(rows: DataFrame, metric: str, run: str = "model") -> DataFrame:
    """``first, second, n, mean_difference, wins, losses, ties`` (second less first) for all pairs of runs in order of name, over
    ids that both answered, the last answer of each counting.

    No pair of answers is ever a row: the answers to one id, at most one for each run, meet in one row, and each task
    adds them into matrices of runs by runs, of which it sends the cells it met.
    """
    kind = rows.schema[metric].dataType.typeName()
    keyed = rows.withColumn("id", read_id("id")).where(F.col("id").isNotNull() & F.col(run).isNotNull())
    value = percent_value(metric, kind)
    last = first_of(keyed.select("id", F.col(run).alias("run"), "row_seq", "status", "error", value.alias("v")), ["id", "run"], "row_seq", last=True)
    good = last.where(successful() & F.col("v").isNotNull() & ~F.isnan("v"))
    names = [r[0] for r in rows.select(run).where(F.col(run).isNotNull()).distinct().orderBy(run).limit(RUNS + 1).collect()]
    if len(names) > RUNS:
        raise ValueError(f"more than {RUNS} runs")
    index = F.create_map(*[F.lit(x) for i, m in enumerate(names) for x in (m, i)]) if names else F.lit(None).cast("map<string,int>")
    lists = good.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(index[F.col("run")].alias("r"), "v"))).alias("answers"))  # at most one for each run

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, wins, losses = (np.zeros((len(names), len(names))) for _ in range(4))
        for b in batches:
            for answers in b["answers"]:
                at, v = np.array([a["r"] for a in answers]), np.array([a["v"] for a in answers], float)
                cells, diff = np.ix_(at, at), v[None, :] - v[:, None]
                n[cells] += 1
                total[cells] += diff
                wins[cells] += diff > 0
                losses[cells] += diff < 0
        i, j = np.nonzero(np.triu(n, 1))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j].astype(np.int64), "total": total[i, j], "wins": wins[i, j].astype(np.int64), "losses": losses[i, j].astype(np.int64)})

    ship(rows.sparkSession)
    parts = lists.select("answers").mapInPandas(add, "i int, j int, n bigint, total double, wins bigint, losses bigint")
    name = F.array(*[F.lit(m) for m in names]) if names else F.array().cast("array<string>")
    out = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "total", "wins", "losses")])
    return out.select(F.get(name, F.col("i")).alias("first"), F.get(name, F.col("j")).alias("second"), "n", (F.col("total") / F.col("n")).alias("mean_difference"), "wins", "losses", (F.col("n") - F.col("wins") - F.col("losses")).alias("ties"))


def separability(cards: DataFrame, metrics: Sequence[tuple[str, float]]) -> DataFrame:
    """``metric, n_values, spread, unit, separable`` over scorecards of several runs: a metric separates them if
    its spread exceeds one step of its scale (the unit over the smallest run's denominator)."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 6).alias("value"), F.col("n_" + m).alias("n"), F.lit(u).alias("scale")) for m, u in metrics])).alias("r")
    tall = cards.select(rows).select("r.*")
    found = tall.groupBy("metric").agg(F.count_distinct("value").alias("n_values"), F.round(F.max("value") - F.min("value"), 6).alias("spread"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("n"), F.max("scale").alias("scale"))
    unit = F.round(F.col("scale") / F.coalesce("n", F.lit(1)), 6)
    return found.select("metric", "n_values", "spread", unit.alias("unit"), F.coalesce((F.col("n_values") > 1) & (F.col("spread") > unit), F.lit(False)).alias("separable"))


def deltas(cards: DataFrame, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """``metric, delta``: the second run's value less the first's where both have one."""
    values = lambda which: [F.max(F.when(F.col("model") == which, F.col(m))) for m in metrics]
    wide = cards.agg(*[(b - a).alias(m) for m, a, b in zip(metrics, values(first), values(second))])
    return wide.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m) for m in metrics]))).alias("metric", "delta"))


def agreement(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """Counts and rates of a detector against gold labels; rows without either take no part."""
    g, d = F.col(gold), F.col(found)
    counts = rows.where(g.isNotNull() & d.isNotNull()).agg(F.count_if(g & d).alias("tp"), F.count_if(~g & d).alias("fp"), F.count_if(g & ~d).alias("fn"), F.count_if(~g & ~d).alias("tn"))
    part = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 2)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("tp", "fp", "fn", "tn", part(tp, tp + fn).alias("recall_pct"), part(tp, tp + fp).alias("precision_pct"), part(tp + tn, tp + fp + fn + tn).alias("agreement_pct"))


def gold_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: a detector against gold labels, beside a classifier's contrast, what suppression hides, and what the
    mechanism cannot see. ``rows``: gold, detected, fired (with or without counting), classified (probability of leakage or
    NULL), invisible (all of the row's markers lie in both lexicons). A missing gold label reads as none."""
    g, d, p = F.coalesce("gold", F.lit(False)), F.coalesce("detected", F.lit(False)), F.col("classified") >= threshold
    fired, unseen = F.coalesce("fired", F.lit(False)), F.coalesce("invisible", F.lit(False))
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(g & d).alias("tp"), F.count_if(g & ~d).alias("fn"), F.count_if(~g & d).alias("fp"), F.count_if(~g & ~d).alias("tn"), F.count_if(g & p).alias("classifier_tp"), F.count_if(g & ~p).alias("classifier_fn"),
        F.count_if(~g & p).alias("classifier_fp"), F.count_if(~g & ~p).alias("classifier_tn"), F.count_if(~g & fired).alias("nonleaking_fired"), F.count_if(~g & fired & ~d).alias("suppressed"), F.count_if(g & ~d & unseen).alias("wholly_invisible_misses"),
        F.count_if(~g & unseen).alias("nonleaking_with_invisible_markers"),
    )
    part = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 2)
    c = F.col
    return counts.select(
        "*", part(c("tp"), c("tp") + c("fn")).alias("recall_pct"), part(c("tp"), c("tp") + c("fp")).alias("precision_pct"), part(c("tp") + c("tn"), c("rows")).alias("agreement_pct"), part(c("classifier_tp"), c("classifier_tp") + c("classifier_fn")).alias("classifier_recall_pct"),
        part(c("classifier_tp"), c("classifier_tp") + c("classifier_fp")).alias("classifier_precision_pct"), part(c("tp"), c("tp") + c("nonleaking_fired")).alias("precision_without_suppression_pct"),
    )


def comparable(manifests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, comparable``: whether all runs share a field of their manifests."""
    rows = manifests.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f))).alias("value")) for f in fields])).alias("r")).select("r.*")
    return rows.groupBy("field").agg((F.count_distinct("value") <= 1).alias("comparable"))


def same_report(a: dict, b: dict, ignored: Sequence[str] = ("notes", "generated_at")) -> bool:
    """Whether two reports agree in all but their notes."""
    return {k: v for k, v in a.items() if k not in ignored} == {k: v for k, v in b.items() if k not in ignored}
