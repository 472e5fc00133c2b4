"""Sources mixed to target weights by entropy balancing.

For each mix the documents of a source get rates ``w = min(cap, exp(l t))`` (t: tokens over the source's
mean) whose expected tokens meet the source's target exactly and which are otherwise as even as
they can be: ``l`` solves the convex dual of the minimum-entropy problem. Newton's method runs distributed;
each iteration is one aggregate over the histogram of (source, tokens) for all mixes and sources at once, with
only the multipliers, one for each row of the targets, on the driver. The histogram has a row for each distinct length of
a source, whatever the number of documents; where it has at most ``HISTOGRAM`` rows (counted first) the steps run on
it in the driver, beyond that as one job each. Rates become copies by systematic rounding inside buckets of bounded
size, and what rounding leaves over is mended by single documents, chosen by their row number, whose lengths fit
the difference.

The total of a mix is the largest that every source can reach within its cap, times ``fill``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridraft.session import RESERVED, written

#: Share of the largest feasible total that a mix takes unless told otherwise.
FILL = 1.0
#: Newton iterations, relative tolerance, documents of a rounding bucket, mends of each (mix, source).
ITERATIONS, TOLERANCE, BUCKET, MENDS = 60, 1e-9, 50_000, 32
#: Documents of each length band that mends may choose from.
CHOICES = 8
#: Rows of targets at most, and of a histogram that is solved in the driver (16 bytes each).
TARGETS, HISTOGRAM = 10_000, 1_000_000


def _wanted(targets: DataFrame) -> list:
    """The rows of the targets that ask for something, of which there may be ``TARGETS``."""
    rows = targets.where("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL AND mix_id IS NOT NULL").select("mix_id", "source", "target_share", "max_repeats").limit(TARGETS + 1).collect()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} rows of targets")
    return rows


def _steps(counts: DataFrame, cells: dict, few: bool):
    """A function from open cells to what they get at their multipliers: {cell: (tokens, slope)}."""
    spark = counts.sparkSession
    if few:
        held = counts.toPandas()  # at most HISTOGRAM rows, counted before
        by = {s: (g["n_tokens"].to_numpy(float), g["n"].to_numpy(float)) for s, g in held.groupby("source")}

        def near(open_cells: list) -> dict:
            out = {}
            for m, s, cap, mean, l in open_cells:
                tokens, n = by[s]
                w = np.minimum(cap, np.exp(np.minimum(l * tokens / mean, 50.0)))
                out[m, s] = float((n * w * tokens).sum()), float((n * np.where(w < cap, w, 0.0) * tokens * tokens / mean).sum())
            return out

        return near

    def far(open_cells: list) -> dict:
        table = spark.createDataFrame(open_cells, "mix_id string, source string, cap double, mean double, l double")
        rows = counts.join(F.broadcast(table), "source")  # at most TARGETS rows, checked
        t = F.col("n_tokens") / F.col("mean")
        w = F.least("cap", F.exp(F.least(F.col("l") * t, F.lit(50.0))))
        free = F.when(w < F.col("cap"), w).otherwise(0.0)
        found = rows.groupBy("mix_id", "source").agg(F.sum(F.col("n") * w * F.col("n_tokens")).alias("got"), F.sum(F.col("n") * free * F.col("n_tokens") * t).alias("slope"))
        return {(r["mix_id"], r["source"]): (r["got"], r["slope"]) for r in found.collect()}

    return far


def plan(sizes: DataFrame, targets: DataFrame, fill: float = FILL, histogram: int = HISTOGRAM) -> dict[tuple[str, str], dict]:
    """For each (mix, source) its cap, target tokens, mean tokens and multiplier. ``sizes``: source,
    n_tokens; ``targets``: mix_id, source, target_share, max_repeats (at most ``TARGETS`` rows). A mix that names a source
    without tokens cannot hold its shares; such sources are left out, the others keep their shares of the rest, and
    ``shares`` reports 0 for them. Shares or caps of nothing ask for nothing."""
    if not 0 < fill <= 1:
        raise ValueError("fill must lie between 0 and 1")
    wanted = _wanted(targets)
    counts = written(sizes.where("n_tokens > 0").join(targets.select("source").distinct(), "source", "left_semi").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    have = {r["source"]: r for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lengths")).collect()}  # sources of the targets
    cells = {}
    for r in wanted:
        if r["source"] in have:
            cells[r["mix_id"], r["source"]] = {"cap": int(r["max_repeats"]), "share": float(r["target_share"]), "tokens": int(have[r["source"]]["tokens"]), "docs": int(have[r["source"]]["docs"])}
    for mix in {m for m, _ in cells}:
        own = [c for (m, _), c in cells.items() if m == mix]
        total = fill * min(c["cap"] * c["tokens"] / c["share"] for c in own)
        for c in own:
            c["target"] = total * c["share"]
            c["mean"] = c["tokens"] / c["docs"]
            full = c["target"] >= c["cap"] * c["tokens"] * (1 - TOLERANCE)  # every document as often as it may
            c["l"] = math.inf if full else math.log(max(c["target"] / c["tokens"], 1e-12))
            c["low"], c["high"], c["done"] = -math.inf, math.inf, full
    step_of = _steps(counts, cells, sum(r["lengths"] for r in have.values()) <= histogram)
    for _ in range(ITERATIONS):
        open_cells = [(m, s, float(c["cap"]), c["mean"], c["l"]) for (m, s), c in cells.items() if not c["done"]]
        if not open_cells:
            break
        for cell, (got, slope) in step_of(open_cells).items():
            c = cells[cell]
            miss = got - c["target"]
            if abs(miss) <= TOLERANCE * c["target"]:
                c["done"] = True
                continue
            c["low"], c["high"] = (c["low"], c["l"]) if miss > 0 else (c["l"], c["high"])
            step = c["l"] - miss / slope if slope > 0 else math.nan
            if not c["low"] < step < c["high"]:  # Newton left the bracket: halve it, or widen it where it is open
                if math.isinf(c["low"]):
                    step = c["high"] - max(1.0, abs(c["high"]))
                elif math.isinf(c["high"]):
                    step = c["low"] + max(1.0, abs(c["low"]))
                else:
                    step = (c["low"] + c["high"]) / 2
            c["l"] = step
    return cells


def selection(documents: DataFrame, targets: DataFrame, key: str = "doc_id", fill: float = FILL) -> DataFrame:
    """``mix_id, source, <key>, n_tokens, copies`` of every document that a mix takes, at most ``max_repeats``
    copies of each.

    ``documents``: key, source, n_tokens. Documents without a source, of sources no mix names, or without
    tokens are not taken. Repeated rows are documents of their own, a null key is a key. Empty tables give
    an empty selection.
    """
    spark = documents.sparkSession
    row = RESERVED + "row"
    docs = documents.where("source IS NOT NULL AND n_tokens > 0").select(F.col(key).alias("key"), "source", "n_tokens", F.monotonically_increasing_id().alias(row))
    docs = written(docs, "mixdocs")
    cells = plan(docs.select("source", "n_tokens"), targets, fill)
    rows = [(m, s, float(c["cap"]), c["mean"], min(c["l"], 1e9), c["target"], max(1, c["docs"] // BUCKET)) for (m, s), c in cells.items()]
    table = spark.createDataFrame(rows, "mix_id string, source string, cap double, mean double, l double, target double, buckets bigint")
    named = docs.join(F.broadcast(table), "source")  # at most TARGETS rows, checked
    rate = F.least("cap", F.exp(F.least(F.col("l") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))))
    draw = named.withColumn(RESERVED + "w", rate).withColumn(RESERVED + "b", F.pmod(F.xxhash64("mix_id", row), F.col("buckets")))
    along = Window.partitionBy("mix_id", "source", RESERVED + "b").orderBy("n_tokens", F.xxhash64(row, "mix_id"), row).rowsBetween(Window.unboundedPreceding, 0)
    # the whole part of the running total of rates, of which each document takes what it adds; rates
    # stay under the cap, so the half that is added never makes a document exceed it
    upto = F.sum(RESERVED + "w").over(along)
    copies = F.floor(upto + 0.5) - F.floor(upto - F.col(RESERVED + "w") + 0.5)
    taken = written(draw.withColumn("copies", F.least(copies, F.col("cap")).cast("int")).select("mix_id", "source", "key", "n_tokens", row, "copies", "cap", "target"), "drawn")
    changes = _mends(taken)
    table = spark.createDataFrame([(m, s, r, n) for (m, s, r), n in changes.items()], f"mix_id string, source string, {row} bigint, {RESERVED}change int")
    mended = taken.join(F.broadcast(table), ["mix_id", "source", row], "left").withColumn("copies", F.col("copies") + F.coalesce(RESERVED + "change", F.lit(0)))  # at most MENDS rows for each row of the targets
    return mended.where("copies > 0").select("mix_id", "source", F.col("key").alias(key), "n_tokens", "copies")


def _mends(taken: DataFrame) -> dict[tuple[str, str, int], int]:
    """Copies to add to or take from single documents, at most ``MENDS`` for each (mix, source), so that it comes nearer to
    its target. One pass finds what rounding left over, a second a few documents of each length band, by powers of two, to
    which a copy may be added or of which one may be taken; the change that leaves least is made, and again, which is
    arithmetic on few rows."""
    row = RESERVED + "row"
    state = taken.groupBy("mix_id", "source").agg((F.max("target") - F.sum(F.col("copies") * F.col("n_tokens"))).alias("miss")).collect()  # one row for each row of the targets
    band, part = F.floor(F.log2("n_tokens")).alias("band"), F.pmod(F.xxhash64(row), F.lit(CHOICES)).alias("part")
    best = lambda room: F.min_by(F.when(room > 0, F.struct(row, "n_tokens", room.cast("int").alias("room"))), F.when(room > 0, F.col(row)))
    picked = taken.groupBy("mix_id", "source", band, part).agg(best(F.col("cap") - F.col("copies")).alias("more"), best(F.col("copies")).alias("less"))
    found: dict[tuple[str, str], dict[tuple[int, int], list[int]]] = {}
    for r in picked.collect():  # at most 64 * CHOICES for each row of the targets
        for sign, d in ((1, r["more"]), (-1, r["less"])):
            if d:
                found.setdefault((r["mix_id"], r["source"]), {})[sign, d[row]] = [d["n_tokens"], d["room"]]
    changes: dict[tuple[str, str, int], int] = {}
    for r in state:
        miss, usable = r["miss"], found.get((r["mix_id"], r["source"]), {})
        for _ in range(MENDS):
            at = min(usable, key=lambda x: (abs(miss - x[0] * usable[x][0]), x), default=None)
            if at is None or abs(miss - at[0] * usable[at][0]) >= abs(miss):
                break
            changes[r["mix_id"], r["source"], at[1]] = changes.get((r["mix_id"], r["source"], at[1]), 0) + at[0]
            miss -= at[0] * usable[at][0]
            usable[at][1] -= 1
            if not usable[at][1]:
                del usable[at]
    return changes


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """What each mix holds: target and actual share of tokens, tokens, documents and most copies."""
    got = selected.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    every = targets.join(got, ["mix_id", "source"], "left")
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return every.select("mix_id", "source", "target_share", (F.coalesce("tokens", F.lit(0)) / total).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
