"""Percentiles with a guaranteed relative error, from counts in signed logarithmic buckets.

With error bound ``a`` let ``g = (1 + a) / (1 - a)``. A value x > 0 falls into bucket
``ceil(ln x / ln g)``, whose values all lie within the factor ``1 ± a`` of ``2 g^b / (1 + g)``; negative
values mirror that, zero has a bucket of its own. A sketch is a table of counts for each group and
bucket: sketches of partitions or days are joined by adding counts, exactly. The percentile at q
interpolates linearly between the two order statistics around rank ``q (n - 1)``; for values of one
sign an interpolation of estimates within ``1 ± a`` is itself within ``1 ± a`` of the exact one.

Counting is a hash aggregate with map-side combine, so a group with a third of all rows ships one
row for each of its buckets and map task. A double has fewer than 750 / ln g buckets a sign, which
bounds every group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridraft.session import RESERVED

DEFAULT_ERROR = 0.01
PERCENTILES = (50, 90, 95, 99)

BUCKET, COUNT = "bucket", "bucket_count"


def valid_measure(column: Column | str) -> Column:
    """What row validation accepts as a number: finite and not negative."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf")))


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the error bound must lie between 0 and 1")
    return (1 + error) / (1 - error)


#: Bucket ordinals of positive values are shifted by this, so that 0 is the bucket of zero and
#: ordinals sort as values do. ln of the smallest double is about -745.
def _shift(error: float) -> int:
    return math.ceil(746 / math.log(_gamma(error))) + 1


def bucket_of(column: Column | str, error: float = DEFAULT_ERROR) -> Column:
    """The signed bucket ordinal of a finite value, ascending with the value."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    index = F.ceil(F.log(F.abs(x)) / F.lit(math.log(_gamma(error)))) + F.lit(_shift(error))
    return F.when(x == 0, F.lit(0)).when(x > 0, index).otherwise(-index).cast("int")


def bucket_value(bucket: Column | str, error: float = DEFAULT_ERROR) -> Column:
    """The estimate that stands for all values of a bucket."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    gamma = _gamma(error)
    size = F.pow(F.lit(gamma), F.abs(b) - F.lit(_shift(error))) * F.lit(2 / (1 + gamma))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * size)


def sketch(df: DataFrame, value: str, by: Sequence[str | Column], error: float = DEFAULT_ERROR, keep: Column | None = None) -> DataFrame:
    """Counts for each group and bucket. ``keep`` says which values count (finite ones always must);
    by default those that row validation accepts. Null groups are groups."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.where(finite & (valid_measure(value) if keep is None else keep))
    return rows.groupBy(*by, bucket_of(value, error).alias(BUCKET)).agg(F.count(F.lit(1)).alias(COUNT))


def merge(*sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of the same error bound joined: matching bucket counts are added."""
    out = sketches[0].select(*by, BUCKET, COUNT)
    for other in sketches[1:]:
        out = out.unionByName(other.select(*by, BUCKET, COUNT))
    return out.groupBy(*by, BUCKET).agg(F.sum(COUNT).alias(COUNT))


def percentiles(sketched: DataFrame, by: Sequence[str], qs: Sequence[float] = PERCENTILES, error: float = DEFAULT_ERROR, decimals: int | None = 4) -> DataFrame:
    """One row for each group: ``n``, ``p<q>`` for each q and ``relative_error``. No rows, no groups."""
    merged = merge(sketched, by=by)
    ordered = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    upto, total = RESERVED + "upto", RESERVED + "total"
    ranked = merged.withColumn(upto, F.sum(COUNT).over(ordered)).withColumn(total, F.sum(COUNT).over(Window.partitionBy(*by)))
    aggs = [F.max(total).alias("n")]
    for i, q in enumerate(qs):
        rank = (F.col(total) - 1) * F.lit(q / 100)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.min(F.when(F.col(upto) > at, F.col(BUCKET))).alias(f"{RESERVED}{side}{i}"))
    found = ranked.groupBy(*by).agg(*aggs)
    out = [F.col(c) for c in by] + [F.col("n")]
    for i, q in enumerate(qs):
        lo, hi = (bucket_value(f"{RESERVED}{s}{i}", error) for s in ("lo", "hi"))
        rank = (F.col("n") - 1) * F.lit(q / 100)
        x = lo + (hi - lo) * (rank - F.floor(rank))
        out.append((F.round(x, decimals) if decimals is not None else x).alias(f"p{q:g}".replace(".", "_")))
    return found.select(*out, F.lit(error).alias("relative_error"))


def exact_percentiles(df: DataFrame, value: str, by: Sequence[str], qs: Sequence[float] = PERCENTILES, error: float = DEFAULT_ERROR) -> DataFrame:
    """``by, p<q>``: exact interpolated percentiles of each group's valid values, in two passes. The sketch says in which
    buckets the order statistics lie and how many values come before; only values of those buckets, about one in a hundred of
    a group, are then counted and ordered, so no task holds a group's values however hot it is. Groups without values have
    no row; null groups are groups."""
    named = [F.col(c).alias(f"{RESERVED}g{i}") for i, c in enumerate(by)]
    groups = [f"{RESERVED}g{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    rows = df.where(valid_measure(value)).select(*named, x.alias("v"), bucket_of(value, error).alias(BUCKET))
    counts = rows.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias(COUNT))
    upto = F.sum(COUNT).over(Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*groups, BUCKET, COUNT, upto.alias("upto"), F.sum(COUNT).over(Window.partitionBy(*groups)).alias("total"))
    ranks = [f((F.col("total") - 1) * F.lit(q / 100)) for q in qs for f in (F.floor, F.ceil)]
    holds = [(r >= F.col("upto") - F.col(COUNT)) & (r < F.col("upto")) for r in ranks]
    some = holds[0]
    for h in holds[1:]:
        some = some | h
    wanted = ranked.where(some).select(*groups, BUCKET, (F.col("upto") - F.col(COUNT)).alias("before"), "total")
    same = [F.col("w." + g).eqNullSafe(F.col("r." + g)) for g in groups] + [F.col("w." + BUCKET) == F.col("r." + BUCKET)]
    met = rows.alias("r").join(wanted.alias("w"), same).select(*["r." + g for g in groups], "r." + BUCKET, "v", "before", "total")
    values = met.groupBy(*groups, BUCKET, "before", "total", "v").agg(F.count(F.lit(1)).alias("n"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*groups, BUCKET).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("end", end)
    aggs = []
    for i, q in enumerate(qs):
        rank = (F.col("total") - 1) * F.lit(q / 100)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.max(F.when((at >= F.col("end") - F.col("n")) & (at < F.col("end")), F.col("v"))).alias(f"{side}{i}"))
    found = placed.groupBy(*groups).agg(F.max("total").alias("total"), *aggs)
    out = [F.col(g).alias(c) for g, c in zip(groups, by)]
    for i, q in enumerate(qs):
        rank = (F.col("total") - 1) * F.lit(q / 100)
        out.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank - F.floor(rank))).alias(f"p{q:g}".replace(".", "_")))
    return found.select(*out)
