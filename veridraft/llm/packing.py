"""Items packed into containers of fixed capacity by minimum bin slack.

A container starts with the longest item left. Among the lengths that remain, subset sums are followed in
a bitset (an integer whose bit s says that a sum s can be reached) until one fills the container
exactly or all lengths are in, each as often as it is left; the fullest combination is removed and the
next container starts. The first candidates of a container are drawn from all lengths left, longest and
shortest alike; the other lengths follow where these do not fill it.

Items longer than a container are cut into full containers and a rest; no other item is cut. Items are
numbered when they are written and spread over groups of bounded size by a hash of that number, so a key or length
that holds a third of all rows is spread like any other. Each group is packed on its own: no task
sees more than a group and the only waste of grouping is one last container for each group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.session import RESERVED, ship, written

#: Items a group holds on average, and lengths tried first for one container.
GROUP, CANDIDATES = 16384, 40
#: Most kinds of containers.
KINDS = 100


def pack(lengths: Sequence[int], capacity: int) -> np.ndarray:
    """The container number of each item, none longer than ``capacity``. Items of length 0 join the first
    container."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and lengths.max(initial=0) > capacity:
        raise ValueError("an item is longer than the container")
    place = np.zeros(len(lengths), np.int64)
    left: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable"):
        if lengths[i] > 0:
            left.setdefault(int(lengths[i]), []).append(int(i))
    keys = sorted(left)  # ascending; emptied lengths are dropped
    number, rest = 0, int(lengths.sum())
    mask = (1 << (capacity + 1)) - 1
    while keys:
        first = keys[-1]
        chosen = [first]
        room = capacity - first
        rest -= first
        if rest <= room:
            chosen += [size for size in keys for _ in range(len(left[size]) - (size == first))]
        elif room >= keys[0]:
            top = bisect_right(keys, room)
            if top > CANDIDATES:
                half = CANDIDATES // 2
                spread = {int(x) for x in np.linspace(0, top - 1, CANDIDATES - half)} | set(range(top - half, top))
                picked = chain(sorted(spread, reverse=True), (i for i in range(top - 1, -1, -1) if i not in spread))
            else:
                picked = range(top - 1, -1, -1)
            reach, steps = 1, []
            full = 1 << room
            limit = mask >> (capacity - room)
            for at in picked:
                size = keys[at]
                copies, step = min(len(left[size]) - (size == first), room // size), 1
                while copies > 0 and not reach & full:  # 1, 2, 4, ... copies and the rest make any number of them
                    step = min(step, copies)
                    steps.append((size, step, reach))
                    reach |= (reach << size * step) & limit
                    copies -= step
                    step *= 2
                if reach & full:
                    break
            best = reach.bit_length() - 1
            for size, step, before in reversed(steps):
                if not before >> best & 1:
                    chosen += [size] * step
                    best -= size * step
        for size in chosen:
            items = left[size]
            place[items.pop()] = number
            if not items:
                del left[size]
                keys.pop(bisect_left(keys, size))
        rest -= sum(chosen) - first
        number += 1
    return place


def placed(items: DataFrame, key: str, size: str, containers: DataFrame, kind: str, capacity: str, group: int = GROUP) -> DataFrame:
    """One row for each part of each item and kind of container: ``container_kind``, ``container_id``
    (unique within its kind), ``key``, ``part`` from 0, ``first_token``, ``n_tokens``, ``capacity_tokens``.

    An item without a key is packed like any other. One without a size, or with a size below 0, comes out once for each
    kind with neither container nor tokens (NULL); an item of size 0 takes part as one part. Repeated rows are items of
    their own. An empty table gives an empty table. ``containers`` is a small dimension table of at most ``KINDS`` rows,
    which is checked.
    """
    spark = items.sparkSession
    ship(spark)
    every = written(items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"), F.monotonically_increasing_id().alias(RESERVED + "n")), "sizes")
    rows = every.where("size >= 0")
    groups = max(1, -(-rows.count() // group))
    rows = rows.select("key", "size", F.pmod(F.xxhash64(RESERVED + "n"), F.lit(groups)).alias(RESERVED + "g"))
    kinds = containers.where(F.col(capacity) > 0).select(F.col(kind).cast("string").alias("kind"), F.col(capacity).cast("long").alias("capacity")).distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    each = F.array(*[F.struct(F.lit(k["kind"]).alias("kind"), F.lit(k["capacity"]).cast("bigint").alias("capacity")) for k in kinds]) if kinds else F.array().cast("array<struct<kind:string,capacity:bigint>>")
    spread = rows.select("*", F.inline(each))  # each item once for each kind
    unsized = every.where("size IS NULL OR size < 0").select("key", F.inline(each))

    key_type = items.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity"].iloc[0])
        sizes = pdf["size"].to_numpy()
        full = np.maximum(0, -(-sizes // cap) - 1)  # whole containers of an item, its rest apart
        rest = sizes - full * cap
        place = pack(rest, cap)
        used = int(place.max(initial=-1)) + 1
        n = full + 1
        row = np.repeat(np.arange(len(pdf)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        is_rest = part == full[row]
        ids = np.empty(len(row), np.int64)
        ids[is_rest] = place
        ids[~is_rest] = used + np.arange((~is_rest).sum())
        return pd.DataFrame(
            {
                "container_kind": pdf["kind"].iloc[0], "container_id": ids * groups + int(pdf[RESERVED + "g"].iloc[0]), "key": pdf["key"].to_numpy()[row], "part": part.astype(np.int32),
                "first_token": part * cap, "n_tokens": np.where(is_rest, rest[row], cap), "capacity_tokens": cap,
            }
        )

    out = spread.groupBy("kind", RESERVED + "g").applyInPandas(
        run, f"container_kind string, container_id bigint, key {key_type}, part int, first_token bigint, n_tokens bigint, capacity_tokens bigint"
    )
    none = F.lit(None).cast("bigint")
    left = unsized.select(F.col("kind").alias("container_kind"), none.alias("container_id"), "key", F.lit(0).alias("part"), none.alias("first_token"), none.alias("n_tokens"), F.col("capacity").alias("capacity_tokens"))
    return out.unionByName(left).withColumnRenamed("key", key)


def containers_of(parts: DataFrame) -> DataFrame:
    """Each container with its parts, tokens and unused space; parts without a container are none."""
    used = parts.where("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("used_tokens"))
    return used.withColumn("unused_tokens", F.col("capacity_tokens") - F.col("used_tokens"))
