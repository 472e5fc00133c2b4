"""Exactly-once selection among messages that were delivered at least once.

Every distinct identifier gets an exact, dense code inside its shard (a dictionary, not a hash, so
two identifiers never share a code). What has been seen is kept as bitmaps of 32,768 bits, one row
for each (shard, bucket of codes), stored in zstd-compressed Parquet. For each batch of arrivals

1. copies inside the batch are combined map-side to one row for each identifier (count, first
   arrival), so one identifier with a third of all rows costs one row a map task;
2. known identifiers take their code from the dictionary, new ones the next codes of their shard;
3. an arrival is selected if the bit of its code is unset; everything else is rejected;
4. the new bits are united with the old ones in a new version of the state, which becomes current
   by a single rename. A batch that fails before the rename leaves the old version current and can
   be repeated.

A batch meets the dictionary in an inner join, in which a small batch is broadcast (under Spark's own size limit) and the
dictionary is only read; a large one is shuffled with it. Every ``COMPACT`` batches the parts of the dictionary become one;
what neither the current version nor the one before it needs, which a reader may still hold, is removed.

State and its shuffles hold identifiers and order columns only. Where whole rows are asked for
(``deduplicate``), one row of each identifier is chosen by an aggregate over the batch.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridraft.session import RESERVED, _fs, path_exists, remove_path, scratch_path

#: What Python's ``str.strip`` takes away, which is how row validation reads an identifier.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

SHARD, CODE, BUCKET, COPIES, FIRST, SEEN, ROW = (RESERVED + x for x in ("shard", "code", "bucket", "copies", "first", "seen", "row"))


def read_id(column: Column | str) -> Column:
    """An identifier as row validation reads it: text, stripped; blank is NULL."""
    text = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(STRIPPED))
    return F.when(text != "", text)


#: Parts of the dictionary from which they are made one.
COMPACT = 16


@dataclass
class BatchResult:
    """One batch: ``groups`` has a row for each identifier of the batch with its code, copies, first
    arrival and whether it had been seen before."""

    groups: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def selected(self) -> DataFrame:
        """(keys, order) of the one arrival kept for each identifier that is new."""
        return self.groups.where(~F.col(SEEN)).select(*self.keys, *[F.col(FIRST)[c].alias(c) for c in self.order])

    def repeated(self) -> DataFrame:
        """(keys) of which at least one arrival of this batch was rejected."""
        return self.groups.where(F.col(SEEN) | (F.col(COPIES) > 1)).select(*self.keys)


class SeenStore:
    """Versioned state in a shared folder: ``v<n>/dictionary``, ``v<n>/bitmaps`` and ``CURRENT``.

    ``shards`` spreads dictionary and bitmaps; it is fixed when the store is created and read back
    later. Null identifiers never enter the store.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "seen")
        self.shards = shards or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.version, self.parts = 0, []
        self._pending: tuple[int, list[str]] | None = None
        if path_exists(spark, f"{self.path}/CURRENT"):
            state = json.loads(spark.read.text(f"{self.path}/CURRENT").head()[0])
            self.version, self.shards, self.parts = state["version"], state["shards"], state["dictionary"]

    def dictionary(self) -> DataFrame | None:
        return self._read(self.parts) if self.parts else None

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def bitmaps(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{self.version}/bitmaps") if self.version else None

    def ingest(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], commit: bool = True) -> BatchResult:
        """Read one batch and commit it, or leave that to ``commit``. ``order``: columns of which the least arrival is kept; ties
        between equal order values keep one of the equal arrivals."""
        keys, order = tuple(keys), tuple(order)
        present = df
        for k in keys:
            present = present.where(F.col(k).isNotNull())
        groups = (
            present.select(*keys, *[c for c in order if c not in keys])
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias(COPIES), F.min(F.struct(*order)).alias(FIRST))
            .withColumn(SHARD, F.pmod(F.xxhash64(*keys), F.lit(self.shards)).cast("int"))
        )
        version = self.version + 1
        target = f"{self.path}/v{version}"
        if path_exists(self.spark, target):
            remove_path(self.spark, target)  # left by a batch that was never committed
        old = self.dictionary()
        within = Window.partitionBy(SHARD).orderBy(*keys)
        if old is None:
            coded = groups.withColumn(CODE, (F.row_number().over(within) - 1).cast("long")).withColumn(SEEN, F.lit(False))
        else:
            tops = old.groupBy(SHARD).agg(F.max(CODE).alias(RESERVED + "top"))
            known = old.select(*keys, F.col(CODE).alias(RESERVED + "old")).join(groups.select(*keys), list(keys))
            joined = groups.join(known, list(keys), "left").join(tops, SHARD, "left")
            fresh = F.col(RESERVED + "old").isNull()
            rank = F.row_number().over(Window.partitionBy(SHARD, fresh).orderBy(*keys))
            coded = joined.withColumn(CODE, F.coalesce(RESERVED + "old", F.coalesce(RESERVED + "top", F.lit(-1)) + rank).cast("long"))
            bits = self.bitmaps().select(SHARD, BUCKET, F.col("bits").alias(RESERVED + "bits"))
            coded = coded.withColumn(BUCKET, F.bitmap_bucket_number(CODE)).join(bits, [SHARD, BUCKET], "left")
            coded = coded.withColumn(SEEN, bit_is_set(RESERVED + "bits", CODE)).drop(RESERVED + "bits", RESERVED + "old", RESERVED + "top", BUCKET)
        coded.write.option("compression", "zstd").mode("overwrite").parquet(f"{target}/batch")
        coded = self.spark.read.schema(coded.schema).parquet(f"{target}/batch")

        new = coded.where(~F.col(SEEN))
        new.select(*keys, SHARD, CODE).write.option("compression", "zstd").parquet(f"{target}/dictionary")
        fresh_bits = new.groupBy(SHARD, F.bitmap_bucket_number(CODE).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(CODE)).alias("bits"))
        if self.version:
            fresh_bits = self.bitmaps().unionByName(fresh_bits).groupBy(SHARD, BUCKET).agg(F.bitmap_or_agg("bits").alias("bits"))
        fresh_bits.write.option("compression", "zstd").parquet(f"{target}/bitmaps")
        parts = [*self.parts, f"v{version}/dictionary"]
        if len(parts) >= COMPACT:
            self._read(parts).write.option("compression", "zstd").parquet(f"{target}/compacted")
            parts = [f"v{version}/compacted"]
        self._pending = version, parts
        if commit:
            self.commit()
        return BatchResult(coded.select(*keys, SHARD, CODE, COPIES, FIRST, SEEN), keys, order)

    def _clean(self, kept: set[str]) -> None:
        """Removes what neither the current version nor the one before it needs; ``kept``: parts of either's dictionary."""
        fs, root, _ = _fs(self.spark, self.path)
        for status in fs.listStatus(root):  # a folder for each version that still holds something
            name = status.getPath().getName()
            if not name.startswith("v") or not name[1:].isdigit() or int(name[1:]) >= self.version - 1:
                continue
            for child in fs.listStatus(status.getPath()):
                if f"{name}/{child.getPath().getName()}" not in kept:
                    fs.delete(child.getPath(), True)
            if not fs.listStatus(status.getPath()):
                fs.delete(status.getPath(), True)

    def commit(self) -> None:
        """Make the last batch's state current."""
        if self._pending:
            before = set(self.parts)
            self._commit(*self._pending)
            self._pending = None
            self._clean(before | set(self.parts))

    def _commit(self, version: int, parts: list[str]) -> None:
        fs, current, jvm = _fs(self.spark, f"{self.path}/CURRENT")
        pending = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT.{version}")
        out = fs.create(pending, True)
        out.write(bytearray(json.dumps({"version": version, "shards": self.shards, "dictionary": parts}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(pending, current, options)
        self.version, self.parts = version, parts


def bit_is_set(bitmap: str, code: str) -> Column:
    """Whether ``code``'s bit is set in the bitmap of its bucket; a missing bitmap has no bits."""
    position = F.bitmap_bit_position(code)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({code}) % 8 as int))")) != 0, F.lit(False))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keys`` and, as a struct, one whole row of each identifier: its least arrival by ``order``, NULL least of
    all. Among equal ones the least hash of the row decides, so a repeated batch chooses alike. Rows are combined
    map-side: an identifier with a third of all rows moves one row for each task."""
    named = {c: F.col(_quoted(c)) for c in df.columns}
    hashed = [named[f.name] for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*hashed))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*named.values()), rank).alias(ROW))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def accepted(df: DataFrame, result: BatchResult) -> DataFrame:
    """The rows of the batch ``df`` that its ``result`` keeps: one whole row of each new identifier, and every
    row without an identifier."""
    anonymous = F.lit(False)
    for k in result.keys:
        anonymous = anonymous | F.col(k).isNull()
    new = result.groups.where(~F.col(SEEN)).select(*result.keys)
    kept = first_rows(df.where(~anonymous), result.keys, result.order).join(new, list(result.keys), "left_semi")  # rows stay where they were grouped
    return kept.select(*[F.col(ROW).getField(c).alias(c) for c in df.columns]).unionByName(df.where(anonymous))


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], store: SeenStore | None = None) -> DataFrame:
    """The rows of ``df`` with exactly one arrival of each identifier, and every row without one.

    Null in any key: the row belongs to no identifier and is kept. Equal order values: one of the
    equal arrivals is kept; a NULL order value comes first. An empty table gives an empty table. Other columns
    pass through untouched, whatever their names; whole rows are moved once, one for each identifier and task.
    """
    store = store or SeenStore(df.sparkSession)
    return accepted(df, store.ingest(df, keys, order))
