import pytest
from pyspark.sql import functions as F

from veridraft.operators.exactly_once import STRIPPED, SeenStore, deduplicate, read_id
from veridraft.plans.core_training import QUERIES
from veridraft.streaming.ingest import ingest

ROWS = [(1, "a", "m", "x"), (2, "a", "m", "y"), (3, "b", "m", "x"), (4, "a", "n", "z"), (5, None, "m", "q"), (6, None, "m", "q"), (7, "b", "m", "x")]
SCHEMA = "seq bigint, id string, model string, _vd_code string"  # the last name is one of the helpers'


def test_stripping_is_pythons():
    assert all(c.isspace() for c in STRIPPED)
    assert {chr(i) for i in range(0x110000) if chr(i).isspace()} == set(STRIPPED)


def test_read_id(spark):
    rows = [("  a\xa0",), ("\t\n",), ("",), (None,), ("b c",)]
    got = [r[0] for r in spark.createDataFrame(rows, "id string").select(read_id("id")).collect()]
    assert got == ["a", None, None, None, "b c"]


def test_one_of_each_and_all_anonymous(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(r["seq"] for r in deduplicate(df, ["id", "model"], ["seq"]).collect())
    assert got == [1, 3, 4, 5, 6]
    assert deduplicate(df, ["id", "model"], ["seq"]).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert deduplicate(df, ["id", "model"], ["seq"]).count() == 0


def test_batches_remember(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=3)
    first = store.ingest(df.where("seq <= 3"), ["id", "model"], ["seq"])
    assert sorted(r["seq"] for r in first.selected().collect()) == [1, 3]
    assert [tuple(r) for r in first.repeated().collect()] == [("a", "m")]
    again = SeenStore(spark, f"file://{tmp_path}/seen")  # another process
    assert again.shards == 3 and again.version == 1
    second = again.ingest(df.where("seq > 3"), ["id", "model"], ["seq"])
    assert [r["seq"] for r in second.selected().collect()] == [4]
    assert [tuple(r) for r in second.repeated().collect()] == [("b", "m")]
    codes = again.dictionary()
    assert codes.count() == codes.select("_vd_shard", "_vd_code").distinct().count() == 3
    set_bits = again.bitmaps().select(F.sum(F.bitmap_count("bits"))).head()[0]
    assert set_bits == 3


def test_failed_batch_can_be_repeated(spark, tmp_path):
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    df = spark.createDataFrame(ROWS, SCHEMA)
    commit, store._commit = store._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.ingest(df, ["id", "model"], ["seq"])
    store._commit = commit
    assert store.version == 0
    assert store.ingest(df, ["id", "model"], ["seq"]).selected().count() == 3


def test_hot_identifier_and_ties(spark):
    df = spark.range(20_000).select(F.lit(0).cast("bigint").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    store = SeenStore(spark)
    result = store.ingest(df, ["id"], ["seq"])
    assert result.selected().count() == df.select("id").distinct().count()
    assert [r[0] for r in result.repeated().collect()] == ["hot"]


def test_whole_rows_of_ties_and_null_order(spark):
    rows = [(5, "a", "x"), (5, "a", "y"), (5, "a", "x"), (None, "b", "p"), (2, "b", "q"), (None, "c", "r"), (None, "c", "r"), (1, None, "s"), (1, None, "s")]
    df = spark.createDataFrame(rows, "seq bigint, id string, `a.b` string")
    got = deduplicate(df, ["id"], ["seq"])
    assert got.columns == df.columns
    kept = sorted(got.collect(), key=str)
    assert sorted((r["id"], r["seq"]) for r in kept if r["id"]) == [("a", 5), ("b", None), ("c", None)]
    assert {r["a.b"] for r in kept if r["id"] == "a"} < {"x", "y"} and [r["a.b"] for r in kept if r["id"] == "b"] == ["p"]
    assert len(kept) == 5  # both rows without an identifier stay
    again = deduplicate(df.repartition(3), ["id"], ["seq"])
    assert sorted(again.collect(), key=str) == kept


def test_whole_rows_in_batches(spark, tmp_path):
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=3)
    df = spark.createDataFrame([(None, "a", {"k": 1}), (None, "a", {"k": 1})], "seq bigint, id string, m map<string,int>")
    assert deduplicate(df, ["id"], ["seq"], store).count() == 1
    assert deduplicate(df, ["id"], ["seq"], store).count() == 0


def test_stream_of_ties_and_null_order(spark, tmp_path):
    spark.createDataFrame([(7, "a", "x"), (7, "a", "x"), (None, "b", "y"), (None, "b", "y")], "seq bigint, id string, t string").write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("seq bigint, id string, t string").parquet(f"{tmp_path}/in")
    ingest(stream, ["id"], ["seq"], f"file://{tmp_path}/seen", lambda rows, n: got.extend(rows.collect()), f"{tmp_path}/cp", {"availableNow": True}).awaitTermination(100)
    assert sorted(map(tuple, got), key=str) == [(7, "a", "x"), (None, "b", "y")]


def test_registered_whole_rows(spark):
    kept, rows = (QUERIES[n](spark, "/root/testdata/sf0.001") for n in ("p2_kept", "p2_rows"))
    named = rows.where("id IS NOT NULL AND model IS NOT NULL")
    assert sorted(map(tuple, named.select("tab", "id", "model", "row_seq").collect())) == sorted(map(tuple, kept.select("tab", "id", "model", "row_seq").collect()))
    assert "content" in rows.columns


def test_versions_are_cleaned_and_compacted(spark, tmp_path, monkeypatch):
    from veridraft.operators import exactly_once

    monkeypatch.setattr(exactly_once, "COMPACT", 3)
    store = SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    for n in range(6):
        ids = spark.createDataFrame([(n, f"i{n}"), (n, "i0"), (n, f"j{n}")], "seq bigint, id string")
        again = [r["id"] for r in store.ingest(ids, ["id"], ["seq"]).repeated().collect()]
        assert again == ["i0"]
    assert store.dictionary().count() == 12 and len(store.parts) < 3
    versions = sorted(p.name for p in (tmp_path / "seen").iterdir() if p.name.startswith("v"))
    assert "v1" not in versions and {"v5", "v6"} <= set(versions)
    assert SeenStore(spark, f"file://{tmp_path}/seen").bitmaps().select(F.sum(F.bitmap_count("bits"))).head()[0] == 12
