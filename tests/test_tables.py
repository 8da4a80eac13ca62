import random

import pytest
from pyspark.sql import functions as F

from mercata.operators import numbering, upsert
from mercata.sources import keyed

SCHEMA = "shop string, sku long, qty long"


def files_of(df):
    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def scanned(df):
    """Number of files that a scan opens, after pruning."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_an_upsert_reads_and_writes_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "levels")
    stored = spark.createDataFrame([(f"s{i % 5}", i, i) for i in range(300)], SCHEMA)
    keyed.create(stored, path, ["shop", "sku"], parts=16)
    schema = stored.schema
    before = keyed.read(spark, path, schema)
    old_files = files_of(before)
    assert before.count() == 300 and scanned(before) == len(old_files) == 16
    incoming = spark.createDataFrame([("s1", 1, 100), ("new", 1, 7)], SCHEMA)

    def merge(old, new):
        merge.read, merge.files = old.select(F.input_file_name()).distinct().count(), scanned(old)
        return upsert.replace_upsert(old, new, ["shop", "sku"])
    touched = keyed.upsert(incoming, path, ["shop", "sku"], merge, schema, parts=16)
    assert 1 <= len(touched) <= 2
    names = {f"{keyed.PART}={p}" for p in touched}
    assert merge.read <= merge.files == len(touched)
    after = keyed.read(spark, path, schema)
    kept = {f for f in old_files if f.split("/")[0] not in names}
    assert kept == {f for f in files_of(after) if f.split("/")[0] not in names}
    want = {(f"s{i % 5}", i): i for i in range(300)} | {("s1", 1): 100, ("new", 1): 7}
    assert {(r["shop"], r["sku"]): r["qty"] for r in after.collect()} == want
    # the same again changes nothing; nothing at all touches nothing
    keyed.upsert(incoming, path, ["shop", "sku"], merge, schema, parts=16)
    assert {(r["shop"], r["sku"]): r["qty"] for r in keyed.read(spark, path, schema).collect()} == want
    assert keyed.upsert(incoming.limit(0), path, ["shop", "sku"], merge, schema, parts=16) == []


def test_a_table_begins_with_its_first_upsert(spark, tmp_path):
    path = str(tmp_path / "fresh")
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], SCHEMA)
    assert keyed.read(spark, path, rows.schema).count() == 0
    keyed.upsert(rows, path, ["shop", "sku"], lambda old, new: old.unionByName(new), rows.schema, parts=4)
    assert keyed.read(spark, path, rows.schema).drop(keyed.PART).count() == 2


@pytest.mark.parametrize("n", [0, 1, 50_000])
def test_rows_are_numbered_over_the_whole_table(spark, n):
    """All keys have one long prefix, and some are equal."""
    keys = [f"common-prefix-{random.Random(i).randint(0, n):09d}" for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(7)
    got, total = numbering.numbered(rows, "key", "id")
    assert total == n
    want = [i for _, i in sorted((k, i) for i, k in enumerate(keys))]
    assert [r["id"] for r in got.orderBy("_n").collect()] == want
    assert got.agg(F.count_distinct("_n")).first()[0] == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_rows_replaced_whole_are_moved_once(spark, tmp_path):
    """As `upsert` does it, with one exchange and several files in a partition."""
    keys = ["shop", "sku"]
    old = spark.createDataFrame([(f"s{i % 50}", i, i) for i in range(3000)], SCHEMA)
    new = spark.createDataFrame([(f"s{i % 50}", i, -i) for i in range(1500, 4000)], SCHEMA)
    new = new.unionByName(spark.createDataFrame([("s0", 2000, 1), ("s0", 2000, 2)], SCHEMA))
    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    for rows in (old, new, new):
        assert keyed.replace(rows, once, keys, old.schema, parts=2) == keyed.upsert(
            rows, twice, keys, lambda a, b: upsert.replace_upsert(a, b, keys), old.schema, parts=2)
    got, want = keyed.read(spark, once, old.schema), keyed.read(spark, twice, old.schema)
    assert got.count() == want.count() == 4000 and got.exceptAll(want).count() == 0
    assert keyed.replace(new.limit(0), once, keys, old.schema, parts=2) == []

    def dealt(rows):
        return rows.withColumn("p", keyed.part_of(keys, 2))
    merged = upsert.replace_upsert(dealt(old), dealt(new), keys, where=["p"])
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning(") == 1
