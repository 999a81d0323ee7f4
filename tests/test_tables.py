"""Tables that change in one step."""
import pytest
from pyspark.sql import functions as F

from tidegauge.session import scratch
from tidegauge.sources import tables


def rows(df):
    return sorted(((r.part, r.key, r.value) for r in df.collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, "part string, key int, value double")


OLD = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), (None, 1, 4.0)]


@pytest.mark.parametrize("step", ["stage", "publish"])
@pytest.mark.parametrize("partition", [None, "part"])
def test_a_change_that_fails_leaves_the_old_rows(spark, monkeypatch, step, partition):
    path = scratch(spark, "table")
    tables.replace_table(frame(spark, OLD), path, partition)

    def lost(*a, **kw):
        if step == "stage":
            a[0].limit(1).write.mode("overwrite").parquet(f"{a[1]}/data/half")
        raise RuntimeError("lost")
    monkeypatch.setattr(tables, step, lost)
    with pytest.raises(RuntimeError):
        tables.replace_table(frame(spark, [("z", 9, 9.0)]), path, partition)
    if partition:
        with pytest.raises(RuntimeError):
            tables.upsert_table(path, frame(spark, [("a", 1, 9.0)]), ["key"])
    monkeypatch.undo()
    assert rows(tables.read_table(spark, path)) == sorted(OLD, key=str)
    tables.replace_table(frame(spark, [("z", 9, 9.0)]), path, partition)
    assert rows(tables.read_table(spark, path)) == [("z", 9, 9.0)]


def test_upserts_rewrite_touched_partitions(spark):
    path = scratch(spark, "table")
    tables.replace_table(frame(spark, OLD), path, "part")
    tables.upsert_table(path, frame(spark, [("a", 2, None), ("a", 3, 7.0), ("c", 1, 8.0)]), ["key"])
    tables.upsert_table(path, frame(spark, [(None, 1, 5.0), ("c", 2, 9.0)]), ["key"])
    want = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 7.0), ("b", 1, 3.0), ("c", 1, 8.0), ("c", 2, 9.0), (None, 1, 4.0), (None, 1, 5.0)]      # null matches no key
    assert rows(tables.read_table(spark, path)) == sorted(want, key=str)
    manifest = spark.read.schema(tables.MANIFEST).json(f"{path}/manifest")
    first = manifest.where("version = 1").select("folder").first()[0]
    assert [r[0] for r in manifest.where("version = 3").where(F.col("folder") == first).select("part").collect()] == ["b"]


def test_without_rows(spark):
    for partition in (None, "part"):
        path = scratch(spark, "table")
        with pytest.raises(ValueError):
            tables.read_table(spark, path)
        tables.replace_table(frame(spark, []), path, partition)
        assert rows(tables.read_table(spark, path)) == [] and tables.read_table(spark, path).columns == ["part", "key", "value"]
    tables.upsert_table(path, frame(spark, [("a", 1, 1.0)]), ["key"])
    assert rows(tables.read_table(spark, path)) == [("a", 1, 1.0)]
