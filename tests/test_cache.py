import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.sources import cache


def table(spark, days):
    return to_spark(spark, hourly_pandas(days, ("s",))).select(F.col("ts").alias("timestamp"), "load")


def load(spark, path, days, **options):
    return cache.load_or_build(spark, path, lambda: table(spark, days), {"days": days}, **options)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_reader_keeps_its_version(spark, tmp_path, fmt):
    path = str(tmp_path / "data")
    old = load(spark, path, 3, fmt=fmt)
    new = load(spark, path, 5, fmt=fmt)
    assert (old.count(), new.count()) == (72, 120)
    assert [e["version"] for e in cache.published(spark, path)] == [2, 1]
    assert load(spark, path, 5, fmt=fmt).inputFiles() == new.inputFiles()


def test_a_failing_build_leaves_the_version_before_it(spark, tmp_path):
    path = str(tmp_path / "data")
    good = load(spark, path, 3)

    def fails():  # breaks in a task, after other tasks have written
        return table(spark, 5).repartition(4).withColumn("load", F.when(
            F.col("timestamp") > "2024-01-05", F.raise_error("lost").cast("double")).otherwise(F.col("load")))

    with pytest.raises(Exception, match="lost"):
        cache.load_or_build(spark, path, fails, {"days": 5})
    assert [e["settings"] for e in cache.published(spark, path)] == [{"days": 3}]
    assert sorted(map(tuple, load(spark, path, 3).collect())) == sorted(map(tuple, good.collect()))


def test_damaged_lines_and_lost_folders(spark, tmp_path):
    path = str(tmp_path / "data")
    first = load(spark, path, 3)
    (pathlib.Path(path) / cache.VERSIONS / "part-torn.txt").write_text('{"version": 9, "fol\n[1]\n')
    assert load(spark, path, 3).inputFiles() == first.inputFiles()
    cache.publish(spark, path, {"folder": "table-gone", "format": "parquet", "settings": {"days": 3}, "rows": 72,
                                "schema": cache.published(spark, path)[0]["schema"]})
    again = load(spark, path, 3)  # the newest folder is missing, so a new version is built
    assert again.count() == 72 and again.inputFiles() != first.inputFiles()
    assert cache.published(spark, path)[0]["version"] == 3


def test_another_format_is_another_version(spark, tmp_path):
    path = str(tmp_path / "data")
    load(spark, path, 3)
    assert load(spark, path, 3, fmt="csv").count() == 72
    assert [e["format"] for e in cache.published(spark, path)] == ["csv", "parquet"]
