"""The cells of the hourly grid are made by many tasks, however few bytes their series have."""

from pyspark.sql import functions as F

from loadloom.sources.grid import hourly_grid


def events(spark, series=40, days=30):
    rows = [(s, d * 24 * 3600, float(s + d)) for s in range(series) for d in range(0, days, 7)]
    rows += [(0, (days * 24 - 1) * 3600, 1.0), (1, 5 * 3600, None), (None, 7, 1.0), (2, None, 1.0)]
    made = spark.createDataFrame(rows, "user_id int, s long, value double")
    return made.select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value")


def test_cells_are_spread_over_tasks(spark):
    grid = hourly_grid(events(spark), "user_id")
    tasks = grid.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 40 * 720
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 20 * 720


def test_cells_pass_no_aggregation(spark):
    plan = hourly_grid(events(spark), "user_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Generate explode(sequence")]


def test_cells_equal_a_plain_grid(spark):
    source = events(spark, series=3)
    sums = {}
    for r in source.withColumn("hr", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)).collect():
        if r.user_id is not None and r.ts is not None:
            load, n = sums.get((str(r.user_id), r.hr), (0.0, 0))
            sums[str(r.user_id), r.hr] = load + (r.value or 0.0), n + 1
    for span in ("global", "series"):
        want = set()
        for s in "012":
            hours = [h for x, h in sums if span == "global" or x == s]
            lo, hi = min(hours), max(hours)
            want |= {(s, h - lo, hi - lo + 1, *sums.get((s, h), (0.0, 0))) for h in range(lo, hi + 1)}
        got = hourly_grid(source, "user_id", span=span).select("series_id", "pos", "n", "load", "n_obs").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
