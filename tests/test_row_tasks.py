"""Steps on many well compressed rows: nothing sorted that need not be, and tasks of even size."""

from pyspark.sql import functions as F

from loadloom.operators import evaluate, residuals


def test_bias_lets_rows_pass_unsorted(spark):
    keys = [F.concat(F.lit("s"), F.col("id") % 5).alias("series_id"), F.concat(F.lit("m"), F.col("id") % 2).alias("model")]
    rows = spark.range(40).select(*keys, F.lit("test").alias("split"), F.lit(3.0).alias("y"),
                                  (F.col("id") * 1.0).alias("y_pred"))
    bias = rows.where("model = 'm1'").groupBy("series_id", "model").agg(F.min("y_pred").alias("bias"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluate.subtract_bias(rows, bias)
        got = sorted((r.series_id, r.model, r.y_pred) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    low = {}
    for i in range(40):
        low.setdefault((i % 5, i % 2), i if i % 2 else 0)
    assert got == sorted((f"s{i % 5}", f"m{i % 2}", float(i - low[i % 5, i % 2])) for i in range(40))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_lag_sums_keep_their_tasks(spark):
    rows = spark.range(30 * 50).select(F.concat(F.lit("s"), F.floor(F.col("id") / 50)).alias("series_id"),
                                       (F.col("id") % 50).alias("pos"), F.sin("id").alias("x"))
    out = residuals.lag_products(rows, "x", 3)
    out.collect()
    lines = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "FlatMapGroupsInPandas" in line)
    below = next(line for line in lines[at + 1:] if "Exchange" in line or "AQEShuffleRead" in line)
    assert "REPARTITION_BY_NUM" in below
    assert out.where("lag = 0 AND n = 50").count() == 30
