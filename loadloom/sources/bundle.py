"""Export and load of a fitted forecaster with its scaler and settings."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .cache import read_manifest, write_manifest


def export_bundle(model: PipelineModel, scaler: DataFrame, config: dict, path: str,
                  bias: DataFrame | None = None) -> str:
    """Write model, scaler parameters, JSON settings and the bias (series_id, bias) below one folder."""
    config = {**config, "has_bias": bias is not None}
    if bias is not None:
        bias.select("series_id", "bias").write.mode("overwrite").parquet(f"{path}/bias")
    model.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    write_manifest(scaler.sparkSession, f"{path}/config", config)
    return path


def load_bundle(spark: SparkSession, path: str) -> dict:
    """The exported parts as ``{"model", "scaler", "config", "bias"}``; no bias is None."""
    config = read_manifest(spark, f"{path}/config")
    if config is None:
        raise FileNotFoundError(f"no bundle settings at {path}")
    return {
        "model": PipelineModel.load(f"{path}/model"),
        "scaler": spark.read.parquet(f"{path}/scaler"),
        "config": config,
        "bias": spark.read.parquet(f"{path}/bias") if config.get("has_bias") else None,
    }
