"""Load a prepared table, or build it when the stored one does not fit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import read_hourly_csv, write_hourly_csv


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One-row JSON file."""
    text = json.dumps(manifest, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or None when there is none or it cannot be read."""
    try:
        row = spark.read.text(path).first()
        return json.loads(row["value"]) if row else None
    except (AnalysisException, ValueError):
        return None


VERSIONS = "versions"
_COMPLETE = {"version", "folder", "settings", "schema", "rows"}


def published(spark: SparkSession, path: str) -> list[dict]:
    """The versions published below ``path``, newest first; entries that cannot be read are left out."""
    try:
        rows = spark.read.text(f"{path}/{VERSIONS}").collect()  # a line per rebuild
    except AnalysisException:
        return []
    found = []
    for row in rows:
        try:
            entry = json.loads(row["value"])
        except ValueError:
            continue
        if isinstance(entry, dict) and _COMPLETE <= entry.keys():
            found.append(entry)
    return sorted(found, key=lambda e: (e["version"], e["folder"]), reverse=True)


def publish(spark: SparkSession, path: str, entry: dict) -> None:
    """Make a finished version the newest one. Adding one line is one commit: readers see it whole or not at all."""
    newest = max((e["version"] for e in published(spark, path)), default=0)
    text = json.dumps({**entry, "version": newest + 1}, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("append").text(f"{path}/{VERSIONS}")


def _read_version(spark: SparkSession, path: str, entry: dict, fmt: str) -> DataFrame:
    kind, folder = T.StructType.fromJson(entry["schema"]), f"{path}/{entry['folder']}"
    return read_hourly_csv(spark, folder, kind) if fmt == "csv" else spark.read.schema(kind).parquet(folder)


def _fits(df: DataFrame, rows: int, start: str | None, ts: str) -> bool:
    facts = df.agg(F.count(F.lit(1)).alias("rows"),
                   F.min(F.col(ts).cast("date")).cast("string").alias("start")).first()
    return facts["rows"] == rows and (start is None or facts["start"] == start)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], manifest: dict,
                  rows: int | None = None, start: str | None = None, force: bool = False,
                  ts: str = "timestamp", fmt: str = "parquet") -> DataFrame:
    """Read the newest version below ``path`` when row count, first date and manifest agree, else build a new one.

    Every build writes a folder of its own and is published by one added line once it is complete. A build that
    fails leaves the version before it in force; a reader keeps the version that it has opened, and of two builds
    at the same time one counts and both are whole. Old versions stay until someone removes their folders.

    The line also holds the format, the built table's schema and, unless ``rows`` is given, its row count; a version that
    differs in one of them is not used. The returned table is always read back from storage.
    """
    newest = None if force else next(iter(published(spark, path)), None)
    if newest is not None and newest["settings"] == manifest and newest.get("format") == fmt:
        try:
            found = _read_version(spark, path, newest, fmt)
            if _fits(found, newest["rows"] if rows is None else rows, start, ts):
                return found
        except AnalysisException:
            pass  # the line is there, the folder is not
    built = build()
    entry = {"folder": f"table-{uuid.uuid4().hex}", "format": fmt, "settings": manifest,
             "schema": json.loads(built.schema.json())}
    if fmt == "csv":
        write_hourly_csv(built, f"{path}/{entry['folder']}")
    else:
        built.write.parquet(f"{path}/{entry['folder']}")
    made = _read_version(spark, path, entry, fmt)
    publish(spark, path, {**entry, "rows": made.count()})
    return made
