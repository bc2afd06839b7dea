"""Helpers shared by the operators on texts."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but these; Python's bytes.split() splits at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = bytes.maketrans(UPPER_LETTERS.encode(), UPPER_LETTERS.lower().encode())
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of every text of an Arrow column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def remainder(ids: list, divisor: int) -> list[int]:
    """crc32 of each id as text, modulo; a null id counts as the empty text."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % divisor for i in ids]


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20):
    """Cut a batch into parts of about ``most`` bytes of text, so that work arrays stay small."""
    size = batch.column(column).nbytes
    step = max(1, batch.num_rows * most // max(size, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
