"""Training windows from stored blocks instead of L copies of every hour.

A store holds one row per (series, split, block): the block's hours once, with the rows before and after
that its windows reach into, as one flat array. Windows are views of it, taken when a batch is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import ForecastConfig
from .blocks import BLOCK, BLOCK_ROWS, Blocks

#: Numbers of one batch of windows (8 bytes each): bounds what a task holds besides the block.
BATCH_NUMBERS = 1 << 21

Views = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def block_rows(df: DataFrame, cfg: ForecastConfig, channels: Sequence[str], target: str = "consumption",
               rows: int = BLOCK_ROWS) -> DataFrame:
    """(series_id, split, block, first, split_n, first_ts, x, y): ``x`` the rows x channels of a block with its
    halo, row after row, ``y`` the target of the same rows, ``first`` the place of the first row in its split.

    Needs (series_id, ts, split, split_pos, split_n), complete hours. A gap or a repeated hour inside a block raises, since
    windows are found by place. NULL values stay NULL. Bytes exceed the hourly table's by the halo only.
    """
    blocks = Blocks(keys=("series_id", "split"), pos="split_pos", before=cfg.history - 1, after=cfg.horizon, rows=rows)
    step = F.struct("split_pos", "ts", F.array(*[F.col(c).cast("double") for c in channels]).alias("x"),
                    F.col(target).cast("double").alias("y"))
    packed = blocks.spread(df).groupBy("series_id", "split", BLOCK).agg(
        F.sort_array(F.collect_list(step)).alias("_s"), F.max("split_n").alias("split_n"))
    first, last = F.col("_s")[0], F.element_at("_s", -1)
    complete = F.when(F.size("_s") == last["split_pos"] - first["split_pos"] + 1, F.col("_s")).otherwise(
        F.raise_error(F.concat(F.lit("hours missing or repeated in a block of series "), F.col("series_id"))))
    return packed.withColumn("_s", complete).select(
        "series_id", "split", F.col(BLOCK).alias("block"), first["split_pos"].alias("first"), "split_n",
        first["ts"].alias("first_ts"), F.flatten(F.transform("_s", lambda s: s["x"])).alias("x"),
        F.transform("_s", lambda s: s["y"]).alias("y"))


def write_blocks(df: DataFrame, cfg: ForecastConfig, channels: Sequence[str], path: str,
                 target: str = "consumption", rows: int = BLOCK_ROWS) -> None:
    """Write the store as Parquet; what reads it must use the same config, channels and ``rows``."""
    block_rows(df, cfg, channels, target, rows).write.parquet(path)


def _views(batch: pa.RecordBatch, cfg: ForecastConfig, width: int, rows: int
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row of the batch, offset of the first origin, windows, targets), a bounded number of windows at a time."""
    length, horizon = cfg.history, cfg.horizon
    size = max(rows, length, horizon + 1)
    at = max(1, BATCH_NUMBERS // (length * width + horizon))
    blocks, firsts, ends = (batch.column(c).to_pylist() for c in ("block", "first", "split_n"))
    for i in range(batch.num_rows):
        x = batch.column("x")[i].values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
        y = batch.column("y")[i].values.to_numpy(zero_copy_only=False).astype(float, copy=False)
        low = max(blocks[i] * size, length - 1) - firsts[i]
        high = min((blocks[i] + 1) * size, ends[i] - horizon) - firsts[i]
        if high <= low:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).swapaxes(1, 2)
        targets = np.lib.stride_tricks.sliding_window_view(y, horizon)
        for start in range(low, high, at):
            end = min(start + at, high)
            yield i, start, windows[start - length + 1:end - length + 1], targets[start + 1:end + 1]


def _with_places(made: DataFrame, cfg: ForecastConfig, names: Sequence[str]) -> DataFrame:
    return made.select(
        "series_id", "split", F.timestamp_add("HOUR", F.col("_offset"), F.col("first_ts")).alias("origin_ts"),
        (F.col("first") + F.col("_offset") - (cfg.history - 1)).alias("origin_idx"), *names)


def _head(batch: pa.RecordBatch, i: int, start: int, count: int) -> list[pa.Array]:
    place = pa.array(np.full(count, i))
    return [*(batch.column(c).take(place) for c in ("series_id", "split", "first_ts", "first")),
            pa.array(np.arange(start, start + count, dtype=np.int64))]


HEAD = ("series_id", "split", "first_ts", "first", "_offset")


def _schema(store: DataFrame, rest: str) -> str:
    kinds = dict(store.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in HEAD[:-1]) + f", _offset bigint, {rest}"


def map_windows(store: DataFrame, cfg: ForecastConfig, channels: Sequence[str], reduce: Views,
                names: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(series_id, split, origin_ts, origin_idx, names): ``reduce(x, y)`` on batches of windows.

    ``x`` (windows, L, channels) and ``y`` (windows, H) are read-only views of the block, with NaN for NULL;
    ``reduce`` gives a column of doubles per name. No window is copied on the way. NaN comes back as NULL.
    """
    width, names = len(channels), list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, x, y in _views(batch, cfg, width, rows):
                made = reduce(x, y)
                columns = [pa.array(np.asarray(made[c], float), from_pandas=True) for c in names]
                yield pa.RecordBatch.from_arrays([*_head(batch, i, start, len(x)), *columns], [*HEAD, *names])

    made = store.mapInArrow(run, _schema(store, ", ".join(f"`{c}` double" for c in names)))
    return _with_places(made, cfg, names)


def read_windows(store: DataFrame, cfg: ForecastConfig, channels: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(series_id, split, origin_ts, origin_idx, x, y): every window as a flat array of L x channels numbers, step
    after step, with its targets. Copies exist only in the batch that is on its way to the reader."""
    width = len(channels)

    def flat(a: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(a).reshape(len(a), -1)
        ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, x, y in _views(batch, cfg, width, rows):
                yield pa.RecordBatch.from_arrays(
                    [*_head(batch, i, start, len(x)), flat(x), flat(y)], [*HEAD, "x", "y"])

    made = store.mapInArrow(run, _schema(store, "x array<double>, y array<double>"))
    return _with_places(made, cfg, ("x", "y"))
