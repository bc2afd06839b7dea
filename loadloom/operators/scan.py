"""Ordered state recurrences over long series, and the scans built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.weather import clip, sigmoid
from ..session import cut_lineage
from .blocks import BLOCK_ROWS, Blocks
from .pieces import Pieces

CHUNK = "_chunk"
Step = Callable[[dict[str, np.ndarray], float], tuple[dict[str, np.ndarray], float]]


def state_scan(df: DataFrame, step: Step, init: float, outputs: Sequence[str],
               keys: Sequence[str] = ("series_id",), pos: str = "pos",
               horizon: int | None = None, chunk_rows: int = BLOCK_ROWS,
               summary: Callable[[dict[str, np.ndarray]], Pieces] | None = None) -> DataFrame:
    """Run ``step`` along each key in ``pos`` order and add its double ``outputs``.

    ``step(columns, state)`` gets one chunk's columns as arrays in order and the state
    before it; it returns the output arrays and the state after it.

    A recurrence is sequential, but chunks of a long key need not wait for each other:
    all start from a guess, then every chunk whose true entry state (the exit of the one
    before) differs from the guess is run again, until none differs. The result is the
    sequential one to the last bit. Recurrences that forget their start settle in a few
    rounds. No task ever holds more than one chunk.

    Where the map of a chunk is known without its entry state, ``summary(columns)`` gives it as
    :class:`Pieces`. Then nothing is guessed and nothing repeated: one pass maps the chunks, the entry
    states follow from one row per chunk, a second pass over the same shuffle fills the rows.

    ``horizon`` keeps the first rows of each key and, when it fits one chunk, makes the
    whole scan a single lazy pass.
    """
    keys = list(keys)
    if horizon is not None:
        df = df.where(F.col(pos) < horizon)
    chunked = df.withColumn(CHUNK, F.floor(F.col(pos) / chunk_rows))
    if horizon is not None:
        last = (horizon - 1) // chunk_rows
    else:
        last = chunked.agg(F.max(CHUNK)).first()[0] or 0
    if last == 0:
        rows = chunked.withColumn("_entry", F.lit(float(init)))
    elif summary is not None:
        rows = chunked.join(_entries(chunked, summary, float(init), keys, pos), [*keys, CHUNK])
    else:
        chunked = cut_lineage(chunked)
        rows = chunked.join(_settle(chunked, step, float(init), keys, pos), [*keys, CHUNK])

    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        made, _ = step({c: pdf[c].to_numpy() for c in names}, float(pdf["_entry"].iloc[0]))
        return pdf[names].assign(**{c: made[c] for c in outputs})

    schema = T.StructType([*df.schema.fields,
                           *[T.StructField(c, T.DoubleType()) for c in outputs]])
    return rows.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def _entries(chunked: DataFrame, summary: Callable[[dict[str, np.ndarray]], Pieces], init: float,
             keys: list[str], pos: str) -> DataFrame:
    """(keys, chunk, _entry) from the maps of the chunks. A key without a chunk in between goes on from
    the chunk before the gap."""
    names = [c for c in chunked.columns if c != CHUNK]
    own = [*[chunked.schema[k] for k in keys], T.StructField(CHUNK, T.LongType())]
    numbers = T.ArrayType(T.DoubleType())
    maps = T.StructType([*own, T.StructField("_starts", numbers), T.StructField("_fixed", T.ArrayType(T.BooleanType())),
                         T.StructField("_values", numbers), T.StructField("_top", T.DoubleType())])

    def chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        made = summary({c: pdf[c].to_numpy() for c in names})
        starts, fixed, values = map(list, zip(*made.pieces))
        return pdf[[*keys, CHUNK]].iloc[:1].assign(_starts=[starts], _fixed=[fixed], _values=[values], _top=made.top)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, ignore_index=True)  # one row per chunk
        state, entries = init, []
        for row in pdf.itertuples(index=False, name=None):
            entries.append(state)
            starts, fixed, values, top = row[-4:]
            state = Pieces(tuple(zip(map(float, starts), map(bool, fixed), map(float, values))), top)(state)
        return pdf[[*keys, CHUNK]].assign(_entry=entries)

    mapped = chunked.groupBy(*keys, CHUNK).applyInPandas(chunk_map, maps)
    return mapped.groupBy(*keys).applyInPandas(walk, T.StructType([*own, T.StructField("_entry", T.DoubleType())]))


def _settle(chunked: DataFrame, step: Step, init: float, keys: list[str], pos: str) -> DataFrame:
    """(keys, chunk, _entry): the true entry state of every chunk."""
    names = [c for c in chunked.columns if c != CHUNK]
    schema = T.StructType([*[chunked.schema[k] for k in keys], T.StructField(CHUNK, T.LongType()),
                           T.StructField("_entry", T.DoubleType()),
                           T.StructField("_exit", T.DoubleType())])

    def exit_state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        entry = float(pdf["_entry"].iloc[0])
        _, end = step({c: pdf[c].to_numpy() for c in names}, entry)
        out = pdf[[*keys, CHUNK]].iloc[:1].copy()
        return out.assign(_entry=entry, _exit=float(end))

    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, CHUNK).applyInPandas(exit_state, schema)

    states = cut_lineage(run(chunked.withColumn("_entry", F.lit(init))))
    in_order = Window.partitionBy(*keys).orderBy(CHUNK)  # one row per chunk
    while True:
        true_entry = F.coalesce(F.lag("_exit").over(in_order), F.lit(init))
        linked = states.withColumn("_true", true_entry).where(F.col("_true") != F.col("_entry"))
        stale = cut_lineage(linked.select(*keys, CHUNK, F.col("_true").alias("_entry")))
        if stale.isEmpty():
            return states.select(*keys, CHUNK, "_entry")
        again = run(chunked.join(stale, [*keys, CHUNK])).select(
            *keys, CHUNK, F.col("_entry").alias("_e"), F.col("_exit").alias("_x"))
        states = cut_lineage(states.join(again, [*keys, CHUNK], "left").select(
            *keys, CHUNK, F.coalesce("_e", "_entry").alias("_entry"),
            F.coalesce("_x", "_exit").alias("_exit")))


def cascade(df: DataFrame, value: str = "load", ratio: float = 1.35, rise: float = 0.055,
            fall: float = 0.04, top: float = 0.25, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inertia factor: climbs by ``rise`` while the load exceeds ratio × its mean, else decays."""
    means = df.groupBy("series_id").agg(F.avg(value).alias("_mean"))
    rows = df.join(means, "series_id").withColumn("_above", F.col(value) > ratio * F.col("_mean"))

    def step(columns: dict[str, np.ndarray], state: float):
        out = np.empty(len(columns["_above"]))
        for i, above in enumerate(columns["_above"]):
            state = min(state + rise, top) if above else max(state - fall, 0.0)
            out[i] = 1.0 + state
        return {"cascade": out}, state

    return state_scan(rows, step, 0.0, ["cascade"], chunk_rows=chunk_rows).drop("_mean", "_above")


def stress_trigger(temperature: Column, hour: Column, ev_share: Column, cloud: Column,
                   setpoint: float = 18.0) -> Column:
    """Row-local input of the stress recurrence."""
    extreme = clip(F.abs(temperature - setpoint) / 22.0, 0.0, 1.4)
    busy = ((hour >= 7) & (hour < 10)) | ((hour >= 18) & (hour < 22))
    return 0.40 * extreme + 0.25 * busy.cast("double") + 0.25 * ev_share + 0.10 * cloud


def stress(df: DataFrame, trigger: str = "trigger", chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smoothed stress state in [0, 1.4] and the multiplier it causes."""
    def step(columns: dict[str, np.ndarray], state: float):
        out = np.empty(len(columns[trigger]))
        for i, push in enumerate(columns[trigger]):
            state = min(max(0.90 * state + 0.10 * push, 0.0), 1.4)
            out[i] = state
        return {"stress_state": out}, state

    s = F.col("stress_state")
    return state_scan(df, step, 0.0, ["stress_state"], chunk_rows=chunk_rows).withColumn(
        "stress", 1.0 + 0.18 * sigmoid(6.0 * (s - 0.55)) + 0.06 * s * s)


def rebound(df: DataFrame, flag: str, amplitude: float = 0.12, length: int = 4,
            decay: float = 0.65) -> DataFrame:
    """Load rebound after each falling edge of a flag: amp·e^(−decay·k) for k < length.

    Overlapping rebounds add up. Each row looks back at the last ``length`` edges, so
    there is neither an explode nor a join.
    """
    blocks = Blocks(before=length)
    ordered = blocks.window()
    edge = (F.lag(flag).over(ordered) > 0) & (F.col(flag) == 0)
    rows = blocks.spread(df).withColumn("_edge", F.coalesce(edge.cast("double"), F.lit(0.0)))
    total = F.lit(0.0)
    for k in range(length):
        back = F.lag("_edge", k).over(ordered) if k else F.col("_edge")
        total = total + F.coalesce(back, F.lit(0.0)) * float(amplitude * np.exp(-decay * k))
    return blocks.core(rows.withColumn("rebound", total)).drop("_edge")
