"""Ordered work on long series without one task per series.

A window partitioned by series alone puts a whole series into one task. Here a
series is cut into blocks of consecutive rows, each block also receives the few
rows before and after it that its frames reach into (the halo), and the window
is partitioned by (series, block). For frames no wider than the halo the result
is the same, and the longest series spreads over as many tasks as it has blocks.

Everything below needs a dense integer position per series, which the hourly grid
provides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK_ROWS = 8192
BLOCK = "_block"


class Blocks:
    """Blocks over (keys, pos) with a halo of ``before`` and ``after`` rows."""

    def __init__(self, keys: Sequence[str] = ("series_id",), pos: str = "pos",
                 before: int = 0, after: int = 0, rows: int = BLOCK_ROWS) -> None:
        self.keys, self.pos = list(keys), pos
        self.before, self.after = int(before), int(after)
        # A block holds at least one full halo, so a row lands in few blocks.
        self.rows = max(int(rows), self.before + 1, self.after + 1)

    def spread(self, df: DataFrame) -> DataFrame:
        """Assign rows to blocks, copying those in a halo."""
        pos = F.col(self.pos)
        home = F.floor(pos / self.rows)
        if not self.before and not self.after:
            return df.withColumn(BLOCK, home)
        first = F.greatest(F.lit(0), F.floor((pos - self.after) / self.rows))
        last = F.floor((pos + self.before) / self.rows)
        return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))

    def window(self, *extra: str) -> WindowSpec:
        """The block's rows in order; ``extra`` columns restart it inside the block."""
        return Window.partitionBy(*self.keys, BLOCK, *extra).orderBy(self.pos)

    def frame(self, start: int, end: int, *extra: str) -> WindowSpec:
        """Row frame relative to the current row; must lie inside the halo."""
        if -start > self.before or end > self.after:
            raise ValueError(f"frame [{start}, {end}] reaches beyond the halo")
        return self.window(*extra).rowsBetween(start, end)

    def core(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies."""
        return df.where(F.floor(F.col(self.pos) / self.rows) == F.col(BLOCK)).drop(BLOCK)


def running_sum(df: DataFrame, value: str, out: str, keys: Sequence[str] = ("series_id",),
                pos: str = "pos", rows: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative sum per series: inside each block, plus the totals of earlier blocks."""
    keys = list(keys)
    blocked = df.withColumn(BLOCK, F.floor(F.col(pos) / rows))
    totals = blocked.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BLOCK, F.coalesce(F.sum("_total").over(earlier), F.lit(0.0))
                            .alias("_offset"))
    inside = (Window.partitionBy(*keys, BLOCK).orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        blocked.join(offsets, [*keys, BLOCK])
        .withColumn(out, F.sum(value).over(inside) + F.col("_offset"))
        .drop(BLOCK, "_offset")
    )


BINS = 128
#: Distinct values of a key that its borders are taken from.
BORDER_SAMPLE = 64 * BINS
_HASHES = 1 << 31


def value_tallies(df: DataFrame, value: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, _v, _c, _bin): the distinct values of each key with their counts, in bins in the order of values.

    A row counts once, or as often as the integer column ``weight`` says.

    The borders are quantiles of the key's own distinct values, so however the values lie, a bin holds about 1 / BINS of
    them. Which values the borders come from is a matter of their hash alone: every task and every retry finds
    the same ones. They shape the work, not the result. The bin is found by halving.
    """
    keys = list(keys)
    tallies = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, (F.col(value) + F.lit(0.0)).alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")))
    sizes = tallies.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
    share = F.least(F.lit(1.0), BORDER_SAMPLE / F.col("_distinct"))
    picked = tallies.join(sizes, keys).where(F.pmod(F.xxhash64("_v"), F.lit(_HASHES)) < share * _HASHES)
    sample = picked.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    borders = sample.select(*keys, F.transform(
        F.sequence(F.lit(1), F.lit(BINS - 1)),
        lambda i: F.get("_s", F.floor(i * F.size("_s") / BINS).cast("int"))).alias("_borders"))
    out = tallies.join(borders, keys, "left").withColumn("_bin", F.lit(0))
    half = BINS // 2
    while half:  # a key without borders stays in bin 0
        out = out.withColumn("_bin", F.col("_bin") + F.when(
            F.col("_v") >= F.get("_borders", F.col("_bin") + (half - 1)), half).otherwise(0))
        half //= 2
    return out.drop("_borders")


def value_rank(df: DataFrame, value: str, keys: Sequence[str] = ("series_id",),
               out: str = "rank0", total: str = "n") -> DataFrame:
    """(keys, value, rank, n): the values of each key in ascending order, numbered from 0.

    Equal values are counted first and only repeated at the end, so a value that makes up
    most of a key costs one row on the way. Distinct values are ordered inside bins; the
    counts of lower bins give the offset.
    """
    keys = list(keys)
    tallies = value_tallies(df, value, keys).withColumnRenamed("_v", value)
    bins = tallies.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_rows"))
    lower = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        *keys, "_bin", F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    first = F.sum("_c").over(inside) - F.col("_c") + F.col("_offset")
    # Two steps keep the arrays short however often a value occurs.
    pieces = tallies.join(offsets, [*keys, "_bin"]).select(
        *keys, value, total, "_c", first.alias("_first")).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / 4096))))
    low = F.col("_piece") * 4096
    return (
        pieces.withColumn("_k", F.explode(F.sequence(low, F.least(low + 4095, F.col("_c") - 1))))
        .select(*keys, value, (F.col("_first") + F.col("_k")).alias(out), total)
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    keys: Sequence[str] = ("series_id",), weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    A row counts ``weight`` times, default once. Equal values are counted first. Bin counts then tell which bins hold the wanted
    order statistics, and only the values of those bins are ordered, so no task sees
    all the values of a key.
    """
    keys = list(keys)
    tallies = value_tallies(df, value, keys, weight)
    bins = tallies.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_rows"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    edges = bins.select(
        *keys, "_bin",
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"),
        (F.sum("_rows").over(by_bin) - F.col("_rows")).alias("_below"),
        F.sum("_rows").over(by_bin).alias("_upto"))
    wanted = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"),
                                   rank.alias("at")))
    targets = (
        edges.withColumn("_t", F.explode(F.array(*wanted)))
        .where((F.col("_t.at") >= F.col("_below")) & (F.col("_t.at") < F.col("_upto")))
        .groupBy(*keys, "_bin", "_below", "_n").agg(F.collect_list("_t").alias("_targets"))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    picked = (
        tallies.join(targets, [*keys, "_bin"])
        .withColumn("_end", F.sum("_c").over(inside) + F.col("_below"))
        .withColumn("_t", F.explode("_targets"))
        .where((F.col("_t.at") < F.col("_end")) & (F.col("_t.at") >= F.col("_end") - F.col("_c")))
    )
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.max("_n") - 1)
        lo = F.max(F.when((F.col("_t.q") == name) & (F.col("_t.side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_t.q") == name) & (F.col("_t.side") == "hi"), F.col("_v")))
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.groupBy(*keys).agg(*out)
