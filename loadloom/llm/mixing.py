"""Mix sources to target weights by fitting a subset of exact lengths to each budget.

Per source: whole copies cover the budget as far as they go; the rest is a subset sum over
the histogram (length, documents). Every length first gives the same share of its documents,
then the longest fill up, and a bounded knapsack closes the last gap. Which documents
represent a length is decided by a seeded hash, so reruns agree.

Defined results: a null text has size 0 and is never taken; a null source is a source of its
own, the last one. Rows with null or repeated ids are separate rows, ordered by the hash of id
and text; equal rows are interchangeable. An empty table gives an empty result. Columns that
clash with an output column are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .text import word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17
#: A length group is ranked in this many parts, so that one length may hold most documents.
PARTS = 256
#: Words that the knapsack leaves open at least; more only where no length fits below.
GAP = 1 << 15


def targets(sizes: dict[str | None, int], share: float = SHARE,
            weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words per source: weights repeat over the sources in code-point order, null last.

    A target stops at ``most`` times its source; the excess goes to the others by weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in names if s in open_ and left * weight[s] / total > most * sizes[s]]
        if not above:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in above:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left = max(0.0, left - sum(out[s] for s in above))
    return out


def choose(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length, so that their sum comes as near below ``budget``
    as the knapsack finds; ``counts`` has positive lengths."""
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * k for n, k in taken.items())
    for n in sorted(counts, reverse=True):
        k = min(counts[n] - taken[n], max(0, left - GAP) // n)
        taken[n] += k
        left -= n * k
    # Bounded knapsack over what is left: bit b of ``reach`` says that b words can be made.
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for n in sorted((n for n in counts if n <= left), reverse=True):
        spare, k = min(counts[n] - taken[n], left // n), 1
        while spare > 0 and not reach >> left & 1:
            k = min(k, spare)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            spare, k = spare - k, 2 * k
        if reach >> left & 1:
            break
    best = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            taken[n] += k
            best -= n * k
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram -> documents to take once more, per length."""
    counts = dict(zip(rows["__size"].tolist(), rows["n"].tolist()))
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = min(MOST_COPIES, int(round(target)) // total) if total else 0
    extra = {}
    if copies < MOST_COPIES and total:
        extra = choose({n: c for n, c in counts.items() if n}, int(round(target)) - copies * total)
    rows = rows[["__src", "__no_src", "__size"]].copy()
    rows["copies"] = [copies if n else 0 for n in rows["__size"]]
    rows["extra"] = [extra.get(n, 0) for n in rows["__size"]]
    return rows


def mix(docs: DataFrame, seed: int = SEED, share: float = SHARE,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (0 to 2) to every row.

    Two passes over the texts. The driver sees one row per source; a task sees the distinct
    lengths of one source, never its documents.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    spark: SparkSession = docs.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    keyed = docs.withColumns({
        "__src": F.coalesce("source", F.lit("")), "__no_src": F.col("source").isNull(),
        "__size": word_count(F.col("text")), "__order": order,
        "__part": F.pmod(F.shiftrightunsigned(order, 40), F.lit(PARTS)).cast("int")})
    key = ["__src", "__no_src", "__size"]
    parts = keyed.select(*key, "__part").groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(parts)
    totals = parts.groupBy("__src", "__no_src").agg(F.sum(F.col("__size") * F.col("n")).alias("s"))
    sizes = {None if r[1] else r[0]: int(r[2]) for r in totals.collect()}
    goal = targets(sizes, share, weights)
    plan = spark.createDataFrame(
        [(s or "", s is None, sizes[s], float(goal[s])) for s in sizes],
        "__src string, __no_src boolean, source_size long, target double")
    lengths = parts.groupBy(*key).agg(F.sum("n").alias("n")).join(plan, ["__src", "__no_src"])
    fitted = lengths.groupBy("__src", "__no_src").applyInPandas(
        _fit, "__src string, __no_src boolean, __size long, copies long, extra long")
    run = Window.partitionBy(*key).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    shares = parts.join(fitted, key).withColumn("__upto", F.sum("n").over(run)).select(
        *key, "__part", "copies", F.greatest(F.lit(0), F.least(
            "n", F.col("extra") - F.col("__upto") + F.col("n"))).alias("__take"))
    shares = shares.join(plan, ["__src", "__no_src"])
    place = Window.partitionBy(*key, "__part").orderBy("__order", "doc_id")
    out = keyed.join(shares, [*key, "__part"]).withColumn("__rank", F.row_number().over(place))
    return out.withColumns({
        "size": F.col("__size"),
        "copies": (F.col("copies") + (F.col("__rank") <= F.col("__take")).cast("long"))
    }).select(*docs.columns, "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    return mix(docs, seed).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter(
        "__copy <= copies").select(*docs.columns)
