"""Hard negatives of anchors by Fagin's threshold algorithm, exactly.

Vectors are cut into integers. A tile holds a bounded share of the rows, and for every dimension the
list of its rows sorted by that component. An anchor walks all lists at once, from the large end where its
own component is positive and from the small end where it is negative (sorted access). Rows met for the
first time are scored in integers (random access). The sum of the anchor's components times the values where the
lists stand bounds every row not met yet; a search ends once this threshold lies strictly below the k-th
score of each of its windows, or below the window itself. The best rows of the tiles are merged.

Positives are the best rows of the anchor's own label; the tiles of that search hold rows of one label.
Every positive opens a window of scores in which the best rows of other labels are its negatives; one walk of an
anchor serves all its windows. Tiles are cut by row, so neither a label nor an id that holds a third of
the rows meets in one task.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Missing
components of a shorter vector count as 0. No row is a candidate of an anchor of its own id; rows that repeat an id
are candidates of their own; of several anchor rows with one id the smallest (label, vector) asks. Several
positives of one id open a window each. Scores beyond 64 bits stop at its ends. Equal scores rank by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .topk import _fits as exact_type, _matrix as matrix

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Least and greatest score of a negative, in percent of its positive's.
LEAST, MOST = 30, 90
#: Components in a tile and in a chunk of anchors at most, about.
TILE_VALUES = 2 << 20
CHUNK_VALUES = 1 << 20
#: Rows of each list in the first round; every further round doubles the depth.
DEPTH = 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): usable rows, components as floor(256 x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
            "vec_id", F.col("label").cast("long").alias("label"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


class Tile:
    """Rows with a sorted list per dimension; rows of one score rank by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.lists = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
        self.accesses = 0

    def search(self, anchor: np.ndarray, usable: np.ndarray, low: list, high: list, k: int):
        """Per window (low, high) the k best usable rows, as (rows, scores); a bound of None is open.
        ``anchor`` and the rows have a number type in which all scores are exact."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        seen, scores = np.zeros(n, bool), np.zeros(n, self.v.dtype)
        best: list = [(np.zeros(0, np.int64), np.zeros(0, self.v.dtype)) for _ in low]
        at, depth = 0, min(DEPTH, n)
        while True:
            # Sorted access, signed by the anchor; a list of a zero component bounds nothing.
            reach = [self.lists[d, n - depth:n - at] if anchor[d] > 0 else self.lists[d, at:depth] for d in dims]
            met = np.unique(np.concatenate(reach)) if reach else np.arange(n)
            met = met[~seen[met]]
            seen[met] = True
            self.accesses += len(met)
            scores[met] = self.v[met] @ anchor
            fresh = met[usable[met]]
            last = [self.lists[d, n - depth] if anchor[d] > 0 else self.lists[d, depth - 1] for d in dims]
            threshold = self.v[last, dims] @ anchor[dims] if len(dims) else None
            open_windows = False
            for w, (least, most) in enumerate(zip(low, high)):
                s = scores[fresh]
                inside = np.ones(len(s), bool)
                if least is not None:
                    inside &= s >= least
                if most is not None:
                    inside &= s <= most
                rows = np.concatenate([best[w][0], fresh[inside]])
                s = scores[rows]
                order = sorted(range(len(rows)), key=lambda j: (-s[j], self.ids[rows[j]]))[:k] \
                    if s.dtype == object else np.lexsort((self.ids[rows], -s))[:k]
                best[w] = rows[order], s[order]
                done = len(dims) == 0 or (least is not None and threshold < least) or \
                    (len(order) == k and threshold < best[w][1][-1])
                open_windows |= not done
            if not open_windows or depth == n:
                return best
            at, depth = depth, min(2 * depth, n)


def _typed(a: np.ndarray, v: np.ndarray):
    """Anchors and rows of one width, in a number type in which all scores are exact."""
    width = max(a.shape[1], v.shape[1])
    a, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, v))
    kind = exact_type(a, v)
    return a.astype(kind), v.astype(kind)


def _table(rows: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array([max(_LOW, min(_HIGH, int(r[i]))) for r in rows], pa.int64())
                     for i in range(len(names))], names=names)


def _tile(rows: pa.Table, anchors: pa.Table):
    a, v = _typed(matrix(anchors["a"]), matrix(rows["v"]))
    return a, Tile(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), v)


def _best_positives(k: int):
    names = ["anchor_id", "vec_id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            a, tile = _tile(rows, anchors)
            for i, anchor_id in enumerate(anchors["anchor_id"].to_pylist()):
                (found, scores), = tile.search(a[i], tile.ids != anchor_id, [None], [None], k)
                out += [(anchor_id, tile.ids[r], s) for r, s in zip(found, scores)]
        return _table(out, names)

    return run


def _best_negatives(k: int, least: int, most: int):
    names = ["anchor_id", "place", "vec_id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            a, tile = _tile(rows, anchors)
            for i, (anchor_id, label, goals) in enumerate(zip(*(anchors[c].to_pylist() for c in (
                    "anchor_id", "label", "scores")))):
                low, high = [-(-least * g // 100) for g in goals], [most * g // 100 for g in goals]
                usable = (tile.labels != label) & (tile.ids != anchor_id)
                for place, (found, scores) in enumerate(tile.search(a[i], usable, low, high, k)):
                    out += [(anchor_id, place, tile.ids[r], s) for r, s in zip(found, scores)]
        return _table(out, names)

    return run


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of the keys over all tiles, with their rank."""
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _pieces(values, most: int):
    return F.greatest(F.lit(1), F.ceil(values / most)).cast("long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); both inputs as
    (vec_id, label, v). Windows go from ``least`` to ``most`` percent of the positive's score."""
    asked = cut_lineage(anchors.groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct(
        "label", F.col("v").alias("a"))).alias("x")).select("anchor_id", "x.label", "x.a"))
    sizes = vectors.groupBy("label").agg(_pieces(F.sum(F.size("v") + 1), TILE_VALUES).alias("tiles"))
    rows = vectors.join(sizes, "label").withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles"))).drop("tiles")
    count = asked.groupBy("label").agg(_pieces(F.sum(F.size("a") + 1), CHUNK_VALUES).alias("chunks"))
    # Chunks of anchors and tiles of rows meet pairwise, per label.
    rows = rows.join(count, "label").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    mine = asked.join(count, "label").withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.col("chunks"))).join(
        sizes, "label").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop(
        "chunks", "tiles")
    keys = ("label", "tile", "chunk")
    found = rows.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(
        _best_positives(positives), "anchor_id long, vec_id long, score long")
    goals = cut_lineage(_first(found, positives, "anchor_id").select(
        "anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))

    windows = goals.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("w"))
    windows = asked.join(windows, "anchor_id").select("anchor_id", "label", "a", F.col("w.positive_score").alias("scores"))
    totals = vectors.agg(F.sum(F.size("v") + 1)).first()[0] or 0, windows.agg(F.sum(F.size("a") + 1)).first()[0] or 0
    tiles, chunks = max(1, -(-totals[0] // TILE_VALUES)), max(1, -(-totals[1] // CHUNK_VALUES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).alias("tile"), every(chunks).alias("chunk"))
    right = windows.select("*", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).alias("chunk"), every(tiles).alias("tile"))
    found = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(
        _best_negatives(negatives, least, most), "anchor_id long, place long, vec_id long, score long")
    return _first(found, negatives, "anchor_id", "place").join(goals, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
