"""Pack documents into sequences of a fixed size by patterns of lengths.

The histogram of piece lengths (at most one entry per length up to the size) decides
everything: patterns of few lengths that fill a sequence are enumerated, non-negative least
squares fits how often each is used, the counts are rounded down, and what is left is packed
longest first into the best fitting room. Pieces then take the places of their length by rank. The
ranks are counted in parts of a length, so no task or driver holds the pieces of one length.

Defined results: a null or empty text is the end id alone. Rows with repeated or null ids are
packed as rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from . import tokens

SIZE = 2048
PARTS = 256
#: Second lengths tried for each first one in patterns of three, and sweeps of the fit.
SECONDS = 8
SWEEPS = 30


def enumerate_patterns(lengths: list[int], size: int) -> list[tuple[int, ...]]:
    """Patterns of one, two and three present lengths that fill a sequence."""
    present, out = set(lengths), []
    ordered = sorted(present)
    if size in present:
        out.append((size,))
    for a in ordered:
        room = size - a
        if 0 < room <= a and room in present:
            out.append((a, room))
        fit = ordered[:bisect_right(ordered, min(a, room - 1))] if room > 1 else []
        for b in {fit[i * (len(fit) - 1) // max(1, SECONDS - 1)] for i in range(SECONDS)} if fit else ():
            c = room - b
            if c <= b and c in present:
                out.append((a, b, c))
            elif b <= c <= a and c in present:
                out.append((a, c, b))
    return sorted(set(out), reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int]) -> list[float]:
    """Non-negative least squares of pattern repeats on the histogram, by coordinate descent."""
    left = {n: float(c) for n, c in counts.items()}
    uses = [[(n, p.count(n)) for n in set(p)] for p in patterns]
    norm = [sum(k * k for _, k in u) for u in uses]
    x = [0.0] * len(patterns)
    for _ in range(SWEEPS):
        for j, use in enumerate(uses):
            step = sum(left[n] * k for n, k in use) / norm[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for n, k in use:
                    left[n] -= step * k
    return x


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once."""
    left = {n: c for n, c in counts.items() if c > 0}
    patterns = enumerate_patterns(list(left), size)
    out = []
    for pattern, x in sorted(zip(patterns, fit_repeats(patterns, left)), key=lambda p: -p[1]):
        k = min([int(x), *(left[n] // pattern.count(n) for n in set(pattern))])
        if k > 0:
            out.append((pattern, k))
            for n in pattern:
                left[n] -= k
    keys = sorted(n for n, c in left.items() if c)
    while keys:
        pattern, room, used = [], size, {}
        i = len(keys)
        while i:
            n = keys[i - 1]
            k = min(room // n, left[n])
            if k:
                pattern += [n] * k
                used[n] = k
                room -= n * k
            i = min(i - 1, bisect_right(keys, room))
        k = min(left[n] // m for n, m in used.items())
        out.append((tuple(pattern), k))
        for n, m in used.items():
            left[n] -= k * m
        keys = [n for n in keys if left[n]]
    return out


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence and offset of every place, by rank."""
    rank: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, repeats in plan_:
        offset = 0
        for n in pattern:
            found.setdefault(n, []).append((rank.get(n, 0), base, offset))
            rank[n] = rank.get(n, 0) + repeats
            offset += n
        base += repeats
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in found.items()}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is longer."""
    def run(batches):
        encoder, end = tokens.encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in tokens.encoded(batch, encoder):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * at:4 * (at + size)]
                    rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE) -> DataFrame:
    """All pieces with their sequence and offset. Pieces are written to the shared folder once;
    the driver sees the histogram only."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, vocabulary, end_id, size).write.parquet(path)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = spark.read.parquet(path).withColumns({
        "__order": order, "__part": F.pmod(F.shiftrightunsigned(order, 40), F.lit(PARTS)).cast("int")})
    parts = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").agg(F.sum("n")).collect()}
    places = slots(plan(counts, size))
    run = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("length", "__part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__part").orderBy("__order", "doc_id", "piece")
    ranked = rows.join(before, ["length", "__part"]).withColumn(
        "__rank", F.col("__before") + F.row_number().over(within) - 1)

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                first, base, offset = places[length]
                hit = n == length
                at = np.searchsorted(first, rank[hit], side="right") - 1
                seq[hit], off[hit] = base[at] + rank[hit] - first[at], offset[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(seq), pa.array(off)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
               "sequence_id long, offset long")
