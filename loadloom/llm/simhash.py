"""SimHash near-duplicates, with Golay codewords as fuzzy keys.

A 64-bit fingerprint is cut into three segments. The perfect Golay code (23, 12) maps a
segment to the codewords near it: the nearest one, and the five at distance 4 where the
nearest is at distance 3. Two segments that differ in at most one bit then share the nearest
codeword of either. Of 4 differing bits, either two segments have at most one each, and a pair
of codewords finds the link; or one has none and both others two, and then the equal segment with
a third of its neighbour finds it. Candidates are verified on the whole fingerprint.

Defined results: A-Z are lower-cased; a text of fewer than four words is one shingle, one
without words (null, empty) has fingerprint zero and is linked like any other. Repeated rows
give a row each. Rows with a null id are linked too, but never name a component; where no other
id is reachable, ``component_id`` is null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from . import text as T
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
WIDTHS = (22, 21, 21)
SHIFTS = (0, 22, 43)
#: Fixed value: generator polynomial of the binary Golay code (23, 12).
GENERATOR = 0b110001110101
#: Stand-ins for fingerprints that only rows without id have; above any real id.
NAMELESS = 0x7000_0000_0000_0000


def fingerprint(data: bytes) -> int:
    """Majority of the bits of the shingles' XXH64."""
    words = data.translate(T.UPPER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    one = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at:min(n, at + (1 << 16))].tolist(), ends[at + k - 1:at + k - 1 + (1 << 16)].tolist())
        h = np.array([one(line[a:b], SEED) for a, b in spans], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; ``keep_row``: all columns and ``__fp``."""
    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                fps = np.array([fingerprint(t) for t in T.raw_texts(part.column("text"))], np.uint64)
                kept = part.columns if keep_row else [part.column("doc_id").cast(pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names)

    docs = docs if keep_row else docs.select("doc_id", "text")
    schema = StructType([*docs.schema.fields, StructField("__fp", LongType())]) if keep_row else "doc_id long, fp long"
    names = [*docs.columns, "__fp"] if keep_row else ["doc_id", "fp"]
    return docs.mapInArrow(run, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of every 12-bit message; per syndrome the error patterns to the nearest
    codeword and to those at distance 4 (23-bit patterns, -1 where there is none)."""
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        parity[m] = r
    near, far, filled = np.full(2048, -1, np.int64), np.full((2048, 5), -1, np.int64), np.zeros(2048, int)
    def syndrome(p):
        return parity[p >> 11] ^ (p & 2047)
    bits = [1 << i for i in range(23)]
    for a in range(-1, 23):
        for b in range(-1, a + 1 if a >= 0 else 0):
            for c in range(-1, b + 1 if b >= 0 else 0):
                if (a == b >= 0) or (b == c >= 0):
                    continue
                p = sum(bits[i] for i in (a, b, c) if i >= 0)
                near[syndrome(p)] = p
    i = np.array([(a, b, c, d) for a in range(23) for b in range(a) for c in range(b) for d in range(c)])
    for p in (1 << i).sum(1).tolist():
        s = syndrome(p)
        far[s, filled[s]] = p
        filled[s] += 1
    return parity, near, far


def golay_keys(v: np.ndarray, tables) -> np.ndarray:
    """Codeword indices of 23-bit words: n x 6, the nearest first, -1 where there is none."""
    parity, near, far = tables
    s = parity[v >> 11] ^ (v & 2047)
    patterns = np.concatenate([near[s][:, None], far[s]], axis=1)
    return np.where(patterns >= 0, (v[:, None] ^ patterns) >> 11, -1)


def candidate_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, main) of all keys of the fingerprints; ``main`` marks those that compare
    with every other row of their key, the rest only with main rows."""
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    codes = [golay_keys(x, tables) for x in seg]
    rows, keys, mains = [], [], []
    for family, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = codes[i][:, :, None], codes[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), family << 40 | a << 12 | b, -1).reshape(len(u), 36)
        row, col = np.nonzero(key >= 0)
        rows.append(row), keys.append(key[row, col]), mains.append(col == 0)
    for i in range(3):
        j = (i + 1) % 3
        for third in range(3):
            part = seg[j] >> (8 * third) & (255 if third < 2 else (1 << WIDTHS[j] - 16) - 1)
            rows.append(np.arange(len(u)))
            keys.append((3 + 3 * i + third) << 40 | seg[i] << 8 | part)
            mains.append(np.ones(len(u), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(mains)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


class _Forest:
    """Links of one task; of links inside an already joined set none is reported again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links_of_run(fp: np.ndarray, rep: np.ndarray, forest: _Forest, out: list) -> None:
    """Spanning links of one key's rows: every row is compared with those not yet reached."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _bits(fp[left] ^ fp[x]) <= MAX_BITS
            for y in left[near].tolist():
                if forest.join(int(rep[x]), int(rep[y])):
                    out.append((int(rep[x]), int(rep[y])))
                queue.append(y)
            left = left[~near]


def _links(key, fp, rep, main, forest, out) -> None:
    """Links among sorted rows of whole keys."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    useful = (size > 1) & (np.add.reduceat(main.astype(np.int64), begin) > 0)
    begin, size = begin[useful], size[useful]
    for m in np.unique(size).tolist():
        at = begin[size == m]
        if m > 12:
            for a in at.tolist():
                _links_of_run(fp[a:a + m], rep[a:a + m], forest, out)
            continue
        for i in range(m):
            for j in range(i):
                hit = (main[at + i] | main[at + j]) & (_bits(fp[at + i] ^ fp[at + j]) <= MAX_BITS)
                for x, y in zip(rep[at[hit] + i].tolist(), rep[at[hit] + j].tolist()):
                    if forest.join(x, y):
                        out.append((x, y))


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between representatives of fingerprints ``(fp, rep)``, enough to join all
    that are linked: keys are shuffled and sorted, a task compares the rows of each key."""
    def emit(batches):
        tables = golay_tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fp, rep = (part.column(c).to_numpy() for c in ("fp", "rep"))
                row, key, main = candidate_keys(fp, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key, fp[row], rep[row], main)], ["key", "fp", "rep", "main"])

    def compare(batches):
        forest, rest = _Forest(), None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep", "main")]
            now = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            rest, out = [x[last:] for x in now], []
            if last:
                _links(*(x[:last] for x in now), forest, out)
            yield _edges(out)
        if rest is not None and len(rest[0]):
            out = []
            _links(*rest, forest, out)
            yield _edges(out)

    keys = fps.select("fp", "rep").mapInArrow(emit, "key long, fp long, rep long, main boolean")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def _edges(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint; root is the smallest id of its component, or a number
    from ``NAMELESS`` on where no row of it has an id."""
    nameless = F.lit(NAMELESS) + F.col("fp").bitwiseAND(F.lit((1 << 58) - 1))
    fps = prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), nameless).alias("rep"))
    roots = components(links(fps))
    return fps.join(roots, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row. Copies share a fingerprint, and
    adaptive execution splits a fingerprint that many rows share."""
    prints = cut_lineage(fingerprints(docs))
    return prints.join(grouped(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id.

    Rows that repeat the kept id are reduced to one. A row without id stays only where no
    row of its component has an id.
    """
    prints = cut_lineage(fingerprints(docs))
    groups = cut_lineage(grouped(prints))
    keep = prints.join(groups, "fp").filter("doc_id = root").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    nameless = groups.filter(F.col("root") >= NAMELESS).select(
        F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    bare = fingerprints(docs.filter(F.col("doc_id").isNull()), keep_row=True).join(
        nameless, "__fp").dropDuplicates(["__root"])
    return named.unionByName(bare.select(*docs.columns))
