"""Context-tree weighting of bytes: log-probabilities of whole texts.

A text is its lower-cased words, a space between two and a line feed at the end. Each byte is eight
binary decisions; each decision has a context tree over the ``DEPTH`` bytes before. A node's
Krichevsky-Trofimov estimate is mixed with the product of its children's, at every depth:
P_w = (P_kt + prod P_w(children)) / 2. The tree is learnt from the training texts and then fixed; a byte's
probability mixes the estimates of all depths on its path by the nodes' posterior weights.

Nothing of the size of the corpus is held in one place. Tasks reduce blocks of texts to distinct
(context, byte) codes and words with counts, packed and compressed per route; a route is a hash of the
nearest two context bytes (or of the word) and owns the subtrees below them. Only depths 0 and 1, at
most 256 x 255 nodes, meet on the driver. Routes send every block the values it asked for, and the
texts are scored block by block.

Defined results: a null or empty text is a line feed alone and has one token, the end. A null id counts as
the empty text when the held-out part is chosen. Repeated rows are scored, and learnt, as often as
they occur. Without training texts every bit has probability one half. An empty table gives an empty
result. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from . import text as T

DEPTH = 5
HELD_OUT = (7, 2)
#: Text bytes in a block, in a packed row of texts, and in one step of coding.
BLOCK_BYTES = 24 << 20
ROW_BYTES = 2 << 20
STEP_BYTES = 4 << 20
MOST_ROUTES = 2048
DOCS, CODES, WORDS = 0, 1, 2
END = 10

PACKED = ("kind int, route long, block long, n long, a binary, b binary, c binary")
_SCHEMA = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
                     ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


# --- packing -----------------------------------------------------------------------------------

def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpress(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences, byte planes side by side."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _press(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    planes = _unpress(data, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _row(kind, route, block, n, a, b=b"", c=b""):
    return {"kind": kind, "route": route, "block": block, "n": n, "a": a, "b": b, "c": c}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


# --- codes and counts --------------------------------------------------------------------------

def normal(data: bytes) -> bytes:
    """Lower-cased words, one space between two, a line feed at the end."""
    return b" ".join(data.translate(T.UPPER).split()) + b"\n"


def codes(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """Code of every byte: the context bytes, nearest first, then the byte. Zeros precede a text."""
    pad = b"\0" * depth
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    starts = np.cumsum([0] + [len(t) + depth for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    code = np.zeros(len(flat) - depth, np.uint64)
    for k in (*range(1, depth + 1), 0):
        code <<= np.uint64(8)
        code |= flat[depth - k:len(flat) - k].astype(np.uint64)
    if len(texts) < 2:
        return code
    keep = np.ones(len(code), bool)
    for at in range(depth):
        keep[starts[1:] - depth + at] = False
    return code[keep]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _steps(texts: list[bytes]):
    """Runs of texts of about ``STEP_BYTES``."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def block_codes(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a block and how often training texts have them (0: held-out only)."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for learn in (True, False):
        some = [t for t, y in zip(texts, train) if y is learn]
        for a, b in _steps(some):
            code = codes(some[a:b])
            code.sort()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            keys.append(code[first])
            counts.append(np.diff(np.append(first, len(code))) * learn)
    return merged(np.concatenate(keys), np.concatenate(counts))


def word_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def block_words(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    seen, learnt = set(), Counter()
    for t, y in zip(texts, train):
        learnt.update(t.split()) if y else seen.update(t.split())
    seen -= learnt.keys()
    keys = word_keys([*learnt, *seen])
    return merged(keys, np.array([*learnt.values(), *[0] * len(seen)], np.int64))


def code_route(keys: np.ndarray, routes: int, depth: int = DEPTH) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth - 1))
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(routes)


def word_route(keys: np.ndarray, routes: int) -> np.ndarray:
    return (keys >> np.uint64(20)) % np.uint64(routes)


def extract(docs: DataFrame, routes: int, divisor: int, part: int) -> DataFrame:
    """Rows of packed texts, and per route the codes and words of every block.

    A block is a run of a task's texts; it is known by the task and a counter. The rows are
    written once, so those of a repeated attempt never mix with others.
    """
    def flush(block, ids, held, texts):
        train = [not h for h in held]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= ROW_BYTES or i + 1 == len(texts):
                some = texts[at:i + 1]
                known = np.array([x is not None for x in ids[at:i + 1]])
                numbers = np.array([x or 0 for x in ids[at:i + 1]], "<i8")
                flags = (known + 2 * np.array(held[at:i + 1])).astype(np.uint8)
                yield _batch([_row(DOCS, 0, block, len(some), numbers.tobytes() + flags.tobytes(),
                                   np.array([len(x) for x in some], "<i8").tobytes(),
                                   zstandard.ZstdCompressor(level=1).compress(b"".join(some)))])
                at, size = i + 1, 0
        for kind, (keys, counts), route in ((CODES, block_codes(texts, train), code_route),
                                            (WORDS, block_words(texts, train), word_route)):
            where = route(keys, routes)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(routes + 1))
            rows = []
            for r in range(routes):
                some = order[cuts[r]:cuts[r + 1]]
                if len(some):
                    rows.append(_row(kind, r, block, len(some), pack_keys(keys[some]), _press(counts[some].astype("<i8"))))
            yield _batch(rows)

    def run(batches):
        base, count, size, ids, held, texts = TaskContext.get().partitionId() << 24, 0, 0, [], [], []
        for batch in batches:
            for some in T.slices(batch, "text", STEP_BYTES):
                numbers = some.column("doc_id").to_pylist()
                ids += numbers
                held += [r == part for r in T.remainder(numbers, divisor)]
                texts += map(normal, T.raw_texts(some.column("text")))
                size += some.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield from flush(base + count, ids, held, texts)
                    count, size, ids, held, texts = count + 1, 0, [], [], []
        if texts:
            yield from flush(base + count, ids, held, texts)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


# --- the tree ----------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: eight steps up, then Stirling's series."""
    x = x.astype(np.float64)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    return ((y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
            + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7) - np.log(product))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1.0)


class Level:
    """Nodes of one depth: key = context << 8 | binary node, counts, posterior of stopping here."""

    def __init__(self, codes_: np.ndarray, counts: np.ndarray, below: Level | None):
        context, byte = codes_ >> np.uint64(8), (codes_ & np.uint64(255)).astype(np.int64)
        parts = []
        for bit in range(8):
            key = context << np.uint64(8) | (1 << bit | byte >> (8 - bit)).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            one = (byte >> (7 - bit) & 1) == 1
            parts.append((key[first], *(np.add.reduceat(np.where(one == w, counts, 0), first) if len(first)
                                        else np.zeros(0, np.int64) for w in (False, True))))
        key, zeros, ones = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        self.key, self.zeros, self.ones = key[order], zeros[order], ones[order]
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.log_w, self.stop = own, np.ones(len(own))
        else:
            self.mix(own, np.bincount(np.searchsorted(self.key, below.parents()), below.log_w, len(own)))

    def mix(self, own: np.ndarray, children: np.ndarray) -> None:
        self.log_w = np.logaddexp(own, children) - math.log(2)
        self.stop = np.exp(own - math.log(2) - self.log_w)

    def parents(self) -> np.ndarray:
        return self.key >> np.uint64(16) << np.uint64(8) | self.key & np.uint64(255)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), int), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2) -> list[Level]:
    """Levels ``top`` to ``depth`` from codes with positive counts."""
    levels, below = [], None
    for _ in range(depth, top - 1, -1):
        below = Level(keys, counts, below)
        levels.append(below)
        keys, counts = merged(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), counts)
    return levels[::-1]


class Top:
    """Depths 0 and 1 from the sums over depth 2: at most 256 x 255 nodes."""

    def __init__(self, key, log_w, zeros, ones):
        self.levels = []
        shift = lambda k: k >> np.uint64(16) << np.uint64(8) | k & np.uint64(255)
        for _ in range(2):
            level = object.__new__(Level)
            order = np.argsort(key)
            level.key, level.zeros, level.ones = key[order], zeros[order], ones[order]
            level.mix(log_kt(level.zeros, level.ones), log_w[order])
            self.levels.insert(0, level)
            up = shift(level.key)
            key, inverse = np.unique(up, return_inverse=True)
            log_w, zeros, ones = (np.bincount(inverse, x, len(key)) for x in (level.log_w, level.zeros, level.ones))


def log_probability(keys: np.ndarray, levels: list[Level], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each code's byte in its context; ``levels`` are depths 0 to ``depth``."""
    byte, out = (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
    for bit in range(8):
        node, one = (1 << bit | byte >> (8 - bit)).astype(np.uint64), (byte >> (7 - bit) & 1) == 1
        p = None
        for d in range(depth, -1, -1):
            level = levels[d]
            at, hit = level.find(keys >> np.uint64(8) >> np.uint64(8 * (depth - d)) << np.uint64(8) | node)
            if not len(level.key):
                p = np.full(len(keys), 0.5)
                continue
            seen = np.where(one, level.ones[at], level.zeros[at])
            kt = (seen + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            mixed = kt if p is None else level.stop[at] * kt + (1 - level.stop[at]) * p
            p = np.where(hit, mixed, 0.5)
        out += np.log10(p)
    return out


# --- routes ------------------------------------------------------------------------------------

SUMMARY = "kind int, route long, key long, log_w double, zeros long, ones long"


class _Tally:
    """Counts of the keys of one route, merged whenever enough have gathered."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, row: dict) -> None:
        self.keys.append(unpack_keys(row["a"], row["n"]))
        self.counts.append(_unpress(row["b"], "<i8"))
        self.waiting += row["n"]
        if self.waiting > max(1 << 20, len(self.keys[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


def _groups(batches):
    """Rows of a stream sorted by (kind, route), with a mark where a new group begins."""
    key = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            yield (row["kind"], row["route"]) != key, row
            key = (row["kind"], row["route"])


def routed(rows: DataFrame) -> DataFrame:
    return rows.repartition("kind", "route").sortWithinPartitions("kind", "route", "block")


def totals(counted: DataFrame) -> DataFrame:
    """Every route's distinct keys with their counts, as one row (block -1)."""
    def run(batches):
        key, tally = None, None
        for new, row in _groups(batches):
            if new:
                if tally is not None:
                    yield finish(key, tally)
                key, tally = (row["kind"], row["route"]), _Tally()
            tally.add(row)
        if tally is not None:
            yield finish(key, tally)

    def finish(key, tally):
        keys, counts = tally.merge()
        return _batch([_row(*key, -1, len(keys), pack_keys(keys), _press(counts.astype("<i8")))])

    return routed(counted).mapInArrow(run, PACKED)


def summary(models: DataFrame) -> DataFrame:
    """Per route: of words, the distinct and all trained ones; of codes, sums over the depth 2 nodes."""
    names = ["kind", "route", "key", "log_w", "zeros", "ones"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = unpack_keys(row["a"], row["n"]), _unpress(row["b"], "<i8")
                if row["kind"] == WORDS:
                    cells = [np.zeros(1), np.zeros(1), [int((counts > 0).sum())], [int(counts.sum())]]
                else:
                    level = subtree(keys[counts > 0], counts[counts > 0])[0]
                    key, inverse = np.unique(level.parents(), return_inverse=True)
                    cells = [key] + [np.bincount(inverse, x, len(key)) for x in (level.log_w, level.zeros, level.ones)]
                n = len(cells[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["kind"]] * n, pa.int32()), pa.array([row["route"]] * n, pa.int64())]
                    + [pa.array(np.asarray(x).astype(t)) for x, t in zip(
                        cells, (np.int64, np.float64, np.int64, np.int64))], names)

    return models.mapInArrow(run, SUMMARY).groupBy("kind", "key").agg(
        F.sum("log_w").alias("log_w"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def answers(models: DataFrame, counted: DataFrame, top: Top) -> DataFrame:
    """For every block and route the values of the keys it holds: a route's total comes first."""
    def run(batches):
        keys = values = None
        for _, row in _groups(batches):
            own = unpack_keys(row["a"], row["n"])
            if row["block"] == -1:
                counts = _unpress(row["b"], "<i8")
                keys = own
                values = counts if row["kind"] == WORDS else log_probability(
                    keys, top.levels + subtree(keys[counts > 0], counts[counts > 0])).astype("<f4")
                continue
            got = values[np.searchsorted(keys, own)]
            yield _batch([_row(row["kind"], row["route"], row["block"], row["n"], row["a"], _press(got))])

    return routed(models.unionByName(counted)).mapInArrow(run, PACKED)


class _Lookup:
    """Values of 64-bit keys: a table by hash, and a binary search for what it can't tell."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self.slot(self.keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self.slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        if len(wrong):
            at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


def scored(texts: DataFrame, replies: DataFrame, n_words: int, n_distinct: int, n_train: int) -> DataFrame:
    """Scores of all texts: a block's replies come first, then its texts."""
    n, v = n_words + n_train, n_distinct + (n_train > 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]

    def table(rows):
        keys = np.concatenate([unpack_keys(r["a"], r["n"]) for r in rows])
        kind = "<f4" if rows[0]["kind"] == CODES else "<i8"
        return _Lookup(keys, np.concatenate([_unpress(r["b"], kind) for r in rows]))

    def score(row, code_values, word_counts, memo):
        k = row["n"]
        numbers = np.frombuffer(row["a"], "<i8", k)
        flags = np.frombuffer(row["a"], np.uint8, k, 8 * k)
        ends = np.cumsum(np.frombuffer(row["b"], "<i8"))
        data = zstandard.ZstdDecompressor().decompress(row["c"])
        parts = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        total = np.zeros(k)
        for a, b in _steps(parts):
            logs = code_values(codes(parts[a:b])).astype(np.float64)
            total[a:b] = np.add.reduceat(logs, np.cumsum([0] + [len(t) for t in parts[a:b - 1]]))
        tokens, known, base = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        for i, t in enumerate(parts):
            words = t.split()
            new = [w for w in set(words) if w not in memo]
            if new:
                memo.update(zip(new, word_counts(word_keys(new)).tolist()))
            c = np.array([*map(memo.__getitem__, words), n_train], np.float64)
            tokens[i], known[i] = len(c), np.count_nonzero(c)
            base[i] = np.log10((c + 1) / (n + v + 1)).sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, mask=flags & 1 == 0), pa.array((flags & 2) > 0), pa.array(tokens), pa.array(known),
             pa.array(base), pa.array(total), pa.array(np.diff(ends, prepend=0))], names)

    def run(batches):
        block, held, tables = None, {CODES: [], WORDS: []}, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["block"] != block:
                    block, held, tables, memo = row["block"], {CODES: [], WORDS: []}, None, {}
                if row["kind"] != DOCS:
                    held[row["kind"]].append(row)
                    continue
                if tables is None:
                    tables = table(held[CODES]), (table(held[WORDS]) if held[WORDS] else None)
                    held = {CODES: [], WORDS: []}
                yield score(row, *tables, memo)

    rows = replies.unionByName(texts).repartition("block").sortWithinPartitions("block", F.desc("kind"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                "base_score double, score double, n_bytes long").withColumn(
        "train_tokens", F.lit(n).cast("long"))


def language_model(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Base and model scores (log10) of every text, and the model's code length per byte.

    Learns from the rows whose crc32 of the id, modulo held_out[0], is not held_out[1].
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = int(min(MOST_ROUTES, max(16, size // BLOCK_BYTES)))
    path = scratch_path(spark, "ctw")
    extract(docs, routes, *held_out).write.partitionBy("kind").parquet(f"{path}/blocks")
    names = [c.split()[0] for c in PACKED.split(", ")]
    rows = spark.read.schema(PACKED).parquet(f"{path}/blocks").select(*names)
    counted = rows.filter(F.col("kind") != DOCS)
    texts = rows.filter(F.col("kind") == DOCS)
    totals(counted).write.parquet(f"{path}/totals")
    models = spark.read.parquet(f"{path}/totals")
    found = summary(models).collect()
    nodes = [r for r in found if r.kind == CODES]
    column = lambda c, t: np.array([r[c] for r in nodes], t)
    top = Top(column("key", np.uint64), column("log_w", float), column("zeros", np.int64), column("ones", np.int64))
    n_distinct = sum(r.zeros for r in found if r.kind == WORDS)
    n_words = sum(r.ones for r in found if r.kind == WORDS)
    # Every training text has one end, and ends are the only line feeds.
    n_train = _ends(top) if nodes else 0
    return scored(texts, answers(models, counted, top), n_words, n_distinct, n_train).withColumn(
        "bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes")).select(
            "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def _ends(top: Top) -> int:
    """How often the byte END was learnt: the count of its last binary decision at depth 0."""
    level = top.levels[0]
    at = np.searchsorted(level.key, np.uint64(1 << 7 | END >> 1))
    return int((level.ones if END & 1 else level.zeros)[at])
