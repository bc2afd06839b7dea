"""Token ids as binary shards whose document boundaries are Elias-Fano coded.

A shard is: magic, the ids of its documents one after the other (16 or 32 bits each), a
footer, the footer's length, magic. The footer holds two Elias-Fano sequences: where documents
end, and the ascending document ids. A sequence of n numbers up to u takes about
2 + log2(u / n) bits a number; a sample of every 256th set bit gives ``select`` without a table of
64-bit offsets. Shards cover ascending ranges of document ids; the manifest adds up their lengths.

Defined results: a null or empty text has the end id only. Rows with a null id come first and keep
a null id; rows with repeated ids stay in separate entries, in the order of a hash of their text.
An empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import files, tokens

#: Ids that one task reads back, about.
UNIT_IDS = 4 << 20
MAGIC = b"LLIDS001"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of numbers from 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        if not n:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, "<u4"))
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        columns = [(values >> np.uint64(b) & np.uint64(1)).astype(np.uint8) for b in range(bits)]
        low = np.packbits(np.stack(columns, 1).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + (
            self.low.tobytes() + self.high.tobytes() + self.sample.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes it took."""
        n, bits, a, b = struct.unpack_from("<QBQQ", data)
        at, s = struct.calcsize("<QBQQ"), -(-n // SAMPLE)
        part = lambda kind, count, i: np.frombuffer(data, kind, count, i)
        return cls(n, bits, part(np.uint8, a, at), part(np.uint8, b, at + a),
                   part("<u4", s, at + a + b)), at + a + b + 4 * s

    def select(self, i: int, count: int = 1) -> np.ndarray:
        """Positions of the i-th set bit and those after it."""
        at = int(self.sample[i // SAMPLE])
        start, need, found, seen = at >> 3, i % SAMPLE + count + 7, [], 0
        while seen < need + 8 and start < len(self.high):
            ones = np.flatnonzero(np.unpackbits(self.high[start:start + 4 * need], bitorder="little"))
            found.append(ones + 8 * start)
            seen += len(ones)
            start += 4 * need
        ones = np.concatenate(found)
        ones = ones[np.searchsorted(ones, at):]
        return ones[i % SAMPLE:i % SAMPLE + count]

    def range(self, i: int, count: int) -> np.ndarray:
        """Numbers i to i + count - 1."""
        count = max(0, min(count, self.n - i))
        if not count:
            return np.zeros(0, np.int64)
        value = (self.select(i, count) - np.arange(i, i + count)) << self.low_bits
        if self.low_bits:
            first, last = i * self.low_bits, (i + count) * self.low_bits
            bits = np.unpackbits(self.low[first >> 3:-(-last // 8)], bitorder="little")
            bits = bits[first % 8:first % 8 + last - first].reshape(count, self.low_bits)
            value |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits))
        return value

    def __getitem__(self, i: int) -> int:
        return int(self.range(i, 1)[0])


class ShardWriter:
    def __init__(self, stream, width: int):
        self.stream, self.width, self.ends, self.ids, self.nulls = stream, width, [0], [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.stream.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.ends.append(self.ends[-1] + len(ids))
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> None:
        base = self.ids[0] if self.ids else 0
        footer = struct.pack("<BQq", self.width, self.nulls, base) + EliasFano.encode(
            np.array(self.ends)).to_bytes() + EliasFano.encode(
                np.array([i - base for i in self.ids], np.uint64)).to_bytes()
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.stream.close()


class Shard:
    """Random access to a shard: ``document(i)`` and ``offset(i)`` need no table."""

    def __init__(self, path: str):
        self.file = files.open_input(path)
        size, tail = self.file.size(), len(MAGIC) + 8
        end = self.file.read_at(tail, size - tail)
        if self.file.read_at(len(MAGIC), 0) != MAGIC or end[8:] != MAGIC:
            raise ValueError(f"{path} is no complete shard")
        length = struct.unpack_from("<Q", end)[0]
        footer = self.file.read_at(length, size - tail - length)
        self.width, self.nulls, self.base = struct.unpack_from("<BQq", footer)
        at = struct.calcsize("<BQq")
        self.ends, used = EliasFano.from_bytes(footer[at:])
        self.doc_ids, _ = EliasFano.from_bytes(footer[at + used:])
        self.n = self.ends.n - 1

    def offset(self, i: int) -> int:
        return self.ends[i]

    def ids(self, first: int, last: int) -> np.ndarray:
        data = self.file.read_at((last - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.ends.range(i, 2).tolist())

    def scan(self, first: int = 0, last: int | None = None, step: int = 512):
        """Batches of (document ids, boundaries, ids of all of them), of the documents first to last - 1."""
        last = self.n if last is None else last
        for i in range(first, last, step):
            k = min(step, last - i)
            ends = self.ends.range(i, k + 1)
            nulls = max(0, min(k, self.nulls - i))
            named = self.doc_ids.range(i + nulls - self.nulls, k - nulls) + self.base
            yield [None] * nulls + named.tolist(), ends, self.ids(int(ends[0]), int(ends[-1]))


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write shards in ascending order of doc_id; returns the manifest
    (shard, path, n_docs, n_ids, base), which is kept below the folder as well."""
    spark = docs.sparkSession

    def run(batches):
        encoder = tokens.encoder(vocabulary)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end, writer, shard = np.array([end_id], "<u4"), None, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, data in tokens.encoded(batch, encoder):
                if writer is None:
                    path, stream = files.create(folder, f"shard-{shard:06d}", ".ids")
                    writer = ShardWriter(stream, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(data, "<u4"), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "path": path, "n_docs": len(writer.ends) - 1, "n_ids": writer.ends[-1]}])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").write.parquet(
        f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard; ``base`` is the number of ids in the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn(
        "base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(shards: DataFrame, most: int = UNIT_IDS) -> DataFrame:
    """Every document of the shards: its place, length and the crc32 of its ids. A task reads a
    range of documents with about ``most`` ids; select structures find its offsets."""
    def run(batches):
        for batch in batches:
            for path, base, *part in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "first", "last"))):
                for doc_ids, ends, ids in Shard(path).scan(*part):
                    cut = (ends - ends[0]).tolist()
                    data = ids.tobytes()
                    crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(ends[:-1] + base, pa.int64()),
                         pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = F.least(F.greatest(F.lit(1), F.ceil(F.col("n_ids") / most)), F.col("n_docs"))
    units = shards.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "path", "base", "shard", "k", F.expr("k * n_docs div n").alias("first"), F.expr("(k + 1) * n_docs div n").alias("last"))
    return files.dealt(units, "shard", "k").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
