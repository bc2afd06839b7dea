"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, distance-weighted votes.

A bounded sample of labelled documents, without near-copies, is the example set. Its terms (lower-cased runs of
letters, and their first four and five letters) that lean to the label form the vocabulary;
their document frequencies are counted over all documents. Examples lie in blocks of an
inverted index that keeps, per term, the largest weight of each block. A query visits
blocks by the sum of these maxima and stops when no block can reach its k-th neighbour, so
the neighbours are exact. Votes are calibrated by the leave-one-out votes of the examples.

Defined results: a null or empty text, or one without a vocabulary term, gets the rate of the
label among examples without one. Several labels of one document count as 1 if any is 1; null
labels are left out. Repeated rows get the same score. With labels of one kind only, or none,
or no term that leans to the label, nothing tells documents apart: every score is the label's rate, but
at most one half (0 without labels), so none is rejected. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, scratch_path
from .text import slices

#: Bounds of what is fitted on the driver; documents are never bounded.
MAX_EXAMPLES = 20_000
MAX_TERMS = 4_096
MAX_CALIBRATION = 2_000
NEIGHBOURS = 15
BLOCK = 64
MIN_DOCS = 3
#: Expected number of terms that pass the test of association by chance.
CHANCE = 0.1
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Counts of the words and, marked by a tilde, of their first letters."""
    words = Counter(_LETTERS.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in (4, 5):
            if len(word) > k:
                out[word[:k] + "~"] += n
    return out


@dataclass
class Index:
    """Block-max inverted index over the examples' unit vectors."""

    ids: np.ndarray
    labels: np.ndarray
    rows: list[dict[int, float]]
    n_terms: int
    tops: np.ndarray = field(init=False)
    lists: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(init=False)

    def __post_init__(self):
        blocks = -(-len(self.rows) // BLOCK)
        self.tops = np.zeros((self.n_terms, blocks))
        lists: list[dict[int, tuple[list, list]]] = [{} for _ in range(blocks)]
        for i, row in enumerate(self.rows):
            for t, w in row.items():
                at, ws = lists[i // BLOCK].setdefault(t, ([], []))
                at.append(i % BLOCK), ws.append(w)
                self.tops[t, i // BLOCK] = max(self.tops[t, i // BLOCK], w)
        self.lists = [{t: (np.array(a), np.array(w)) for t, (a, w) in x.items()} for x in lists]

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties to the smaller id."""
        if not query or not self.rows:
            return []
        terms, weights = list(query), np.array(list(query.values()))
        bound = weights @ self.tops[terms]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-9:
                break
            score = np.zeros(BLOCK)
            for t, w in query.items():
                if (hit := self.lists[b].get(t)) is not None:
                    score[hit[0]] += w * hit[1]
            for j in np.flatnonzero(score > 0).tolist():
                if (i := b * BLOCK + j) != skip:
                    best.append((-float(score[j]), int(self.ids[i]), i))
            best = sorted(best)[:k]
        return [(-s, i) for s, _, i in best]


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: Index
    rate: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, text: str | None) -> dict[int, float]:
        if not self.vocabulary:
            return {}
        found = {self.vocabulary[t]: (1 + math.log(n)) * self.idf[self.vocabulary[t]]
                 for t, n in terms_of(text).items() if t in self.vocabulary}
        size = math.sqrt(sum(w * w for w in found.values()))
        return {t: w / size for t, w in found.items()} if size else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Labels of the neighbours, weighted by inverse distance, with one vote for the rate."""
        weights = [1 / (1.05 - min(s, 1.0)) for s, _ in near]
        return (sum(w * self.index.labels[i] for w, (_, i) in zip(weights, near)) + self.rate) / (
            sum(weights) + 1)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.vector(text), NEIGHBOURS)
        if not near:
            return self.rate, []
        vote = self.vote(near)
        return (float(np.interp(vote, *self.knots)) if self.knots else vote), near


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of y over x, as knots to interpolate between; pooled neighbours."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return (np.array([p[0] / p[2] for p in pools]),
            np.array([(p[1] + 0.01) / (p[2] + 0.02) for p in pools]))


def _without_copies(labelled: DataFrame) -> DataFrame:
    """One example of each label and sketch: the four smallest hashes of a text's words.

    Near-copies share their sketch. As examples they would make every word of a toxic text look
    toxic, because it stands in as many toxic examples as the text has copies.
    """
    def run(batches):
        for batch in batches:
            sketch = [str(heapq.nsmallest(4, {zlib.crc32(w.encode()) for w in _LETTERS.findall((t or "").lower())}))
                      for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text"),
                 batch.column("label").cast(pa.int32()), pa.array(sketch, pa.string())],
                ["doc_id", "text", "label", "sketch"])

    rows = labelled.mapInArrow(run, "doc_id long, text string, label int, sketch string")
    first = rows.groupBy("sketch", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return first.select("r.doc_id", "r.text", "label")


def _term_counts(labelled: DataFrame) -> DataFrame:
    """(term, pos, neg): documents of either label that hold the term."""
    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[y].update(terms_of(text).keys())
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                 pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    return labelled.select("text", "label").mapInArrow(
        run, "term string, pos long, neg long").groupBy("term").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= MIN_DOCS)


def _vocabulary(counts: DataFrame, pos: int, neg: int) -> list[str]:
    """Terms whose likelihood-ratio statistic for the label is no chance hit, strongest first."""
    tested = counts.count()
    if not tested or not pos or not neg:
        return []
    cell = lambda seen, rate: F.when(seen > 0, 2 * seen * F.log(seen / rate)).otherwise(0.0)
    df, n, p = F.col("pos") + F.col("neg"), pos + neg, pos / (pos + neg)
    g2 = (cell(F.col("pos"), df * p) + cell(F.col("neg"), df * (1 - p))
          + cell(F.lit(pos) - F.col("pos"), (n - df) * p) + cell(F.lit(neg) - F.col("neg"), (n - df) * (1 - p)))
    rows = counts.filter(F.col("pos") * 2 > df).withColumn("g2", g2).filter(
        F.col("g2") >= 2 * math.log(tested / CHANCE)).orderBy(F.desc("g2"), "term").limit(MAX_TERMS)
    return [r[0] for r in rows.select("term").collect()]


def _document_frequency(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Documents with each term, over all documents; at the end their number."""
    size = len(vocabulary)

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total[size] += batch.num_rows
            for text in batch.column("text").to_pylist():
                for t in terms_of(text).keys() & vocabulary.keys():
                    total[vocabulary[t]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(total)], ["t", "n"])

    out = np.zeros(size + 1)
    for t, n in docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        out[t] = n
    return out


def _rate(n: dict[int, int]) -> float:
    """Share of label 1, drawn towards 0.1 by one more example; 0 without examples."""
    return (n.get(1, 0) + 0.1) / (sum(n.values()) + 1) if n else 0.0


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from labelled rows that are not held out: ``MAX_EXAMPLES`` of them at most, chosen
    by a hash of their id. The sample's ids are broadcast; that bound limits their size."""
    sample = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    n_labels = sample.count()
    if n_labels > MAX_EXAMPLES:
        # A share of the hashes instead of a sorted limit: no task or driver gathers candidates. Two
        # per cent below the bound, nearly three deviations of the binomial at the default size.
        share = int((1 << 40) * 0.98 * MAX_EXAMPLES / n_labels)
        sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share)
    path = scratch_path(docs.sparkSession, "examples")
    _without_copies(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).write.parquet(path)
    labelled = docs.sparkSession.read.parquet(path)
    n = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    terms = _vocabulary(cut_lineage(_term_counts(labelled)), n.get(1, 0), n.get(0, 0))
    model = Model({t: i for i, t in enumerate(terms)}, np.ones(len(terms)), Index(
        np.zeros(0, np.int64), np.zeros(0), [], len(terms)), min(_rate(n), 0.5))
    if not terms:
        return model
    df = _document_frequency(docs, model.vocabulary)
    model.idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    vector, kind = model.vector, "doc_id long, label int, terms array<int>, weights array<double>"

    def vectors(batches):
        for batch in batches:
            got = [vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()),
                 pa.array([list(v) for v in got], pa.list_(pa.int32())),
                 pa.array([list(v.values()) for v in got], pa.list_(pa.float64()))],
                ["doc_id", "label", "terms", "weights"])

    rows = cut_lineage(labelled.mapInArrow(vectors, kind))
    bare = {r[0]: r[1] for r in rows.filter("size(terms) = 0").groupBy("label").count().collect()}
    model.rate = _rate(bare)
    # Like examples side by side: sorted by their heaviest term, blocks get tight maxima.
    found = sorted(rows.filter("size(terms) > 0").collect(), key=lambda r: (
        max(zip(r.weights, r.terms))[1], sorted(r.terms), r.doc_id))
    model.index = Index(np.array([r.doc_id for r in found], np.int64), np.array([float(r.label) for r in found]),
                        [dict(zip(r.terms, r.weights)) for r in found], len(terms))
    step = max(1, -(-len(found) // MAX_CALIBRATION))
    at = range(0, len(found), step)
    votes = [(model.vote(near), model.index.labels[i]) for i in at
             if (near := model.index.nearest(model.index.rows[i], NEIGHBOURS, skip=i))]
    if len({y for _, y in votes}) == 2 and len(votes) >= 50:
        model.knots = monotone(*map(np.array, zip(*votes)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score, prediction and evidence (nearest examples, the highest cosine) of every row."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [model.score(t) for t in texts]
            ids = model.index.ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([s for s, _ in got], pa.float64()),
                 pa.array([[int(ids[i]) for _, i in near[:3]] for _, near in got], pa.list_(pa.int64())),
                 pa.array([near[0][0] if near else 0.0 for _, near in got], pa.float64())],
                ["doc_id", "score", "neighbours", "similarity"])

    out = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, neighbours array<long>, similarity double")
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "similarity")


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows scored below the threshold, with their own columns."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                good = [model.score(t)[0] < THRESHOLD for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
