"""Hard negatives and benchmark passages against brute force, with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loadloom.llm import decontaminate, negatives
from test_operators import DOC, LONG, lower

VECTOR = "vec_id long, label int, embedding array<float>"
ITEM = "item_id long, text string"
NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# --- hard negatives ----------------------------------------------------------------------------

def plain_negatives(rows, every):
    """Rows as (id, label, integers); of several anchor rows with one id the smallest asks."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))
    asked = {}
    for i, label, v in rows:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in asked.items():
        others = sorted((-dot(v, w), i, m) for i, m, w in rows if i != a)
        for score, i, _ in [x for x in others if x[2] == label][:5]:
            fits = [x for x in others if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score]
            out += [(a, i, r + 1, x[1], -score, -x[0]) for r, x in enumerate(fits[:10])]
    return Counter(out)


def test_negatives_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, int(rng.integers(0, 3)), rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(400)]
    data += [(i, l, v) for i, l, v in data[:60]] + [(20, 2, data[7][2]), (30, 1, [1.0])]      # repeats, a shorter vector
    data += [(500, 1, [0.0] * 6), (510, 9, [1.0] * 6), (520, 1, [1e9] * 6)]                     # zero, alone, huge
    odd = [(None, 1, [1.0]), (530, None, [1.0]), (540, 1, None), (550, 1, [float("nan"), 1.0]), (560, 1, [None, 1.0]),
           (570, 1, [float("inf")]), (580, 1, [])]
    df = spark.createDataFrame(data + odd, VECTOR).selectExpr("*", "1 AS tile", "2 AS chunk", "3 AS v", "4 AS scores")
    ready = negatives.integers(df)
    rows = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, l, v in data + [(580, 1, [])]]
    got = negatives.hard_negatives(ready, ready.filter("vec_id % 10 = 0"))
    assert Counter(tuple(r[c] for c in NEGATIVE) for r in got.collect()) == plain_negatives(rows, 10)
    assert negatives.hard_negatives(ready.limit(0), ready.limit(0)).count() == 0


def test_one_label_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, int(i % 4 == 1), rng.integers(-2, 3, 4).astype(np.float32).tolist()) for i in range(300)]  # many ties
    ready = negatives.integers(spark.createDataFrame(data, VECTOR))
    monkeypatch.setattr(negatives, "TILE_VALUES", 150)
    monkeypatch.setattr(negatives, "CHUNK_VALUES", 40)
    got = negatives.hard_negatives(ready, ready.filter("vec_id % 20 = 0"))
    rows = [(i, l, [int(256 * x) for x in v]) for i, l, v in data]
    assert Counter(tuple(r[c] for c in NEGATIVE) for r in got.collect()) == plain_negatives(rows, 20)


def test_search_stops_before_it_has_met_all_rows():
    rng = np.random.default_rng(6)
    v = np.zeros((20_000, 8))
    v[np.arange(20_000), rng.integers(0, 8, 20_000)] = np.sort(rng.integers(1, 10_000, 20_000))
    tile = negatives.Tile(np.arange(20_000), np.zeros(20_000, np.int64), v)
    (rows, scores), = tile.search(np.ones(8), np.ones(20_000, bool), [None], [None], 5)
    assert sorted(scores.tolist(), reverse=True) == np.sort(v.sum(1))[::-1][:5].tolist() or tile.accesses == 20_000
    one = np.array([1.0, *[0.0] * 7])
    tile.accesses = 0
    (rows, scores), = tile.search(one, np.ones(20_000, bool), [None], [None], 5)
    assert scores.tolist() == np.sort(v[:, 0])[::-1][:5].tolist() and tile.accesses < 200


# --- benchmark passages ------------------------------------------------------------------------

def terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def plain_contamination(docs, items):
    cut = [(i, tuple(w[p:p + min(10, len(w))])) for i, t in items if (w := terms(t))
           for p in range(len(w) - min(10, len(w)) + 1)]
    by = {}
    for i, g in cut:
        by.setdefault(g, set()).add(i)
    out = []
    for doc, t in docs:
        w, hit, own = terms(t), set(), set()
        for n in {len(g) for g in by}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p:p + n])) in by:
                    hit.update(range(p, p + n))
                    own |= {str(i) for i in by[g] if i is not None}
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_contamination_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    items = [(1, passage), (2, "Tiny item"), (2, passage + " more"), (None, "no name here"), (3, None), (4, " ,; "), (5, "x"),
             (10, passage), (6, "ä Ö ß 漢字 a-b"), (7, "r r r r r r r r r r r r"), (8, LONG)]
    texts = [None, "", "; ,", passage.upper(), "a " + passage[:30] + " b", "tiny, ITEM! tiny", "no name here?", "x", "ä Ö ß 漢字 a b",
             "Ä ö", " ".join("r" * 11), "r " * 9, LONG, LONG + " " + passage, "tiny"]
    docs = [(i if i % 5 else None, t, "en", "s", 1) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS key", "2 AS words", "3 AS hashes", "4 AS kept10")
    bench = spark.createDataFrame(items, ITEM).selectExpr("*", "1 AS window", "2 AS length")
    assert found(decontaminate.contamination(df, bench)) == plain_contamination([(d[0], d[1]) for d in docs], items)
    none = decontaminate.contamination(df, bench.limit(0))
    assert found(none) == plain_contamination([(d[0], d[1]) for d in docs], [])
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=6),
       st.lists(st.lists(st.sampled_from("abc"), max_size=16), min_size=1, max_size=4))
@settings(max_examples=8, deadline=None)
def test_few_words_and_many_ties(spark, docs, items):
    docs, items = ([(i, " ".join(t)) for i, t in enumerate(x)] for x in (docs, items))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, ITEM))
    assert found(got) == plain_contamination(docs, items)


@pytest.mark.parametrize("length", range(1, 11))
def test_equal_windows_keep_a_hash_in_common(spark, length):
    """The guarantee: wherever a window stands, one of its kept hashes is kept in the text as well."""
    rng = np.random.default_rng(length)
    window = [f"w{x}" for x in rng.integers(0, 3, length)]
    texts = [[f"w{x}" for x in rng.integers(0, 3, a)] + window + [f"w{x}" for x in rng.integers(0, 3, b)]
             for a, b in rng.integers(0, 12, (20, 2))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([window, *texts])], "id int, words array<string>")
    kept = {r.id: set(r.hashes) for r in decontaminate.kept_hashes(decontaminate.run_hashes(df, length), length).collect()}
    assert len(kept[0]) == 1 and all(kept[0] <= kept[i] for i in kept)
