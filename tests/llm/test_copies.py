"""Near copies on five-word shingles against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loadloom.llm import copies, simhash
from test_operators import DOC, SF, lower, words


def plain_set(t):
    w = words(lower(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def smallest_of_groups(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            if near(sets[x][1], sets[y][1]):
                up[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[root(x)] = min(low.get(root(x), i), i)
    return set(low.values())


def test_stage_joins_edited_copies_beyond_four_bits(spark):
    rng = np.random.default_rng(2)
    text = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    edited = list(text)
    for at in range(20, 400, 50):
        edited[at] = "changed"
    far = list(text)
    for at in range(5, 400, 20):
        far[at] = "changed"
    texts = [" ".join(x) for x in (text, edited, far)]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert near(plain_set(texts[0]), plain_set(texts[1])) and (prints[0] ^ prints[1]).bit_count() > simhash.MAX_BITS
    assert not near(plain_set(texts[0]), plain_set(texts[2])) and not near(plain_set(texts[1]), plain_set(texts[2]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()} == {0, 2}


def test_first_of_each_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = copies.first_of_each(docs.withColumn("fp", F.lit("x")))
    want = smallest_of_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert first.columns == [*docs.columns, "fp"] and {r.doc_id for r in first.collect()} == want
    assert first.count() == len(want)


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(4, None), (3, " \n"), (9, "One two"), (8, "one  TWO"), (None, line), (None, line), (7, "one"),
            (None, "other words"), (None, "Other words"), (5, line), (5, line)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC)
    got = sorted(((r.doc_id is None, r.doc_id or 0, lower(r.text)) for r in copies.first_of_each(docs).collect()))
    assert got == [(False, 3, " \n"), (False, 5, line), (False, 7, "one"), (False, 8, "one  two"), (True, 0, "other words")]
    assert copies.first_of_each(docs.limit(0)).count() == 0


def test_different_texts_under_one_id_are_kept(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, b), (5, a), (5, b + " tail"), (9, a + " end"), (None, a + " z"), (7, "one two"), (7, "three"), (7, "three")]
    for some, want in ((rows, [(3, b), (5, a), (7, "one two"), (7, "three")]), ([(5, a), (5, b)], [(5, a), (5, b)])):
        docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in some], DOC)
        assert sorted((r.doc_id, r.text) for r in copies.first_of_each(docs).collect()) == sorted(want)


def test_pairs_of_the_bar_share_a_key(spark):
    """Recall of the bands: every pair of different sets at 0.8 or more, found by inverted shingle lists."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sets = {copies.set_hash(s): s for t in texts if len(s := copies.shingles((t or "").encode()))}
    keys = {i: set(copies.band_keys(s).tolist()) for i, s in sets.items()}
    lists = {}
    for i, s in sets.items():
        for x in s.tolist():
            lists.setdefault(x, []).append(i)
    pairs = {(i, j) for own in lists.values() for at, i in enumerate(own) for j in own[:at]}
    near_pairs = [(i, j) for i, j in pairs if copies.similar(sets[i], sets[j])]
    assert len(near_pairs) >= 5 and all(keys[i] & keys[j] for i, j in near_pairs)


def test_pairs_without_a_shared_band_are_linked(spark):
    """Pairs at exactly 0.8 that no band key joins: four shingles of five."""
    rows = []
    for i in (10054, 27630, 77783, 115764):
        text = " ".join(f"{w}{i}" for w in "abcdefgh")
        rows += [(2 * i, text), (2 * i + 1, f"{text} i{i}"), (2 * i + 2, f"{text} i{i} j{i} k{i}")]
        a, b = (set(copies.band_keys(copies.shingles(t.encode())).tolist()) for _, t in rows[-3:-1])
        assert not a & b and near(plain_set(rows[-3][1]), plain_set(rows[-2][1]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC)
    want = smallest_of_groups(rows)
    assert len(want) == 8 and {r.doc_id for r in copies.first_of_each(docs).collect()} == want


def test_groups_without_any_band(spark):
    """The prefix search alone finds all links, null ids, empty texts and a line in every text included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, line, rows = np.random.default_rng(4), " ".join(f"line{i}" for i in range(30)), []
    for i in range(60):
        words_ = [f"x{x}" for x in rng.integers(0, 500, rng.integers(1, 90))]
        for j in range(rng.integers(1, 4)):
            rows.append((1_000_000 + 10 * i + j, line + " " + " ".join(words_)))
            for at in rng.integers(0, len(words_), 2):
                words_[at] = f"y{rng.integers(0, 500)}"
    rows += [(2_000_000, None), (2_000_001, ""), (2_000_002, line), (2_000_003, line.upper())]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC))
    prints = copies.signatures(docs).withColumn("keys", F.array().cast("array<long>"))
    found = copies.grouped(prints, docs).groupBy("root").agg(F.min("doc_id")).collect()
    want = smallest_of_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert len(found) == len(want) and {r[1] for r in found} == want


def test_rarest_shingles_hold_every_pair(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 10, 11, 40, 333):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            least = -(-4 * n // 5)
            b = np.unique(np.concatenate([rng.permutation(a)[:rng.integers(least, n + 1)], rng.integers(0, 1 << 63, n // 5, np.uint64)]))
            load = rng.integers(0, 3, 1 << copies.CELL_BITS).astype(np.uint32)
            x, y = copies.rare_shingles(a, load).tolist(), copies.rare_shingles(b, load).tolist()
            assert len(x) == n - least + 1
            if copies.similar(a, b):
                first = next(i for i, v in enumerate(x) if v in y)
                assert 9 * min(len(a) - first, len(b) - y.index(x[first])) >= 4 * (len(a) + len(b))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A B C D E"), (None, None)], "doc_id long, text string")
    want = [copies.cells(copies.shingles(t)) for t in (b"a b c d e f", b"a b c d e")]
    assert (copies.loads(docs) == np.bincount(np.concatenate(want), minlength=1 << copies.CELL_BITS)).all()
