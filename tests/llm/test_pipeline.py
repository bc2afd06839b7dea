"""The corpus pipeline against plain computations, stage by stage and as a whole."""

from collections import Counter

import corpus_pipeline as pipeline
from loadloom.llm import mixing, quality, toxicity
from loadloom.session import scratch_path
from test_copies import smallest_of_groups
from test_operators import SF, check_packing, plain_measures, words


def stored(spark, df):
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "source_mix", "packing"]

    clean = stored(spark, stages["toxicity"](spark, docs, SF))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.score(r.text)[0] < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == columns

    good = stored(spark, stages["quality_rules"](spark, clean, SF))
    data = {r.doc_id: r.text for r in clean.collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and kept.items() <= data.items()
    for i, t in data.items():
        n, _, symbols, _, repeated = plain_measures(t)
        base = n < 10 or 100 * repeated > 20 * n or 10 * symbols > 3 * n
        assert not (base and i in kept)
    bits = quality.ledger(clean).filter("fail_bits = 0").select("doc_id").collect()
    assert {r[0] for r in bits} == kept.keys()

    first = stored(spark, stages["near_duplicates"](spark, good, SF))
    assert {r.doc_id for r in first.collect()} == smallest_of_groups(list(kept.items())) and first.columns == columns

    mixed = stored(spark, stages["source_mix"](spark, first, SF))
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(taken.values()) <= {1, 2}
    sizes, by = Counter(), Counter()
    for r in first.collect():
        sizes[r.source] += len(words(r.text))
        by[r.source] += taken[r.doc_id] * len(words(r.text))
    goal = mixing.targets(dict(sizes))
    longest = max(len(words(t)) for t in kept.values())
    assert all(abs(by[s] - goal[s]) <= longest for s in goal)

    packed = stored(spark, stages["packing"](spark, mixed, SF)).collect()
    check_packing(packed, mixed.collect())
    again = pipeline.run(spark, SF)
    place = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, again.select(*place).collect())) == Counter(tuple(r[c] for c in place) for r in packed)


def test_stages_on_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, target string"
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = "every good clean document says something new in more than ten different words here"
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (None, None, None, None, None, None),
            (2, "", "en", None, 0, "x"), (None, text + " indeed", "en", "b", 1, "x"), (3, "long " * 3000, "en", "a", 1, "x")]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES:
            before = docs
            docs = stored(spark, stage(spark, docs, str(tmp_path)))
            if name != "packing":
                assert docs.columns == before.columns
                assert name == "source_mix" or docs.count() <= before.count()
        assert (docs.count() > 0) == bool(data)
