"""Benchmark passages in documents, by winnowed fingerprints.

A window is a run of ``WINDOW`` item words, or a shorter item as a whole. Of every window the
smallest hash of its runs of k words is kept (the first one on ties), on both sides by the same rule. A
document span equal to a window thus keeps the same run at the same offset, and no occurrence is
missed. Kept hashes that both sides have are extended to the spans around them, and the spans' words
are compared with the windows themselves. All steps are DataFrame functions.

Defined results: only A-Z are lower-cased; a word is a run of digits, letters a-z and characters beyond
ASCII. Null and word-free texts have no windows. Equal texts are searched once and share their result, rows
that repeat an id are judged one by one. An item_id of several rows owns the windows of all; windows of rows without
an item_id mark words but name no item. Columns beyond id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from .text import UPPER_LETTERS

WINDOW = 10
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER_LETTERS, UPPER_LETTERS.lower())
    return F.array_remove(F.split(folded, NOT_A_WORD), "")


def run_length(length: int) -> int:
    """Words in the hashed runs of a window of so many words."""
    return (length + 1) // 2


def _sliding(rows: DataFrame, name: str, length: int, combine) -> DataFrame:
    """Replace the array column by one value for each of its runs of ``length`` elements, doubling the runs;
    ``combine`` gets the values of two shorter runs that cover the longer one.

    Every step is a projection of its own, so that no array is computed twice."""
    def shifted(step):
        left = F.greatest(F.size(name) - step, F.lit(0))
        return F.zip_with(F.slice(F.col(name), F.lit(1), left), F.slice(F.col(name), F.lit(step + 1), left), combine)

    size = 1
    while size < length:
        step = min(size, length - size)
        rows = rows.withColumn(name, shifted(step))
        size += step
    return rows


def run_hashes(rows: DataFrame, length: int) -> DataFrame:
    """The rows with ``hashes`` in place of ``words``: a hash of every run of words."""
    one = rows.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x))).drop("words")
    return _sliding(one, "hashes", run_length(length), lambda a, b: F.xxhash64(a, b))


def kept_hashes(rows: DataFrame, length: int) -> DataFrame:
    """The rows with ``hashes`` reduced to the smallest one of every window, each once."""
    least = _sliding(rows, "hashes", length - run_length(length) + 1, lambda a, b: F.least(a, b))
    return least.withColumn("hashes", F.array_distinct("hashes"))


def exploded(rows: DataFrame, name: str) -> DataFrame:
    """One row per element of the array column. An inner explode would make Spark test the array's
    size first, by computing it a second time."""
    others = [c for c in rows.columns if c != name]
    return rows.select(*others, F.explode_outer(name).alias(name)).filter(F.col(name).isNotNull())


def windows(items: DataFrame) -> DataFrame:
    """(item_id, window, length): the distinct windows of every item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice(F.col("w"), i, length))
    return w.select("item_id", F.explode_outer(cut).alias("words"), length.alias("length")).select(
        "item_id", F.concat_ws(" ", "words").alias("window"), "length").distinct()


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written and reread: an executor may be lost, and Spark knows the size when it joins."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _spans(near: DataFrame, own: DataFrame, length: int) -> DataFrame:
    """(key, start, length) of the spans around a run that a window keeps; ``near`` has (key, words)."""
    # All places of a window's smallest hash are offsets; where it occurs twice there, both lead to the window.
    runs = run_hashes(own, length).select(F.posexplode_outer("hashes").alias("offset", "hash"), F.array_min("hashes").alias("least"))
    wanted = _written(runs.filter("hash = least").select("hash", "offset").distinct(), "runs")
    places = run_hashes(near, length).select("key", F.posexplode_outer("hashes").alias("place", "hash"))
    return places.filter("hash IS NOT NULL").join(wanted, "hash").select(
        "key", (F.col("place") - F.col("offset") + 1).alias("start"), F.lit(length).alias("length")).filter("start >= 1").distinct()


def searched(docs: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(doc_id, key, n_words) of every row, and the keys of the texts that keep a hash which a window keeps."""
    # At most WINDOW lengths.
    lengths = sorted(r[0] for r in owned.select("length").distinct().collect())
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("words")).withColumn(
        "n_words", F.size("words").cast("long"))
    for length in lengths:
        mine = base.withColumn("words_", F.col("words"))
        mine = kept_hashes(run_hashes(mine, length), length)
        base = mine.withColumnsRenamed({"hashes": f"kept{length}", "words_": "words"})
    base = _written(base.drop("words"), "kept")
    keys = None
    for length in lengths:
        own = owned.filter(F.col("length") == length).select(F.split("window", " ").alias("words")).distinct()
        wanted = _written(exploded(kept_hashes(run_hashes(own, length), length), "hashes").distinct(), "wanted")
        found = exploded(base.select("key", F.col(f"kept{length}").alias("hashes")), "hashes")
        part = found.join(wanted, "hashes", "left_semi").select("key")
        keys = part if keys is None else keys.unionByName(part)
    return base.select("doc_id", "key", "n_words"), keys and _written(keys.distinct(), "near"), lengths


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of the documents' texts that equal a window, as (key, start, length, window) with the
    text's key, each once; the windows as ``windows`` gives them; and (doc_id, key, n_words)."""
    owned = _written(windows(items), "windows")
    rows, keys, lengths = searched(docs, owned)
    if keys is None:
        return docs.sparkSession.createDataFrame([], "key binary, start int, length int, window string"), owned, rows
    # Only texts with a hit are cut into words again, each once.
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi")
    near = _written(texts.groupBy("key").agg(F.any_value("text").alias("text")).select(
        "key", words(F.col("text")).alias("words")), "near")
    spans = None
    for length in lengths:
        own = owned.filter(F.col("length") == length).select(F.split("window", " ").alias("words")).distinct()
        part = _spans(near, own, length)
        spans = part if spans is None else spans.unionByName(part)
    cut = spans.join(near, "key").filter(F.col("start") + F.col("length") - 1 <= F.size("words")).select(
        "key", "start", "length", F.concat_ws(" ", F.slice("words", F.col("start"), F.col("length"))).alias("window"))
    found = cut.join(owned.select("window").distinct(), "window", "left_semi")
    return _written(found, "occurrences"), owned, rows


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found, owned, rows = occurrences(docs, items)
    hit = found.select("key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct().groupBy(
        "key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("key", "window").distinct().join(owned.filter("item_id IS NOT NULL"), "window").select(
        "key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    by_text = _written(hit.join(named, "key", "left"), "hits")
    zero = F.lit(0).cast("long")
    return rows.join(by_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
