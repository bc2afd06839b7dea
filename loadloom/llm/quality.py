"""Quality rules as a ledger of failure bits, and policies over it.

``ledger`` evaluates every rule once and keeps the measurements and one bit per rule.
``apply_policy`` and ``ablation`` read only the bits, so a new policy version needs no new
pass over the texts. Everything is a built-in function; no Python runs on the executors.

Defined results: a null or empty text has no words and fails ``few_words``. Repeated rows are
judged row by row. Other columns are kept by ``ledger`` unless they carry a ledger name,
in which case the ledger's value replaces them. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_alpha_words", "n_letters", "n_upper", "n_marks")

#: Rule name -> condition of failure over the measurements (integers only), in bit order.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_words": "n_words > 100000",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "few_alpha_words": "100 * n_alpha_words < 55 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "marks": "2 * n_marks > n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: Policy version -> the rules that reject. Versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "repetition": (*BASE, "repeated_lines"),
    "v1": tuple(RULES),
    # Length alone is no fault: book-length documents stay.
    "v2": tuple(name for name in RULES if name != "many_words"),
}
DEFAULT_POLICY = "v2"


def mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


def _windows(word: str) -> Column:
    """64-bit hashes of the word windows; two windows of one text count as equal by hash."""
    w = F.col(word)
    at = [lambda i, k=k: F.get(w, i + k) for k in range(WINDOW)]
    return F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*(get(i) for get in at)))).otherwise(
            F.array().cast("array<bigint>"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements of every row, beside its other columns.

    A repeated word is one inside a word window that occurs twice or more. The windows'
    hashes are sorted with their positions, so a long text costs n log n.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    base = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    base = base.select(*kept, "__t", T.words(F.col("__t")).alias("__w"),
                       F.filter(F.split("__t", "\n"), lambda x: x.rlike(T.WORD)).alias("__l"))
    base = base.select(
        *kept, F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter("__w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        F.length(F.regexp_replace("__t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("__t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.regexp_count("__t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        _windows("__w").alias("__g"))
    names = [c for c in base.columns if c != "__g"]
    # Each step is used more than once by the next, so the optimizer keeps it a column.
    base = base.select(*names, F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    s = F.col("__s")
    same = lambda k, j: F.get(s, k)["h"].eqNullSafe(F.get(s, j)["h"])
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k:
                     ((k > 0) & same(k, k - 1)) | ((k < F.size(s) - 1) & same(k, k + 1)))
    base = base.select(*names, F.when(F.size(s) > 0, F.sort_array(
        F.transform(twice, lambda k: F.get(s, k)["i"]))).otherwise(
            F.array().cast("array<int>")).alias("__p"))
    covered = F.aggregate(
        "__p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x + WINDOW - a["end"])).alias("n"),
                              (x + WINDOW).alias("end")), lambda a: a["n"])
    # A later filter on the result must not be pushed below these steps, where each of its mentions
    # would be computed again inside the lambdas; an indeterminate condition that always holds stops it.
    fence = F.monotonically_increasing_id() >= 0
    return base.select(*names, F.when(fence, covered).alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i fails."""
    out = measure(docs.drop("fail_bits"), text)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0))
            for name, rule in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return out.withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Add ``base_failed`` and ``kept`` by the bits alone."""
    bits = F.col("fail_bits")
    failed = bits.bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumns({
        "base_failed": failed,
        "kept": ~failed & (bits.bitwiseAND(F.lit(mask(version))) == 0)})


def ablation(rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: rows that fail it, rows rejected by it alone, rows kept in all.

    One aggregation over the distinct bit patterns; at most 2^rules rows are shuffled.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plans = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(mask(v)).cast("long").alias("mask"),
                               F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
                      for v in versions for r in POLICIES[v]))
    hit = F.col("fail_bits").bitwiseAND(F.col("p.mask"))
    part = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return patterns.withColumn("p", F.explode(plans)).groupBy("p.policy", "p.rule").agg(
        part(F.col("fail_bits").bitwiseAND(F.col("p.bit")) != 0).alias("n_fail"),
        part(hit == F.col("p.bit")).alias("n_only"),
        part(hit == 0).alias("n_kept"))


def filter_documents(docs: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The rows that the policy keeps, with their own columns."""
    columns = docs.columns
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), "text")
    good = apply_policy(ledger(tagged), version).filter("kept")
    return good.select(*(F.col("__row")[c].alias(c) for c in columns))
