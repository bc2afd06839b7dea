"""Inputs beyond what the test tables hold."""

from pyspark.sql import functions as F

from loadloom.llm import quality
from test_operators import DOC


def test_clean_book_length_document_stays(spark):
    # Distinct words, so that nothing repeats.
    book = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(100_500)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"),
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert book.schema.names == spark.createDataFrame([], DOC).schema.names
    rows = quality.ledger(book)
    assert rows.first().fail_bits == quality.BITS["many_words"]
    assert quality.filter_documents(book).count() == 1 and not quality.apply_policy(rows, "v1").first().kept
