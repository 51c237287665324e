"""The limit of common lines does not grow with the host."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import quality


def test_a_line_is_common_in_a_large_host_too(spark):
    common, own = "this boilerplate line of nine words stands often here\n", " ".join(f"w{j}" for j in range(12))
    text = F.concat(F.when(F.col("id") % 800 == 7, common).otherwise(""), F.lit(f"{own} x"), F.col("id").cast("string"))
    frame = spark.range(23_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("large").alias("source"))
    out = quality.quality(frame).where("doc_id % 800 = 7").select("doc_id", "n_words", "words_left").collect()
    assert len(out) == 29 and all(r.n_words - r.words_left == (0 if r.doc_id == 7 else 9) for r in out)
