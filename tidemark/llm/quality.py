"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, white space collapsed) and hashed. For each host the distinct documents that hold a
line are counted: equal texts of a host count as one document. A line above the limit is removed from every document
of the host but the one with the smallest id among all that hold it, copies included, and a document that keeps too
small a share of its words is rejected.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; rows with the
same id are judged each by its own text, and all of them hold a line first if the id does; documents without an id come
after those with one, in the order of a hash of their texts, and equal ones are one document; an empty table gives no
rows; other columns are never read. The order of the rows has no part in any result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, ship, texts, written
from .words import WHITE_BYTES, hashes, windows

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Base rules: least words, largest share (percent) of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: A line is common when over LINE_DOCUMENTS distinct documents of its host hold it, whatever the host's size.
LINE_DOCUMENTS = 20
#: A document is depleted when fewer than this share of its words is left.
LEAST_LEFT = 0.3

WHITE = WHITE_BYTES.decode()


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more, the first included."""
    if len(words) <= window:
        return 0
    w = windows(words, window)
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int32)
    begins = np.flatnonzero(twice)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of the distinct normalised lines and their words."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    raw = text.encode()
    words = hashes(raw)
    kept = len(text) - sum(raw.count(bytes([c])) for c in WHITE_BYTES)
    seen: set[str] = set()
    lines: dict[int, int] = {}
    duplicates = 0
    for line in text.split("\n"):
        parts = line.encode().lower().split() if line.isascii() else line.lower().encode().split()
        if not parts:
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63)
        lines[h] = lines.get(h, 0) + len(parts)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    return len(words), kept, symbols, duplicates, repeated_words(words), list(lines), list(lines.values())


def quality(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, the base measures, base_failed, words_left (after common lines are removed), kept, text_hash (xxhash64) and host of every row."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
    rows = texts(docs, "text", "doc_id", F.col(host_col).cast("string").alias("host"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    base = map_rows(rows, schema, lambda: lambda doc_id, text, host, text_hash: (doc_id, host, text_hash, *measure(text)))
    base = written(spark, base.withColumn("row", F.monotonically_increasing_id()), "quality")
    # one row of each distinct text of a host stands for its copies; its holder is the first of them
    holder = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    first = base.where("n_words > 0").groupBy("host", "text_hash").agg(F.min("row").alias("row"), F.min(holder).alias("holder")).select("row", "holder")
    lines = base.select("row", "host", "lines").join(first, "row").select("host", "holder", F.explode("lines").alias("line"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min("holder").alias("first")).where(F.col("documents") > LINE_DOCUMENTS)
    common = common.select(F.col("host").alias("at"), "line", "first")
    of_row = base.select("row", "doc_id", "text_hash", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "doc_id", "text_hash", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    holds = F.when(F.col("doc_id").isNull(), F.col("first.nameless") & (F.col("first.text_hash") == F.col("text_hash"))).otherwise(~F.col("first.nameless") & (F.col("first.doc_id") == F.col("doc_id")))
    gone = of_row.join(common, (of_row.line == common.line) & of_row.host.eqNullSafe(common["at"])).where(~F.coalesce(holds, F.lit(False)))
    gone = gone.groupBy("row").agg(F.sum("n").alias("gone"))
    out = base.drop("lines", "line_words").join(gone, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("words_left") >= LEAST_LEFT * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left", "text_hash", "host")


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "host")
