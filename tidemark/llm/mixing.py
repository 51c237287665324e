"""Mixing sources to target weights by hierarchical budgeting.

Documents are counted in tokens of a vocabulary file (or in words, where none is given); everything after that is
DataFrame functions. A budget of tokens goes down a tree (domain, language, source). At each node it is dealt to the
children by weight; a child takes no more than its subtree holds over all epochs, and what it cannot take goes to its siblings by weight.
Only what a whole subtree cannot take stays with its parent's level, so siblings come before ancestors. Each leaf then
takes its documents in whole seeded epochs, and a token prefix of the next epoch's order.

The prefix is found without sorting a leaf in one task: tokens are summed by leaf and range of the epoch's hash (at most
2 ** RANGE_BITS sums a leaf); only the documents of the one range where the quota ends are ordered.

Defined results: null texts have no tokens and are taken with any whole epoch and any prefix that reaches them; null
levels are leaves of their own; unlisted values have weight 1; documents of weight 0 or less are never taken; rows of
one key in a leaf are separate documents that are taken together; an empty table gives no rows; other columns are kept
aside by key only.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import schema_of, ship, written
from .token_files import library_encoder

#: Ranges of the hash that a leaf's order is cut into: 2 ** RANGE_BITS.
RANGE_BITS = 12


class _Counts:
    """Batches (key, lang, source, text): the number of ids in place of the text."""

    def __init__(self, encoder, schema):
        self.encoder, self.schema = encoder, schema

    def __call__(self, batches):
        counts = self.encoder().counts
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts(part.column(3).to_pylist()), pa.int64())], schema=self.schema)


def weight_of(level: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(level == kv[0], F.lit(float(kv[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(1.0)) if weights else F.lit(1.0)


def dealt(nodes: DataFrame, budget: Column, parent: list[str]) -> DataFrame:
    """nodes (parent.., weight, capacity) with the share that each gets of its parent's budget: a water level by window functions."""
    ratio = F.col("capacity") / F.when(F.col("weight") > 0, F.col("weight"))
    w = Window.partitionBy(*parent).orderBy("ratio", "node_key")
    n = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))
    n = n.withColumn("budget", budget)
    n = n.withColumn("taken", F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    n = n.withColumn("open_weight", F.sum(F.greatest("weight", F.lit(0.0))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    full = (F.col("weight") <= 0) | (F.col("taken") + F.col("ratio") * F.col("open_weight") <= F.col("budget"))
    n = n.withColumn("full", full)
    # the first child that is not full has the level; those after it would give less
    level = F.max(F.when(~F.col("full"), (F.col("budget") - F.col("taken")) / F.col("open_weight"))).over(Window.partitionBy(*parent))
    n = n.withColumn("level", level).withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("level") * F.col("weight")))
    return n.drop("ratio", "budget", "taken", "open_weight", "full", "level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: float, epochs: int) -> DataFrame:
    """leaves (levels.., tokens) with the quota of each."""
    out = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(epochs))).withColumn("share", F.lit(float(budget))).withColumn("all_", F.lit(0))
    for k in range(len(levels)):
        own, above = levels[: k + 1], ["all_", *levels[:k]]
        weight = weight_of(F.col(levels[k]), weights.get(levels[k], {}))
        nodes = out.groupBy("all_", *own).agg(F.sum("capacity").alias("capacity"), F.first("share").alias("parent_share")).withColumn("weight", weight).withColumn("node_key", F.to_json(F.array(*own)))
        nodes = dealt(nodes, F.col("parent_share"), above).select(*(F.col(c).alias(f"n_{c}") for c in own), F.col("share").alias("n_share"))
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in own))
        out = out.join(nodes, on).withColumn("share", F.col("n_share")).drop("n_share", *(f"n_{c}" for c in own))
    return out.drop("capacity", "all_").withColumnRenamed("share", "quota")


def mix(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: float, epochs: int = 4, seed: int = 17) -> DataFrame:
    """rows (key, tokens, levels..): key, levels, tokens, epoch of every time a row is taken. The budget is share of all tokens; a leaf is taken `epochs` times at most."""
    rows = written(rows.sparkSession, rows.select("key", "tokens", *levels), "mix")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, levels, weights, share * total, epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.least(F.floor((F.col("quota") + 1e-6) / F.col("tokens")), F.lit(epochs))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    plan = written(rows.sparkSession, plan.select(*(F.col(c).alias(f"p_{c}") for c in levels), "whole", "rest"), "plan")
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in levels))
    r = rows.join(plan, on).drop(*(f"p_{c}" for c in levels))
    whole = r.where("whole > 0").select("key", *levels, "tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    r = r.where("rest > 0").withColumn("h", F.xxhash64(F.lit(seed), "whole", "key")).withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    ranges = r.groupBy(*levels, "range").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    # what stands before a range: the coarse ranges before its own, and the ranges before it in its own
    ranges = ranges.withColumn("coarse", F.shiftright("range", RANGE_BITS // 2))
    upto = lambda by, of: F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = ranges.groupBy(*levels, "coarse").agg(F.sum("t").alias("t")).select(*(F.col(c).alias(f"p_{c}") for c in levels), F.col("coarse").alias("p_coarse"), upto(levels, "coarse").alias("coarse_before"))
    ranges = ranges.withColumn("own_before", upto([*levels, "coarse"], "range")).join(coarse, on & (F.col("coarse") == F.col("p_coarse"))).drop(*(f"p_{c}" for c in levels))
    ranges = ranges.withColumn("before", F.col("coarse_before") + F.col("own_before")).where(F.col("before") < F.col("rest"))
    ranges = ranges.select(*(F.col(c).alias(f"p_{c}") for c in levels), F.col("range").alias("p_range"), "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("inside"))
    r = r.join(ranges, on & (F.col("range") == F.col("p_range"))).drop("p_range", *(f"p_{c}" for c in levels))
    in_ = r.where("inside")
    w = Window.partitionBy(*levels, "range").orderBy("h", "key")
    edge = r.where("not inside").withColumn("upto", F.col("before") + F.sum("tokens").over(w)).where(F.col("upto") <= F.col("rest"))
    cols = ["key", *levels, "tokens", F.col("whole").alias("epoch")]
    return whole.unionByName(in_.select(*cols)).unionByName(edge.select(*cols))


#: The mixture of the registered query and the pipeline: documents name no domain, so the source's number gives one.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 0.5, "books": 0.3, "forums": 0.2}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}


def domain_of(source: Column) -> Column:
    k = F.pmod(F.coalesce(F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")), F.lit(0)).cast("int"), F.lit(3))
    return F.when(k == 0, "web").when(k == 1, "books").otherwise("forums")


def leveled(docs: DataFrame, key: Column, vocab_path: str | None = None) -> DataFrame:
    """key, tokens (of the vocabulary file, or words), domain, lang, source of every row."""
    rows = docs.select(key.cast("long").alias("key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    if vocab_path is None:
        words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        return rows.select("key", words.alias("tokens"), domain_of(F.col("source")).alias("domain"), "lang", "source")
    ship(docs.sparkSession)
    schema = "key long, lang string, source string, tokens long"
    counted = rows.mapInArrow(_Counts(library_encoder(docs.sparkSession, vocab_path), schema_of(schema)), schema)
    return counted.select("key", "tokens", domain_of(F.col("source")).alias("domain"), "lang", "source")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(leveled(docs, F.col("doc_id"), public_tokenizers.path("word_bpe_49k.json")), LEVELS, WEIGHTS, share=0.6)
    return out.withColumnRenamed("key", "doc_id").select("doc_id", "domain", "lang", "source", "tokens", "epoch")
