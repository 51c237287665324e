"""Writers: compressed Parquet, partitioned output, catalogues of views, content-addressed artefacts, manifests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import POINTER, current


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def write_atomic(df: DataFrame, path: str, *partition_by: str) -> None:
    """A new version folder under path, then one rename of the pointer file that names it.

    Readers (readers.lake, views) see the old version or the new one; a run that dies in between leaves the old one. The
    version before stays for readers that have begun; older ones go."""
    spark = df.sparkSession
    fs, root, Path = _fs(spark, path)
    before = current(spark, path).removeprefix(f"{path}/") if fs.exists(Path(f"{path}/{POINTER}")) else None
    fresh = f"version-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{fresh}")
    jvm, draft = spark.sparkContext._jvm, Path(f"{path}/.{fresh}")
    out = fs.create(draft, True)
    out.write(bytearray(fresh.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(Path(f"{path}/{POINTER}")), how)
    for x in fs.listStatus(root):
        name = x.getPath().getName()
        if name.startswith("version-") and name not in (fresh, before):
            fs.delete(x.getPath(), True)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key, so that later joins and windows on it do not shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def views(spark: SparkSession, tables: dict[str, str]) -> None:
    for name, path in tables.items():
        spark.read.option("mergeSchema", True).parquet(current(spark, path)).createOrReplaceTempView(name)


def stage_key(*parts: object) -> str:
    """The key of a stage's artefact: a hash of its configuration, sources and code version."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def artefact(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table stored under key, made and committed first if it is not there. Committed means that the digests of its files stand beside it: what a lost run has left is made again."""
    fs, done, Path = _fs(spark, f"{root}/{key}.files/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{key}")
        digests(spark, f"{root}/{key}").write.mode("overwrite").parquet(f"{root}/{key}.files")
    return spark.read.parquet(f"{root}/{key}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of every data file under path, each read once by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def validate(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The files of an artefact that are missing, new or changed since it was committed: none, if it is sound."""
    was = spark.read.parquet(f"{root}/{key}.files").select("name", F.col("sha256").alias("was"))
    return was.join(digests(spark, f"{root}/{key}"), "name", "full").where(~F.col("was").eqNullSafe(F.col("sha256"))).select("name", "was", "sha256")


def manifest(df: DataFrame) -> DataFrame:
    """The files that a table is read from."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def export_signals(df: DataFrame, path: str, required: list[str], candidate: str = "candidate_key") -> None:
    """One candidate's signals, with the required fields, as a single compressed table."""
    from tidemark.sources.readers import require_columns

    require_columns(df, [*required, candidate])
    if df.select(candidate).distinct().limit(2).count() != 1:
        raise ValueError("signals of exactly one candidate are exported")
    write_atomic(df, path)
