"""The evidence service: exact subgroup queries, top-k search, cursors, freezing and trial reconciliation."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.columns import average_rank, rank_bin


@dataclass(frozen=True)
class Query:
    bins: int
    where: dict[str, list] = field(default_factory=dict)
    cells: tuple[int, ...] = ()
    page: int = 100

    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:24]


def cursor(query: Query, after: int) -> str:
    """An opaque cursor that is bound to its query."""
    return base64.urlsafe_b64encode(json.dumps([query.key(), after]).encode()).decode()


def position(query: Query, token: str) -> int:
    key, after = json.loads(base64.urlsafe_b64decode(token))
    if key != query.key():
        raise ValueError("the cursor belongs to another query")
    return after


def answer(df: DataFrame, query: Query, after: int = -1) -> DataFrame:
    """Cell moments of the rows (decision, feature, y) that the query selects, a page after a cell."""
    for name, values in query.where.items():
        df = df.where(F.col(name).isin(values))
    x = df.withColumn("cell", rank_bin(average_rank(F.col("feature"), ["decision"]), query.bins))
    if query.cells:
        x = x.where(F.col("cell").isin(*query.cells))
    cells = x.where("cell IS NOT NULL").groupBy("cell").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    return cells.where(F.col("cell") > after).orderBy("cell").limit(query.page)


def search(surfaces: DataFrame, k: int, least_n: int = 1) -> DataFrame:
    """The k surfaces of largest absolute mean, ties by their ids."""
    return surfaces.where(F.col("n") >= least_n).orderBy(F.abs("mean").desc(), *[c for c in surfaces.columns if c.endswith("_id")]).limit(k)


STATUSES = ("done", "empty", "skipped", "failed", "excluded")


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Counts by status; an expected trial without a known status is an error."""
    j = expected.select(key).distinct().join(found.select(key, "status"), key, "left")
    bad = j.where(F.col("status").isNull() | ~F.col("status").isin(*STATUSES))
    if not bad.isEmpty():
        raise ValueError(f"trials without a status: {[r[0] for r in bad.select(key).limit(5).collect()]}")
    return j.groupBy("status").agg(F.count("*").alias("trials"))


#: The order of research states; one step at a time.
STATES = ("BUILD_ONLY", "DISCOVERY", "FROZEN", "REPLICATION", "HOLDOUT", "FINAL_COMPLETE")


def advance(state: str, to: str) -> str:
    if STATES.index(to) != STATES.index(state) + 1:
        raise PermissionError(f"{state} does not lead to {to}")
    return to


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, columns, fingerprint of every table of a publication."""
    from tidemark.sources.readers import fingerprint

    spark = next(iter(tables.values())).sparkSession
    rows = [(name, df.count(), ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes)), fingerprint(df)) for name, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "table string, rows long, columns string, fingerprint string")


def freeze(df: DataFrame, root: str, name: str, spec: dict) -> str:
    """Stores a table under a hash of its rows and its definition, once: the same name with other rows or another definition is refused. Returns the hash."""
    from tidemark.sources.readers import fingerprint
    from tidemark.sources.sinks import _fs, write_atomic

    spark = df.sparkSession
    key = hashlib.sha256(json.dumps([name, fingerprint(df), spec], sort_keys=True, default=str).encode()).hexdigest()
    fs, seal, Path = _fs(spark, f"{root}/{name}/SEAL")
    if fs.exists(seal):
        with_ = fs.open(seal)
        before = bytes(with_.readAllBytes()).decode()
        with_.close()
        if before != key:
            raise PermissionError(f"{name} is frozen with other rows or another definition")
        return key
    write_atomic(df, f"{root}/{name}/rows")
    out = fs.create(seal, False)  # fails where another run has sealed it meanwhile
    out.write(bytearray(key.encode()))
    out.close()
    return key


def experiment(kind: str, df: DataFrame, spec: dict) -> DataFrame:
    """A named experiment on a frozen table: "neighbour" compares a union of cells with each cell next to it, "subgroup" answers a query."""
    if kind == "subgroup":
        return answer(df, Query(**spec))
    if kind != "neighbour":
        raise ValueError(f"{kind!r} is no experiment")
    k, a, b = spec["resolution"], spec["cell"] // spec["resolution"], spec["cell"] % spec["resolution"]
    near = [(a + i) * k + b + j for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= a + i < k and 0 <= b + j < k]
    cells = df.where(F.col("cell").isin(near)).groupBy("cell").agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
    return cells.withColumn("selected", F.col("cell") == spec["cell"])
