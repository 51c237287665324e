"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Texts with equal shingle sets are one class, whose key is the first row that holds one of them; a class is worked on
once, and classes are mapped to documents only at the end. Signatures are cut into bands; classes that
share a band are candidates. Candidates are compared by batches of their signatures: a pair is pruned when the
posterior probability that its similarity reaches the threshold falls below the chosen miss probability. Survivors are
verified on their full shingle sets. No bucket emits all its pairs:

1. each class against its bucket's smallest class, which joins most of a group of copies at one pair a member;
2. in buckets whose members are still of different components, every pair of different components that the posterior
   does not prune, verified where the bucket's texts are: only pairs that join two components leave the task, and
   members that a task has joined are not compared again. A pair is looked at in the first band that it shares.

No link between different components goes untested. Large buckets are worked on in pairs of blocks of members.

Defined results: null or empty texts, or texts without words, have no shingles and are linked with nothing; fewer words
than a shingle make one shingle; rows with the same id are one document, and link the classes of all its texts; rows
with a null id are one document where their texts are equal, take part in the search, and their component is the
smallest id of their group, or null where none has one (then the document of the group's smallest class stays); an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, dropped, forget, map_rows, schema_of, scratch, ship, texts, written
from .words import mix, shingles

#: Hashes of a signature, rows of a band, hashes compared at a time.
HASHES, ROWS, BATCH = 96, 4, 16
#: A pair is pruned when its posterior chance to reach the threshold is below this.
MISS = 1e-7
#: Members of a bucket worked on at a time.
BLOCK = 512
#: Ids that may be broadcast to pick texts (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def signature(sh: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(sh), 4096):
        part = sh[at : at + 4096]
        for k in range(HASHES):
            out[k] = min(out[k], (part * _A[k] + _B[k]).min())
    return out


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """By batches compared: the fewest matches with which the posterior (from a flat prior) still allows the threshold."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, m = 0.0, -1
        while p < miss:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signatures (rows of a and b) stay, and their matches, batch after batch."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, low in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[live] += (a[live, part] == b[live, part]).sum(axis=1, dtype=np.int32)
        live = live[matches[live] >= low]
        if not len(live):
            break
    return live, matches[live]


def _sketch(words: int):
    def row(doc_id, text, text_hash):
        sh = shingles(text, words)
        if not len(sh):
            return (doc_id, text_hash, 0, None, None, None)
        sig = signature(sh)
        bands = mix(sig.reshape(-1, ROWS) * np.uint64(0xFF51AFD7ED558CCD) + np.arange(ROWS, dtype=np.uint64))
        keys = mix(bands.sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        same = np.array([mix(sh).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(sh + np.uint64(len(sh))))], np.uint64).tobytes()
        return (doc_id, text_hash, len(sh), same, (sig >> np.uint64(48)).astype(np.uint16).tobytes(), keys.view(np.int64))

    return row


class _Pairs:
    """Prunes pairs (.., sig_a, sig_b) by their posterior; gives the first columns of those that stay."""

    def __init__(self, threshold: float):
        self.least = least_matches(threshold)

    def __call__(self, batches):
        forget()
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3))
                live, _ = survivors(a, c, self.least)
                yield b.select([0, 1]).take(pa.array(live))


class _Buckets:
    """Rows (key, i, j, block, band, id, comp, n, sig, bands, text) sorted by key, i, j: gives links that join components of a bucket's blocks i and j."""

    def __init__(self, words: int, percent: int, schema):
        self.words, self.percent, self.least, self.schema = words, percent, least_matches(percent / 100), schema

    def groups(self, batches) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cut = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in cols))) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                now = tuple(int(c[lo]) for c in cols)
                if now != key and held:
                    yield key, held
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield key, held

    def __call__(self, batches):
        forget()
        self.sets: dict[int, np.ndarray] = {}

        def rows():
            for (_, i, j), parts in self.groups(batches):
                block, band, ids, comp, n = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(3, 8))
                sig = np.frombuffer(b"".join(x for p in parts for x in p.column(8).to_pylist()), np.uint16).reshape(-1, HASHES)
                bands = np.concatenate([p.column(9).flatten().to_numpy() for p in parts]).reshape(len(ids), -1)
                texts = [x for p in parts for x in p.column(10)]
                yield from self.bucket(i != j, block, int(band[0]), ids, comp, n, sig, bands, texts)

        yield from batched(rows(), self.schema)

    def shingles_of(self, k: int, text) -> np.ndarray:
        found = self.sets.get(k)
        if found is None:
            if len(self.sets) >= 4 * BLOCK:
                self.sets.clear()
            found = self.sets[k] = shingles(text.as_py(), self.words)
        return found

    def bucket(self, across, block, band, ids, comp, n, sig, bands, texts):
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a in range(len(ids)):
            y = np.arange(a + 1, len(ids))
            ok = (comp[y] != comp[a]) & (100 * np.minimum(n[y], n[a]) >= self.percent * np.maximum(n[y], n[a]))
            if across:
                ok &= block[y] != block[a]
            y = y[ok]
            if up and len(y):
                own = find(int(comp[a]))
                y = y[[find(c) != own for c in comp[y].tolist()]]
            if len(y) and band:
                y = y[~(bands[y, :band] == bands[a, :band]).any(axis=1)]
            if not len(y):
                continue
            live, _ = survivors(np.broadcast_to(sig[a], (len(y), HASHES)), sig[y], self.least)
            if not len(live):
                continue
            y, x = y[live], self.shingles_of(int(ids[a]), texts[a])
            others = [self.shingles_of(int(ids[k]), texts[k]) for k in y.tolist()]
            flat, sizes = np.concatenate(others), np.array([len(o) for o in others])
            at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
            both = np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for k in y[100 * both >= self.percent * (sizes + len(x) - both)].tolist():
                u, v = find(int(comp[a])), find(int(comp[k]))
                if u != v:
                    up[max(u, v)] = min(u, v)
                    yield (min(int(ids[a]), int(ids[k])), max(int(ids[a]), int(ids[k])))


def _verify(words: int, percent: int):
    """Exact similarity of two texts on their full shingle sets."""
    kept: dict[int, np.ndarray] = {}

    def of(k: int, text: str) -> np.ndarray:
        if k not in kept:
            if len(kept) >= 64:
                kept.pop(next(iter(kept)))
            kept[k] = shingles(text, words)
        return kept[k]

    def row(a, b, text_a, text_b):
        x, y = of(a, text_a), of(b, text_b)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if 100 * both >= percent * (len(x) + len(y) - both) else None

    return row


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b). Alternates large-star and small-star rounds on written tables."""
    spark = links.sparkSession
    edges = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), name)
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        before, edges = edges, written(spark, small, name)
        dropped(spark, before)
        # a forest of stars: every id points at one, and none is pointed at that points itself
        open_ = edges.groupBy("v").count().where("count > 1").select("v").unionByName(edges.select(F.col("u").alias("v")).join(edges.select("v"), "v", "left_semi"))
        if open_.isEmpty():
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64) of every row of docs. Documents are linked when 100 * intersection >= percent * union of their sets of words-word shingles."""
    with scratch(docs.sparkSession) as kept:
        return _near_duplicates(docs, words, percent, kept)


def _near_duplicates(docs: DataFrame, words: int, percent: int, kept: Callable[..., None]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    docs = texts(docs, "text", "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    schema = "doc_id long, text_hash long, n long, same binary, sig binary, bands array<long>"
    sketch = written(spark, map_rows(docs, schema, lambda: _sketch(words)).withColumn("row", F.monotonically_increasing_id()), "sketch")
    full = sketch.where("n > 0")
    # a class: its key (the first row), the smallest document that holds it, the text that stands for it
    first = F.min(F.struct("row", "text_hash"))
    classes = full.groupBy("same").agg(first.alias("x"), F.min("doc_id").alias("least_doc")).select("same", F.col("x.row").alias("id"), F.col("x.text_hash").alias("first_hash"), "least_doc")
    member = written(spark, full.select("doc_id", "text_hash", "same").distinct().join(classes, "same").select("doc_id", "text_hash", "id", "first_hash", "least_doc"), "members")
    reps = full.join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "doc_id", "text_hash", "n", "sig", "bands")
    reps = written(spark, reps, "classes")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = written(spark, rows.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1"), "buckets")
    rows = written(spark, rows.join(buckets, "key"), "rows")
    sig = reps.select("id", "sig", "n")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """(id, text) of the given classes: the text of the document that stands for each. Few ids go to the texts, many texts come to the ids."""
        need = written(spark, reps.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("rep_doc"), F.col("text_hash").alias("rep_hash")), f"{name}-ids")
        need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
        found = docs.join(need, (docs.text_hash == need.rep_hash) & docs.doc_id.eqNullSafe(need.rep_doc))
        return written(spark, found.groupBy("id").agg(F.min("text").alias("text")), f"{name}-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(spark, pairs, f"{name}-pairs")
        have = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), name)
        both = pairs.join(have.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(have.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return written(spark, map_rows(both.select("a", "b", "text_a", "text_b"), "a long, b long", lambda: _verify(words, percent)), f"{name}-links")

    # 1: each class against the smallest of its bucket
    pairs = rows.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    links = verified(pairs.mapInArrow(_Pairs(percent / 100), "a long, b long"), "lead")
    # a document with several texts joins their classes
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionByName(several.join(member, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    # 2: what the buckets still hold of different components
    comp = components(links)
    now = rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    # written, so that the join deals the rows anew and a large bucket's can be split over tasks
    mixed = written(spark, now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed-keys")
    now = now.join(mixed, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    now = written(spark, now.select("key", "band", "id", "comp", "blocks", "block"), "mixed")
    now = now.join(reps, "id").join(texts_of(now, "mixed"), "id")
    now = now.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))).alias("at"))
    now = now.select("key", "at.i", "at.j", "block", "band", "id", "comp", "n", "sig", "bands", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    found = now.mapInArrow(_Buckets(words, percent, schema_of("a long, b long")), "a long, b long")
    links = links.unionByName(written(spark, found, "bucket-links"))
    comp = components(links)
    # of each class in a group: the group's smallest class and smallest document
    linked = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())
    docs_of = linked.join(classes.select("id", "least_doc"), "id").groupBy("component").agg(F.min("least_doc").alias("group_doc"))
    linked = written(spark, linked.join(docs_of, "component"), "groups")
    kept(sketch, member, linked)  # the result reads these
    member = member.join(linked, "id", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("least_doc")).otherwise(F.col("group_doc")))
    joined = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketch.where("doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), "text_hash").join(joined, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    # documents without an id stand by their text; those of a group with an id never stay
    stays = F.col("component_id").isNull() & (F.col("id") == F.coalesce("component", "id")) & (F.col("text_hash") == F.col("first_hash"))
    nameless = member.where("doc_id is null").select("text_hash", "component_id", stays.alias("kept"))
    nameless = sketch.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), "text_hash").join(nameless, "text_hash", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    return out.unionByName(nameless).select("doc_id", "n_shingles", "component_id", "kept", "text_hash")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85).drop("text_hash")


SQL_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), u AS (
  SELECT doc_id, unnest(s) AS g FROM s
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.b OR l.b = r.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
