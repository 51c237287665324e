"""Toxicity by maximum-scoring segments.

Training: words of labelled documents are counted by label; each word, and each prefix of a word (for stems that take
many endings), gets the log odds of the two labels under an informative Dirichlet prior taken from all labelled words.
All features whose log odds stand out (by their z score) are kept; any other word has the log odds that all the rest have
together. What calibrates scores is fitted on a quarter of the training texts (by a hash of the text), scored with
features that were counted on the other three; then the features are counted on all of them.

Scoring: one linear scan finds every maximal scoring segment of a text's words. Segment scores are calibrated as
extreme values: K n exp(-lambda x) segments of score x or more are expected in a clean text of n words, with lambda
solved from the distribution of word scores and K fitted to the segments that clean texts hold. The significant ones are
aggregated, and two fitted coefficients turn that into the probability of label 1.

Defined results: null and empty texts have the score of a text without evidence; labels that are null or of unknown
documents are not learnt from; a document with several labels counts with each; without both labels in the training
rows every score is the share of label 1 (0 without labels); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_rows, scratch, ship, texts, written

#: Lengths of the word prefixes that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Strength of the Dirichlet prior (pseudo-documents, dealt to the labels by their shares), least z score and least log odds of a kept feature, least documents of a feature.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_DOCUMENTS = 2.0, 4.0, 1.0, 5
#: One in so many training texts calibrates.
CALIBRATION = 4
#: Labelled rows that the model is fitted on, about, chosen by a hash of the id: a documented bound for fitting.
TRAINING_ROWS = 40_000
#: A segment counts when fewer than this many such are expected in a clean text of the same length.
EXPECTED = 1.0

_word = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


class _CountLabelled:
    """Documents with a feature, by label: (feature, label, documents, occurrences), sent on whenever many are held."""

    def __init__(self):
        self.held: dict[int, Counter] = defaultdict(Counter)

    def __call__(self, text, label):
        seen = Counter(words_of(text))
        self.held[label].update(seen.keys())
        return self.end() if sum(map(len, self.held.values())) > 150_000 else None

    def end(self):
        out = [(w, label, n) for label, c in self.held.items() for w, n in c.items()]
        self.held.clear()
        return iter(out)


class Model:
    """Log odds of features; scores of words; segments of texts."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], rest: float, lam: float, k: float, fit: tuple[float, float]):
        self.words, self.prefixes, self.rest, self.lam, self.k, self.fit = words, prefixes, rest, lam, k, fit
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        if (s := self.words.get(w)) is not None:
            return s
        for n in reversed(PREFIXES):
            if len(w) > n and (s := self.prefixes.get(w[:n])) is not None:
                return s
        return self.rest

    def scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 150_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.word(w)
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Significant segments (first word, one past the last, score, expected number by chance) and the text's number of words."""
        words = words_of(text)
        s = self.scores(words)
        out = []
        for a, b, x in maximal_segments(s):
            e = self.k * max(len(words), 1) * math.exp(-self.lam * x)
            if e < EXPECTED:
                out.append((a, b, x, e))
        return out, len(words)

    def evidence(self, text: str | None) -> float:
        """Sum over significant segments of -ln of the chance that a clean text holds one so high (its extreme-value p)."""
        return math.fsum(-math.log(max(-math.expm1(-e), 1e-300)) for _, _, _, e in self.segments(text)[0])

    def probability(self, evidence: float) -> float:
        a, b = self.fit
        return 1 / (1 + math.exp(-max(min(a + b * math.log1p(evidence), 40.0), -40.0)))


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past the last, score) in one pass with a stack; runs of the same sign move as one."""
    if not len(s) or not (s > 0).any():
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    up = s > 0
    edge = np.flatnonzero(np.diff(up.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    stack: list[list] = []  # first, end, total before, total after
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        now = [a, b, float(total[a]), float(total[b])]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k -= 1
            if k < 0 or stack[k][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[k][0], now[1], stack[k][2], now[3]]
            del stack[k:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def solve_slope(values: np.ndarray, weights: np.ndarray) -> float:
    """The lambda > 0 with sum of weights * exp(lambda * value) = 1: the slope of the extreme-value law of segment scores."""
    if not (values > 0).any() or (weights * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """Fits a model on the labelled rows of docs."""
    with scratch(docs.sparkSession):
        return _train(docs, labels, label_col)


def _train(docs: DataFrame, labels: DataFrame, label_col: str) -> Model:
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    labelled = known.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    # by a hash of the id, so that what is broadcast is about TRAINING_ROWS pairs at most, and no text is shuffled
    part = min(1.0, TRAINING_ROWS / max(labelled.n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = written(spark, texts(docs).join(F.broadcast(sample), "doc_id"), "labelled")
    # equal texts teach once a label
    rows = written(spark, rows.groupBy(F.xxhash64("text").alias("same"), "label").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")), "training")
    calibrates = F.pmod("same", F.lit(CALIBRATION)) == 0
    share = labelled.share or 0.0
    constant = Model({}, {}, -1.0, 1.0, 1.0, (math.log(share / (1 - share)) if 0 < share < 1 else 40.0 * (2 * share - 1), 0.0))
    final = log_odds(rows)
    if final is None or share in (0.0, 1.0):
        return constant
    chosen, model = rows.where(calibrates).select("text", "label"), log_odds(rows.where(~calibrates))
    if model is None or chosen.select("label").distinct().count() < 2:  # too few texts to set some apart
        chosen, model = rows.select("text", "label"), final
    # the score distribution of clean words gives the slope, the segments of clean texts give K; then the two coefficients
    sent = spark.sparkContext.broadcast(model)
    spread = map_rows(chosen.where("label = 0").select("text"), "kind int, value double, n long", lambda: _Spread(sent.value)).groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()
    values, weights = np.array([r.value for r in spread if r.kind == 0]), np.array([float(r.n) for r in spread if r.kind == 0])
    if len(values):
        model.lam = solve_slope(values, weights / weights.sum())
        model.k = solve_k([(r.value, r.n) for r in spread if r.kind == 1], weights.sum(), model.lam)
    sent = spark.sparkContext.broadcast(model)
    evidence = map_rows(chosen, "evidence double, label int", lambda: (lambda m: lambda text, label: (m.evidence(text), label))(sent.value)).collect()
    fit = logistic(np.log1p([r.evidence for r in evidence]), np.array([float(r.label) for r in evidence]))
    return Model(final.words, final.prefixes, final.rest, model.lam, model.k, fit)


def log_odds(rows: DataFrame) -> Model | None:
    """The features that stand out in rows (text, label), not yet calibrated; None without both labels."""
    spark = rows.sparkSession
    counts = map_rows(rows.select("text", "label"), "word string, label int, n long", _CountLabelled)
    by_word = counts.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("word").alias("feature")), *(F.struct(F.lit(n).alias("kind"), F.when(F.length("word") > n, F.substring("word", 1, n)).alias("feature")) for n in PREFIXES))
    features = by_word.select("n1", "n0", F.explode(kinds).alias("x")).select("x.*", "n1", "n0").where("feature is not null").groupBy("kind", "feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    features = written(spark, features, "features")
    total = {r.kind: (r.n1, r.n0) for r in features.groupBy("kind").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()}
    if not total or 0 in total[0]:
        return None
    n1, n0 = map(float, total[0])
    share = n1 / (n1 + n0)
    both = F.col("n1") + F.col("n0")
    a, b = F.col("n1") + PRIOR * share, F.col("n0") + PRIOR * (1 - share)
    delta = F.log(a / (n1 + PRIOR - a)) - F.log(b / (n0 + PRIOR - b))
    z = (F.col("n1") - both * share) / F.sqrt(both * (share * (1 - share)))
    scored = features.where(both >= LEAST_DOCUMENTS).withColumn("delta", delta).withColumn("z", z)
    kept = scored.where((F.abs("z") >= LEAST_Z) & (F.abs("delta") >= LEAST_ODDS)).collect()  # from TRAINING_ROWS texts at most
    words = {r.feature: r.delta for r in kept if r.kind == 0}
    prefixes = {r.feature: r.delta for r in kept if r.kind and r.delta > 0}
    rest = min(-0.02, math.log((n1 - sum(r.n1 for r in kept if r.kind == 0) + 1) / n1) - math.log((n0 - sum(r.n0 for r in kept if r.kind == 0) + 1) / n0))
    return Model(words, prefixes, rest, 1.0, 1.0, (0.0, 1.0))


def solve_k(segments: list[tuple[float, int]], words: float, lam: float) -> float:
    """K of the extreme-value law from the segments (score, number) of clean texts with so many words in all.

    Above any score, segments are a Poisson count of mean K words exp(-lam score); the estimate is taken where the
    highest tenth of the segments begins, as the law holds for high scores. Without segments K is that of half a one."""
    ranked = sorted(segments, reverse=True)
    total = sum(n for _, n in ranked)
    if not total or not words:
        return 1.0 if not words else min(1.0, 0.5 / words)
    held = 0
    for score, n in ranked:
        held += n
        if held * 10 >= total:
            return min(max(held / words * math.exp(min(lam * score, 700.0)), 1e-12), 1e12)
    return 1.0


class _Spread:
    """How often each word score (kind 0) and each segment score (kind 1) stands in the texts, to two decimals."""

    def __init__(self, model: Model):
        self.model, self.held = model, Counter()

    def __call__(self, text):
        scores = self.model.scores(words_of(text))
        for kind, found in ((0, scores), (1, np.array([x for _, _, x in maximal_segments(scores)]))):
            values, n = np.unique(np.round(found, 2), return_counts=True)
            for v, k in zip(values.tolist(), n.tolist()):
                self.held[kind, v] += k

    def end(self):
        return iter([(kind, v, n) for (kind, v), n in self.held.items()])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps on a lightly penalised likelihood."""
    w, X = np.zeros(2), np.stack([np.ones(len(x)), np.asarray(x, float)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -40, 40)))
        grad = X.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """docs with the columns score and n_toxic_passages of each row's text, and the passages (first word, end, score, expected) if asked for. Its own column names win."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the features of TRAINING_ROWS texts
    schema = "doc_id long, score double, n_toxic_passages int, passages array<struct<first:int,end:int,score:double,expected:double>>"

    def start():
        m = sent.value

        def row(doc_id, text):
            found, _ = m.segments(text)
            evidence = math.fsum(-math.log(max(-math.expm1(-e), 1e-300)) for _, _, _, e in found)
            return (doc_id, m.probability(evidence), len(found), [{"first": a, "end": b, "score": s, "expected": e} for a, b, s, e in found] if passages else None)

        return row

    out = map_rows(texts(docs), schema, start)
    return out if passages else out.drop("passages")


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, training_rows(labels))
    out = score(docs, model)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_passages")


def below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs, all columns, whose text scores below limit. Only the text goes through Python."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        m = sent.value
        for batch in batches:
            yield pd.Series([m.probability(m.evidence(t)) for t in batch], dtype=float)

    return docs.where(scored(F.col("text").cast("string")) < limit)
