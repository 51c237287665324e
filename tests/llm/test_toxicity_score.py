"""Toxicity features, calibration and scores against plain computations."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity


def brute_segments(s, lo=0):
    """Maximal scoring segments by their recursive definition."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, n = -best[2], -best[1]
    return [*brute_segments(s[:a], lo), (lo + a, lo + a + n, best[0]), *brute_segments(s[a + n :], lo + a + n)]


def brute_score(model, text):
    words = re.findall(r"\w+", (text or "").lower())

    def one(w):
        if w in model.words:
            return model.words[w]
        return next((model.prefixes[w[:n]] for n in (6, 5, 4) if len(w) > n and w[:n] in model.prefixes), model.rest)

    evidence = 0.0
    for _, _, x in brute_segments([one(w) for w in words]):
        expected = model.k * max(len(words), 1) * math.exp(-model.lam * x)
        if expected < toxicity.EXPECTED:
            evidence -= math.log(-math.expm1(-expected))
    a, b = model.fit
    return 1 / (1 + math.exp(-(a + b * math.log(1 + evidence))))


def test_scores_equal_brute_force(spark):
    model = toxicity.Model({"bad": 2.0137, "good": -1.5311, "awful": 3.1093}, {"nast": 1.2419, "nastie": 2.2673}, -0.4071, 0.9, 0.15, (-3.0, 2.0))
    rnd = np.random.default_rng(5)
    vocabulary = ["bad", "good", "awful", "nasty", "nastiest", "nastiness", "nast", "plain", "word", "BAD,"]
    rows = [(k, " ".join(rnd.choice(vocabulary, rnd.integers(1, 40)))) for k in range(120)] + [(200, None), (201, ""), (202, " ,.- ")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {k: pytest.approx(brute_score(model, t), abs=1e-9) for k, t in rows}
    assert len({round(x, 6) for x in got.values()}) > 20


def test_log_odds_equal_plain_counts(spark):
    rnd = np.random.default_rng(9)
    texts = [(" ".join(rnd.choice([f"w{j}" for j in range(30)] + ["vile"] * (9 * label), 25)), int(label)) for label in rnd.integers(0, 2, 200)]
    model = toxicity.log_odds(spark.createDataFrame(texts, "text string, label int"))
    n = [Counter(), Counter()]
    for text, label in texts:
        n[label].update(set(text.split()))
    total = [sum(c.values()) for c in n]
    share = total[1] / sum(total)
    want = {}
    for w in set(n[0]) | set(n[1]):
        both, a, b = n[0][w] + n[1][w], n[1][w] + toxicity.PRIOR * share, n[0][w] + toxicity.PRIOR * (1 - share)
        odds = math.log(a / (total[1] + toxicity.PRIOR - a)) - math.log(b / (total[0] + toxicity.PRIOR - b))
        if both >= toxicity.LEAST_DOCUMENTS and abs(odds) >= toxicity.LEAST_ODDS and abs(n[1][w] - both * share) / math.sqrt(both * share * (1 - share)) >= toxicity.LEAST_Z:
            want[w] = pytest.approx(odds)
    assert model.words == want and "vile" in want
    assert toxicity.log_odds(spark.createDataFrame(texts, "text string, label int").where("label = 1")) is None


def test_k_predicts_segments_of_clean_texts():
    """Fitted on random words, K and lambda predict how many segments of a score other random words hold."""
    rnd = np.random.default_rng(2)
    values, p = np.array([-1.0, 0.5, 1.5]), np.array([0.7, 0.2, 0.1])
    lam = toxicity.solve_slope(values, p)
    found = Counter()
    for _ in range(60):
        found.update(round(x, 2) for _, _, x in toxicity.maximal_segments(rnd.choice(values, 4000, p=p)))
    k = toxicity.solve_k(list(found.items()), 60 * 4000, lam)
    again = [x for _ in range(60) for _, _, x in toxicity.maximal_segments(rnd.choice(values, 4000, p=p))]
    for score in (4.0, 6.0, 8.0):
        assert 0.5 < (sum(x >= score for x in again) + 1) / (k * 60 * 4000 * math.exp(-lam * score) + 1) < 2
    assert toxicity.solve_k([], 1000, 1.0) == 0.0005 and toxicity.solve_k([], 0, 1.0) == 1.0
