"""Near duplicates where ids repeat, carry several texts or are missing, against a plain computation over rows."""

from __future__ import annotations

import random

from tests.llm.test_text_operators import brute_components

from tidemark.llm import near_dedup


def brute_rows(rows, words, percent):
    """component_id of each row: rows are linked by likeness and by an equal id."""
    comp = {k: c for k, (_, c) in brute_components({k: t for k, (_, t) in enumerate(rows)}, words, percent).items()}
    while True:
        at = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                at[i] = min(at.get(i, comp[k]), comp[k])
        to = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                to[comp[k]] = min(to.get(comp[k], at[i]), at[i])
        new = {k: to.get(c, c) for k, c in comp.items()}
        if new == comp:
            break
        comp = new
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    return [least.get(comp[k]) for k in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, text_hash string, id string").repartition(3)


def check(spark, rows, words=3, percent=85):
    got = near_dedup.near_duplicates(frame(spark, rows), words, percent).collect()
    want = brute_rows(rows, words, percent)
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(((i, c) for (i, _), c in zip(rows, want)), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return got


def text(rnd, n=80):
    return [f"v{rnd.randrange(400)}" for _ in range(n)]


def near(rnd, words):
    out = list(words)
    out[rnd.randrange(len(out))] = f"n{rnd.randrange(10**6)}"
    return out


def test_one_id_with_two_texts(spark):
    rnd = random.Random(1)
    a, b = text(rnd), text(rnd)
    rows = [(5, a), (5, b), (6, near(rnd, a)), (7, near(rnd, b)), (8, b)]
    got = check(spark, [(i, " ".join(t)) for i, t in rows])
    assert {r.component_id for r in got} == {5}


def test_clashing_ids_equal_brute_force(spark):
    rnd = random.Random(2)
    seeds = [text(rnd) for _ in range(25)]
    rows = []
    for _ in range(160):
        t = rnd.choice(seeds)
        rows.append((rnd.choice([None, *range(60)]), " ".join(rnd.choice([t, near(rnd, t), near(rnd, near(rnd, t)), text(rnd)]))))
    check(spark, rows + [(3, None), (None, ""), (200, " "), (3, "one two")])


def test_documents_without_an_id(spark):
    rnd = random.Random(3)
    a, b, c = text(rnd), text(rnd), text(rnd)
    rows = [(None, " ".join(x)) for x in (a, a, near(rnd, a), b, c)] + [(9, " ".join(near(rnd, b))), (None, None), (None, "")]
    got = check(spark, rows)
    kept = sorted(r.n_shingles > 0 for r in got if r.doc_id is None and r.kept)
    assert sum(kept) in (2, 3) and kept.count(False) == 2  # a's group once (as one or both of its equal rows), c; empty texts stay
    assert not any(r.kept for r in got if r.component_id == 9 and r.doc_id is None)
    again = near_dedup.near_duplicates(frame(spark, rows[::-1]), 3, 85).collect()
    assert sum(r.kept for r in again) >= 4
