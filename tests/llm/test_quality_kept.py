"""The verdict of the line rules against a plain computation, in any order of the rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from tests.llm.test_text_operators import measures

from tidemark.llm import quality


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """(doc_id, host, words_left, kept) of each row (doc_id, text, host)."""
    normal = lambda line: " ".join(line.lower().split())
    holders = defaultdict(set)
    for doc_id, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host, normal(line)].add((doc_id is None, doc_id or 0, text))
    out = []
    for doc_id, text, host in rows:
        n, _, _, _, repeated = measures(text)
        left = n
        for line in (text or "").split("\n"):
            own = holders.get((host, normal(line)), set())
            if len({t for _, _, t in own}) > quality.LINE_DOCUMENTS:
                first = min(own, key=lambda h: h[:2])
                if (doc_id is None, doc_id or 0) != first[:2]:
                    left -= len(split(line))
        failed = n < quality.LEAST_WORDS or 100 * repeated > quality.MOST_REPEATED * n
        out.append((doc_id, host, left, not failed and left >= quality.LEAST_LEFT * n))
    return out


def key(r):
    return tuple((x is None, x if x is not None else "") for x in r)


def judged(spark, rows, parts):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, source string, row int, line string").repartition(parts)
    return sorted(((r.doc_id, r.host, r.words_left, r.kept) for r in quality.quality(df).collect()), key=key)


def test_kept_equals_brute_force_in_any_order(spark):
    rnd = random.Random(4)
    common = [" ".join(f"c{k}x{j}" for j in range(6)) for k in range(12)]
    own = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 12, 30])))
    rows = []
    for k in range(300):
        lines = [rnd.choice(common).upper() if rnd.random() < 0.1 else rnd.choice(common) for _ in range(rnd.randrange(5))] + [own()]
        rnd.shuffle(lines)
        rows.append((k, "\n".join(lines), rnd.choice(["a", "a", "b", None])))
    rows += [(1000 + k, t, h) for k, (_, t, h) in enumerate(rows[:40])]  # exact copies under other ids
    rows += rows[:10] + [(5, rows[9][1], "a"), (400, None, "a"), (401, "", None), (402, "\n \n", "b")]
    want = sorted(brute(rows), key=key)
    assert judged(spark, rows, 3) == want and judged(spark, rows[::-1], 1) == want
    assert any(not r[3] and r[2] < 10 for r in want) and any(r[3] for r in want)


def test_the_smallest_id_keeps_its_line_in_any_order(spark):
    line = "this very line stands in many documents of the host and is long enough to matter"
    rows = [(0, line + "\nother words", "h"), (1, line + "\nother words", "h")] + [(k, f"{line}\nown words of {k}", "h") for k in range(2, 40)]
    for given in (rows, rows[::-1]):
        got = {r[0]: r[2] for r in judged(spark, given, 1)}
        assert got[0] == len(split(rows[0][1])) and all(got[k] < 10 for k in range(1, 40))


def test_documents_without_an_id(spark):
    line = "this very line stands in many documents of the host and is long enough to matter"
    rows = [(None, f"{line}\nown words of {k % 30}", "h") for k in range(45)]
    got = judged(spark, rows, 2)
    assert sum(r[2] > 10 for r in got) in (1, 2)  # one text's rows hold it
    assert got == judged(spark, rows[::-1], 1)
