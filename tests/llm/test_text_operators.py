from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, licenses, mixing, near_dedup, quality, token_counts, token_files, toxicity  # noqa: E402
from tidemark.llm.words import hashes, shingles  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_bpe_equals_the_library(docs, odd, none):
    lib = Tokenizer.from_file(WORDS)
    for frame in (docs, odd):
        got = rows(bpe.encode_decode(frame, WORDS, ("ids", "decoded"), most=500), "doc_id", "ids", "decoded")
        want = []
        for r in frame.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, ids, lib.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want, key=repr)
    assert bpe.encode_decode(none, WORDS).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["walking", "talking", "walk", "talk", "walked", "talked", "é", ""])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    assert {w: list(lex.get(w)) for w in words} == words
    assert [lex.get(w) for w in (b"wal", b"walks", b"zzz", b"\xff")] == [None] * 4
    assert lex.n_states < sum(map(len, words)) / 2
    assert [lex.ordinal(w) for w in sorted(words)] == list(range(len(words)))


def test_long_piece_merges_as_short_ones():
    import json

    m = bpe.Merges(json.load(open(WORDS))["model"])
    for raw in (b"abracadabra" * 30, b"a" * 777, bytes(range(97, 123)) * 20):
        ids = [m.first[b] for b in raw[:-1]] + [m.last[raw[-1]]]
        assert m.merge(list(ids)) == m.merge_long(list(ids))


def test_token_counts_equal_the_library(docs, odd, none):
    lib = Tokenizer.from_file(BYTES)
    for frame in (docs, odd):
        want = [(r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in frame.select("doc_id", "text").collect()]
        assert rows(token_counts.token_counts(frame, BYTES), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(none, BYTES).count() == 0


def test_splitter_state_maps_compose():
    s = token_counts.Splitter()
    classes = np.random.default_rng(3).integers(0, 11, (6, 40)).astype(np.uint8)
    maps = s.state_maps(classes)
    whole = s.state_maps(classes.reshape(1, -1))[0]
    state = np.arange(12)
    for m in maps:
        state = m[state]
    assert (state == whole).all()
    assert s.entries(maps, 0).tolist() == [0, *[int(s.state_maps(classes[:k].reshape(1, -1))[0, 0]) for k in range(1, 6)]]


def test_token_files_round_trip(spark, odd, none, tmp_path):
    import zlib

    lib = Tokenizer.from_file(WORDS)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(odd, folder, token_files.library_encoder(spark, WORDS), 2)
    got = token_files.read(spark, folder).orderBy("start").collect()
    want, start = [], 0
    texts = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for doc_id, text in texts:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got] == want
    first = manifest.orderBy("part", "file").first()
    assert token_files.record(folder, first.name, 0)[0] == first.first_id
    path = f"{tmp_path}/files/{first.name}.rec"
    raw = bytearray(open(path, "rb").read())
    raw[13] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="checksum"):
        token_files.record(folder, first.name, 0)
    token_files.write(none, f"file://{tmp_path}/none", token_files.library_encoder(spark, WORDS), 2)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_crc32c():
    assert token_files.crc32c(b"123456789") == 0xE3069283
    assert token_files.crc32c(b"") == 0

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 & -(c & 1))
        return c ^ 0xFFFFFFFF

    for n in (1, 3, 4, 5, 1023, 1024, 1025, 5000):
        data = bytes((k * 31 + n) & 255 for k in range(n))
        assert token_files.crc32c(data) == slow(data)


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(docs, odd, none):
    for frame in (docs, odd):
        got = rows(quality.quality(frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert got == sorted(((r.doc_id, *measures(r.text)) for r in frame.select("doc_id", "text").collect()), key=repr)
    assert quality.quality(none).count() == 0


def test_quality_removes_common_lines(spark):
    common = "this very line stands in many documents of the host"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(25))
    data = [(k, f"{common}\n{common}\n{common} \n{own(k)}" if k < 30 else own(k), "h") for k in range(40)]
    data += [(100 + k, f"{common.upper()}\n{common}\n{common}\n{common}\n{common}\n{common} {k}", "h") for k in range(30)]
    data += [(200 + k, "the same whole text many times over with enough words to pass every one of the base rules set here", "h") for k in range(60)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert out[0].words_left == out[0].n_words  # the first holder keeps it
    assert all(out[k].words_left == 25 for k in range(1, 30))
    assert all(out[k].kept for k in range(200, 260))  # exact copies count as one document


def brute_components(texts, words, percent):
    def sh(t):
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets, up = {k: sh(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                up[v] = u
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, words, percent):
    import random

    rnd = random.Random(11)
    base = [f"v{rnd.randrange(500)}" for _ in range(120)]
    chain = []
    for k in range(60):  # a chain of small edits: far ends are not alike
        base[rnd.randrange(120)] = f"n{k}"
        chain.append((10_000 + k, " ".join(base)))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    want = brute_components({r.doc_id: r.text for r in frame.collect()}, words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, words, percent).collect()}
    assert got == want


def test_near_duplicates_odd(odd, none):
    got = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert near_dedup.near_duplicates(none, 3, 85).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 200: 100, 300: 100}


def test_word_hashes():
    for text in ("", " ", "a", " a  b\tc\x0b", "x" * 5000 + " y", "é ü z"):
        raw = text.encode()
        h = hashes(raw)
        assert len(h) == len(raw.split()) and len(set(h.tolist())) == len(set(raw.split()))
    assert (shingles("A b C d", 3) == shingles("a B c D", 3)).all()


def test_maximal_segments_equal_brute_force():
    def brute(s, lo=0):
        best = max(((sum(s[a:b]), -a, b - a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,), key=lambda x: (x[0], -x[2]))
        if best[0] <= 0:
            return []
        a, n = -best[1], best[2]
        return [*brute(s[:a], lo), (lo + a, lo + a + n, best[0]), *brute(s[a + n :], lo + a + n)]

    rng = np.random.default_rng(7)
    for _ in range(60):
        s = rng.normal(-0.2, 1, 18)
        got = [(a, b, round(x, 9)) for a, b, x in toxicity.maximal_segments(s)]
        assert got == [(a, b, round(x, 9)) for a, b, x in brute(list(s))]


def test_toxicity_held_out(spark, docs, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(d, toxicity.training_rows(labels))
    out = toxicity.score(d, model).join(labels, "doc_id").where(~(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0)).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in out) / len(out)
    assert right >= 0.93
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[2] == scores[3] < 0.5 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels).probability(0.0) <= 1
    assert toxicity.below(odd, model, 0.5).columns == odd.columns


def test_license_scan(spark, odd, none):
    data = [
        (1, "words\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "All rights reserved."), (6, "Licensed under the Quux Vendor License."), (7, "He lost his driver's license."), (8, None), (9, "nothing here"),
        (10, "Distributed under the terms of the BSD-3-Clause"), (11, "GNU Lesser General Public License, version 2.1"),
    ]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, 1): ("apache", True), (2, 0): ("mit", True), (3, 0): ("gpl", True), (4, 0): ("cc-by-nc", True), (5, 0): ("all-rights-reserved", True), (6, 0): ("unknown", False), (7, 0): ("unknown", False), (10, 0): ("bsd", True), (11, 0): ("lgpl", True)}
    licenses.scan(odd).collect()
    assert licenses.scan(none).count() == 0


def brute_quotas(leaves, weights, budget, epochs):
    def fill(children, budget):
        share, open_ = {}, dict(children)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = [k for k, (w, c) in open_.items() if w <= 0 or budget * w / total >= c]
            if not full:
                return share | {k: budget * w / total for k, (w, _) in open_.items()}
            for k in full:
                w, c = open_.pop(k)
                share[k] = c if w > 0 else 0.0
            budget -= sum(share[k] for k in full)
        return share

    def go(prefix, depth, budget):
        if depth == 3:
            return {prefix: budget}
        names = sorted({leaf[depth] for leaf in leaves if leaf[:depth] == prefix})
        capacity = {x: epochs * sum(t for leaf, t in leaves.items() if leaf[: depth + 1] == (*prefix, x)) for x in names}
        share = fill({x: (weights[depth].get(x, 1.0), capacity[x]) for x in names}, budget)
        return {k: v for x in names for k, v in go((*prefix, x), depth + 1, share[x]).items()}

    return go((), 0, budget)


def test_budgets_equal_brute_force(spark):
    leaves = {("a", "en", "s1"): 100, ("a", "en", "s2"): 900, ("a", "de", "s3"): 50, ("b", "en", "s4"): 400, ("b", "fr", "s5"): 5, ("c", "en", "s6"): 3000}
    weights = [{"a": 0.6, "b": 0.3, "c": 0.1}, {"en": 0.5, "de": 0.4}, {"s2": 0.2}]
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for budget in (10.0, 800.0, 2500.0, 4000.0, 1e9):
        got = {(r.domain, r.lang, r.source): r.quota for r in mixing.leaf_budgets(df, mixing.LEVELS, dict(zip(mixing.LEVELS, weights)), budget, 2).collect()}
        want = brute_quotas(leaves, weights, budget, 2)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_mix_takes_prefixes_of_epochs(docs, odd, none):
    key = F.col("doc_id").cast("long").alias("key")
    source = mixing.leveled(docs, key)
    out = mixing.mix(source, mixing.LEVELS, mixing.WEIGHTS, share=0.8).collect()
    total = source.agg(F.sum("tokens")).first()[0]
    assert 0.6 * total < sum(r.tokens for r in out) <= 0.8 * total + 1
    assert len({(r.key, r.epoch) for r in out}) == len(out)
    assert sorted(map(tuple, mixing.mix(source, mixing.LEVELS, mixing.WEIGHTS, share=0.8).collect())) == sorted(map(tuple, out))
    by_leaf = {}
    for r in out:
        by_leaf.setdefault((r.domain, r.lang, r.source), set()).add(r.epoch)
    assert all(e == set(range(len(e))) for e in by_leaf.values())
    mixing.mix(mixing.leveled(odd, key), mixing.LEVELS, mixing.WEIGHTS, share=0.5).collect()
    assert mixing.mix(mixing.leveled(none, key), mixing.LEVELS, mixing.WEIGHTS, share=0.5).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib = Tokenizer.from_file(WORDS)
    assert out and all(r.doc_id in docs for r in out)
    for r in out:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    kept = {r.doc_id: docs[r.doc_id] for r in out}
    assert all(k == c for k, (_, c) in brute_components(kept, 5, 80).items())
