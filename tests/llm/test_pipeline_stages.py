"""The whole pipeline against a plain computation of every stage, on documents with odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tests.llm.test_mixing_choice import brute as brute_mix  # noqa: E402
from tests.llm.test_near_dedup_ids import brute_rows  # noqa: E402
from tests.llm.test_quality_kept import brute as brute_quality  # noqa: E402

from tidemark.llm import mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def row_key(row):
    h = 42
    for x in row:
        h = xxhash.xxh64_intdigest((x is None).to_bytes(4, "little"), seed=h)
        if x is not None:
            h = xxhash.xxh64_intdigest(str(x).encode(), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def domain(source):
    digits = ""
    for c in reversed(source or ""):
        if not c.isdigit():
            break
        digits = c + digits
    return ("web", "books", "forums")[int(digits) % 3] if 1 <= len(digits) <= 9 else "web"


def brute(rows, model):
    """(doc_id, ids digest) of every row the pipeline returns, from rows (doc_id, lang, source, text)."""
    lib = Tokenizer.from_file(WORDS)
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    rows = [r for r in rows if model.probability(model.evidence(r[3])) < 0.5]
    verdict = brute_quality([(i, t, s) for i, _, s, t in rows])
    rows = [r for r, v in zip(rows, verdict) if v[3]]
    comp = brute_rows([(r[0], r[3]) for r in rows], 5, 80)
    rows = [r for r, c in zip(rows, comp) if r[0] == c]
    keyed = [(row_key(r), len(ids(r[3])), domain(r[2]), r[1] or "none", r[2] or "none") for r in rows]
    times = Counter(k for k, _ in set(brute_mix(keyed, [mixing.WEIGHTS["domain"], mixing.WEIGHTS["lang"], {}], 0.6)))
    out = []
    for r, (k, *_) in zip(rows, keyed):
        out += [(r[0], hashlib.sha256(" ".join(map(str, ids(r[3]))).encode()).hexdigest())] * times[k]
    return sorted(out, key=str)


def folder(spark, path, rows):
    """A data folder with these documents, further columns of clashing names, and the labels."""
    extra = {c: "clash" for c in ("key", "tokens", "kept", "host", "text_hash", "taken_key", "score", "row", "id", "words_left", "gone_id")}
    df = spark.createDataFrame([(*r, None if r[3] is None else len(r[3]), *extra.values()) for r in rows], "doc_id long, lang string, source string, text string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    given = [(r.doc_id, r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"long{k % 7000}" for k in range(30_000))
    rows = given + given[:8] * 3 + [(10_000, "en", "src1", None), (10_001, None, None, ""), (None, "en", "src1", given[30][3] + " more"), (10_002, None, None, "own words " + " ".join(f"q{k}" for k in range(40)))]
    rows += [(10_003, "en", "src2", long), (10_004, "en", "src2", " ".join(f"z{k}" for k in range(60))), (10_004, "en", "src2", " ".join(f"y{k}" for k in range(60)))]
    rows += [(None, "de", "src3", " ".join(f"null{k}" for k in range(50)))]  # without an id: no row of its group has one, so it stays
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, toxicity.training_rows(labels))
    got = sorted(((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()), key=str)
    assert got == brute(rows, model) and len(got) > 40


def test_stages_on_an_empty_table(spark, tmp_path):
    sf = folder(spark, tmp_path, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs, sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_repeated_rows_are_mixed_alike(spark):
    words = lambda c, k: " ".join(f"{c}{k}x{j}" for j in range(30))
    rows = [(k, "en", f"src{k % 2}", words("a", k)) for k in range(60)] + [(3, "en", "src1", words("a", 3))] * 2 + [(4, "en", "src0", words("b", 4))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    out = Counter(tuple(r) for r in corpus_pipeline.mixing_stage(spark, df, SF).collect())
    given = Counter(rows)
    assert out and all(n % given[r] == 0 for r, n in out.items())
