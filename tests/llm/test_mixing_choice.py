"""The documents that a mixture takes, against a plain computation of quotas, epochs and prefixes."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tests.llm.test_text_operators import brute_quotas  # noqa: E402

from tidemark.llm import mixing  # noqa: E402


def order(whole, key, seed=17):
    h = 42
    for value, size in ((seed, 4), (whole, 4), (key, 8)):
        h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(rows, weights, share, epochs=4):
    """(key, epoch) of every time a row (key, tokens, domain, lang, source) is taken."""
    leaves = defaultdict(int)
    for _, n, *leaf in rows:
        leaves[tuple(leaf)] += n
    quotas = brute_quotas(dict(leaves), weights, share * sum(leaves.values()), epochs)
    out = []
    for leaf, total in leaves.items():
        whole = min(int((quotas[leaf] + 1e-6) // total), epochs) if total else 0
        own = [r for r in rows if tuple(r[2:]) == leaf]
        out += [(r[0], e) for r in own for e in range(whole)]
        rest = quotas[leaf] - whole * total
        if rest <= 0:
            continue
        keys, held = defaultdict(list), 0  # rows of one key are taken together
        for r in own:
            keys[r[0]].append(r[1])
        for k in sorted(keys, key=lambda k: (order(whole, k) % (1 << 64) >> 52, order(whole, k), k)):
            if held >= rest or held + sum(keys[k]) > rest:
                break
            held += sum(keys[k])
            out += [(k, whole)] * len(keys[k])
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.4, 1.0, 2.5])
def test_choice_equals_brute_force(spark, share):
    rnd = random.Random(6)
    rows = [(k, rnd.randrange(1, 400), rnd.choice(["web", "web", "books"]), rnd.choice(["en", "de"]), rnd.choice(["s0", "s0", "s0", "s1"])) for k in range(600)]
    rows += [(1000 + k, 50, "forums", "fr", "tiny") for k in range(3)]
    df = spark.createDataFrame(rows, "key long, tokens long, domain string, lang string, source string")
    weights = [mixing.WEIGHTS["domain"], mixing.WEIGHTS["lang"], {}]
    got = sorted((r.key, r.epoch) for r in mixing.mix(df, mixing.LEVELS, mixing.WEIGHTS, share=share).collect())
    assert got == brute(rows, weights, share)


def test_tokens_are_the_library_s(docs, odd):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for frame in (docs, odd):
        want = sorted(len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in frame.collect())
        assert sorted(r.tokens for r in mixing.leveled(frame, F.col("doc_id"), public_tokenizers.path("word_bpe_49k.json")).collect()) == want
