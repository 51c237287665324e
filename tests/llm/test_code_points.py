"""Encoders and counters equal the library on every code point, alone and among letters, digits, marks and contractions."""

from __future__ import annotations

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, code_points, token_counts, token_files  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
POINTS = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def texts():
    """Every code point that Python's tables lack though the library knows it, and every fortieth other one, in contexts; then random mixtures."""
    from tokenizers import normalizers

    letters = {c for ranges in (code_points.probe().letters, code_points.probe().numbers) for a, b in ranges for c in range(a, b + 1)}
    odd = {c for a, b in code_points.probe().odd for c in range(a, b + 1)}
    nfd = normalizers.NFD().normalize_str
    known = [c for c in sorted(odd) if c in letters or nfd(chr(c)) != chr(c)]
    chosen = known + POINTS[:: 40] + list(range(1, 0x600))
    for c in chosen:
        yield f"a{chr(c)}b {chr(c)} {chr(c)}'re {chr(c)}{chr(c)}1 x{chr(c)}"
    rnd = random.Random(8)
    marks = [c for c in POINTS if 0x300 <= c < 0x370 or 0x113B8 <= c < 0x113D0 or 0x16100 <= c < 0x16130 or 0x897 <= c < 0x8A0]
    for _ in range(2000):
        yield "".join(chr(rnd.choice(rnd.choice([chosen, marks, list(range(32, 127))]))) for _ in range(24))


def test_library_classes_are_probed():
    p = code_points.probe()
    assert (97, 122) in p.letters and (48, 57) in p.numbers and (32, 32) in p.white and len(p.odd) > 100


def test_word_codec_equals_the_library():
    lib = Tokenizer.from_file(WORDS)
    codec = bpe.Codec(open(WORDS, "rb").read())
    files = token_files.LibraryEncoder(open(WORDS, encoding="utf-8").read())
    bad = []
    for text in texts():
        want = lib.encode(text, add_special_tokens=False).ids
        if codec.encode(text) != want or files([text])[0] != np.array(want, "<u4").tobytes():
            bad.append(text)
    assert not bad, (len(bad), [x.encode("unicode_escape") for x in bad[:10]])


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(BYTES)
    counter = token_counts.TokenCounter(open(BYTES, "rb").read())
    all_ = list(texts())
    got = counter.many(all_)
    bad = [t for t, n in zip(all_, got) if n != len(lib.encode(t, add_special_tokens=False).ids)]
    assert not bad, (len(bad), [x.encode("unicode_escape") for x in bad[:10]])
