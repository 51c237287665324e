"""Record files of several parts and files: starts over all of them, and an index that does not fit its records."""

from __future__ import annotations

import glob
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import token_files  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_starts_over_many_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(docs, folder, token_files.library_encoder(spark, WORDS), 2, file_bytes=20_000)
    assert manifest.count() > 8
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.read(spark, folder).collect())
    at = 0
    for (start, n, doc_id), want in zip(rows, sorted(r.doc_id for r in docs.collect()), strict=True):
        assert (start, doc_id) == (at, want)
        at += n


def test_reader_checks_the_index(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    token_files.write(docs.limit(9).coalesce(1), folder, token_files.library_encoder(spark, WORDS), 2)
    path = max(glob.glob(f"{tmp_path}/files/*.idx"), key=lambda p: len(open(p, "rb").read()))
    raw = bytearray(open(path, "rb").read())
    struct.pack_into("<q", raw, 32 + 8, struct.unpack_from("<q", raw, 32 + 8)[0] + 4)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="index does not match"):
        token_files.read(spark, folder).collect()
