"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The most frequent words of a corpus are compiled, with their id sequences as outputs, into a minimal
(shared-suffix) acyclic automaton. Its edges carry additive outputs: their sum along a word is the word's ordinal,
which points at the word's ids. Workers memory-map the compiled file; a word that is not in it is merged exactly.

Defined results: a null text is encoded as the empty text (no ids, decoded text ""); repeated rows give repeated
results; a null id column is carried; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code_points import CodePoints, Holds, members, probe
from .common import dropped, map_rows, once, texts, written

NEVER = 1 << 60
#: Words in the compiled lexicon. The lexicon's size, and what is collected and broadcast for it, is bounded by this.
LEXICON_WORDS = 262_144
#: Words rarer than this are merged, not compiled.
LEAST_COUNT = 3
#: Words longer than this are merged, not compiled.
LEXICON_BYTES = 64
#: A worker forgets its memo of chunks at this many entries.
MEMO = 400_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class Merges:
    """Exact BPE merges of one piece over ids."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[a] << 20 | self.vocab[b], k)
            self.made.append(self.vocab[a + b])
        chars = byte_chars()
        self.first = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]

    def __call__(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        ids = [self.first[b] for b in piece[:-1]]
        ids.append(self.last[piece[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        return self.merge(ids) if len(ids) < 200 else self.merge_long(ids)

    def merge(self, ids: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            new = ids[at] = made[low]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(new << 20 | ids[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 20 | new, NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a queue: a long piece takes n log n steps."""
        rank, made, n = self.rank.get, self.made, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 20 | ids[k + 1], NEVER)) != NEVER]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            r, k = heapq.heappop(queue)
            if gone[k] or (j := right[k]) < 0 or rank(ids[k] << 20 | ids[j], NEVER) != r:
                continue
            ids[k] = made[r]
            gone[j] = 1
            right[k] = right[j]
            if right[k] >= 0:
                left[right[k]] = k
                if (x := rank(ids[k] << 20 | ids[right[k]], NEVER)) != NEVER:
                    heapq.heappush(queue, (x, k))
            if left[k] >= 0 and (x := rank(ids[left[k]] << 20 | ids[k], NEVER)) != NEVER:
                heapq.heappush(queue, (x, left[k]))
        return [i for i, off in zip(ids, gone) if not off]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Words with their ids as the bytes of a minimal acyclic transducer. Equal words count once; order is free."""
    words = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    below: list[int] = []  # words that a state accepts
    first, labels, targets, skips, final = array("i"), bytearray(), array("i"), array("i"), bytearray()

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (found := register.get(key)) is not None:
            return found
        register[key] = state = len(below)
        first.append(len(labels))
        final.append(node[0])
        n = node[0]
        for label, to in node[1]:
            labels.append(label)
            targets.append(to)
            skips.append(n)
            n += below[to]
        below.append(n)
        return state

    path: list[list] = [[0, []]]  # the states of the word added last, not yet frozen

    def close(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            to = freeze(path.pop())
            path[-1][1].append((word[len(path) - 1], to))

    before = b""
    for word, _ in words:
        same = len(os.path.commonprefix([before, word]))
        close(same, before)
        path.extend([0, []] for _ in word[same:])
        path[-1][0] = 1
        before = word
    close(0, before)
    root = freeze(path[0])
    first.append(len(labels))
    starts, ids = array("i", [0]), array("i")
    for _, out in words:
        ids.extend(out)
        starts.append(len(ids))
    base, owner, slot = place(first, labels)
    to, add = array("i", bytes(4 * len(owner))), array("i", bytes(4 * len(owner)))
    for edge, k in enumerate(slot):
        to[k], add[k] = targets[edge], skips[edge]
    head = struct.pack("<6i", root, len(final), len(owner), len(words), len(ids), 0)
    return head + b"".join(x.tobytes() for x in (base, owner, to, add, starts, ids)) + bytes(final)


def place(first: array, labels: bytes) -> tuple[array, array, array]:
    """Row displacement: states' edges laid into one table without overlap. Returns each state's base, each slot's owner (-1: free), each edge's slot."""
    used, base, slot = bytearray(1024), array("i"), array("i", bytes(4 * len(labels)))
    owner, low = array("i", [-1]) * 1024, 0
    for state in range(len(first) - 1):
        own = labels[first[state] : first[state + 1]]
        if not own:
            base.append(0)
            continue
        at, tries = low, 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + 512 > len(used):
                used.extend(bytes(len(used)))
                owner.extend(array("i", [-1]) * len(owner))
                at = max(at, 0)
                continue
            b = at - own[0]
            if b >= 0 and not any(used[b + c] for c in own):
                break
            at, tries = at + 1, tries + 1
            if tries == 64:
                low = at - 32
        base.append(b)
        for k, c in enumerate(own):
            used[b + c], owner[b + c], slot[first[state] + k] = 1, state, b + c
        if own[0] + b == low:
            low += 1
    return base, owner, slot


class Lexicon:
    """A compiled lexicon, memory-mapped. The file is unlinked at once: the mapping keeps it while it is used."""

    def __init__(self, compiled: bytes):
        fd, path = tempfile.mkstemp(prefix="tidemark-lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(compiled)
            with open(path, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)
        self.root, states, slots, words, ids, _ = struct.unpack_from("<6i", self.map)
        view, at = memoryview(self.map), 24

        def ints(n: int) -> memoryview:
            nonlocal at
            out = view[at : at + 4 * n].cast("i")
            at += 4 * n
            return out

        self.base, self.owner, self.to, self.add, self.starts, self.ids = ints(states), ints(slots), ints(slots), ints(slots), ints(words + 1), ints(ids)
        self.final = view[at : at + states]
        self.n_states, self.n_words = states, words

    def ordinal(self, word: bytes) -> int:
        """The word's place among the sorted words, or -1."""
        base, owner, to, add = self.base, self.owner, self.to, self.add
        state, out = self.root, 0
        for c in word:
            k = base[state] + c
            if owner[k] != state:
                return -1
            out += add[k]
            state = to[k]
        return out if self.final[state] else -1

    def get(self, word: bytes) -> tuple[int, ...] | None:
        k = self.ordinal(word)
        return None if k < 0 else tuple(self.ids[self.starts[k] : self.starts[k + 1]])


class Words:
    """The white-space separated chunks of a text, normalised as the file says, and the words of a chunk by its pattern.

    Texts with code points that Python's tables do not know as the library does (see code_points) are normalised by the
    library and split by the probed ranges.
    """

    def __init__(self, spec: dict, points: CodePoints):
        pattern = {x["type"]: x for x in spec["pre_tokenizer"]["pretokenizers"]}["Split"]["pattern"]["Regex"]
        self.findall, self.odd = regex.compile(pattern).findall, Holds(points.odd)
        for name, ranges in ((r"\p{L}", points.letters), (r"\p{N}", points.numbers), (r"\s", points.white)):
            pattern = pattern.replace(name, members(ranges))
        self.pattern, self.probed = pattern, None
        self.spec = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})

    def of_library(self) -> None:
        from tokenizers import Tokenizer

        self.normalise, self.probed = Tokenizer.from_str(self.spec).normalizer.normalize_str, regex.compile(self.pattern).findall

    def chunks(self, text: str) -> list[str]:
        """No word of the pattern crosses a chunk."""
        if self.odd(text):
            if not self.probed:
                self.of_library()
            return [x for x in self.normalise(text).split(" ") if x]
        return chunks_of(text)

    def split(self, chunk: str) -> list[str]:
        """The words; the first two cases are the pattern's result for common chunks."""
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?|":
            return [chunk[:-1], chunk[-1]]
        if self.odd(chunk):
            if not self.probed:
                self.of_library()
            return self.probed(chunk)
        return self.findall(chunk)


class Codec:
    """Encodes and decodes as the vocabulary file says: NFC, lower case, words by pattern, bytes, merges within a word."""

    def __init__(self, file_bytes: bytes, lexicon: bytes | None = None, points: CodePoints | None = None):
        spec = json.loads(file_bytes)
        self.words = Words(spec, points or probe())
        self.split = self.words.split
        self.merges = Merges(spec["model"])
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (1 + max([*self.merges.vocab.values(), *self.special.values()]))
        for token, k in [*self.merges.vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        self.memo = _Memo(self)

    def word(self, word: str) -> tuple[int, ...]:
        """One word of the pattern: from the automaton, or else merged."""
        raw = word.encode()
        out = self.lexicon.get(raw) if self.lexicon else None
        return tuple(self.merges(raw)) if out is None else out

    def chunk(self, chunk: str) -> tuple[int, ...]:
        words = self.split(chunk)
        return self.word(chunk) if words == [chunk] else tuple(chain.from_iterable(map(self.memo.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_special and "<|" in text:
            parts = self.split_special.split(text)
            return [*chain.from_iterable([self.special[p]] if p in self.special else self.plain(p) for p in parts)]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.words.chunks(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Ids of white-space separated chunks seen by this worker, in two generations: what is used again outlives the rest."""

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        out = self.old.get(chunk)
        if out is None:
            out = self.codec.chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def chunks_of(text: str) -> list[str]:
    """White-space separated chunks of the normalised text, for code points that Python knows."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:
        text = text.replace("Σ", "σ")  # lower case by character, without the rule for a word's end
    text = text.lower()
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # split() takes these for white space
        return regex.split(r"\p{White_Space}+", text)
    return text.split()


class _CountWords:
    """Counts of the pattern's words, sent on whenever many are held."""

    def __init__(self, file_bytes: bytes, points: CodePoints):
        spec = json.loads(file_bytes)
        self.words, self.special, self.held = Words(spec, points), {x["content"] for x in spec["added_tokens"]}, Counter()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None

    def __call__(self, text: str | None):
        if text:
            for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
                if part not in self.special:
                    self.held.update(self.words.chunks(part))
        if len(self.held) > 150_000:
            return self.end()
        return None

    def end(self) -> Iterator[tuple]:
        words: Counter = Counter()
        for chunk, n in self.held.items():
            for word in self.words.split(chunk):
                words[word] += n
        self.held.clear()
        return iter(words.items())


def frequent_words(docs: DataFrame, file_bytes: bytes, most: int = LEXICON_WORDS) -> list[str]:
    """Words of all documents more frequent than a cutoff count, the lowest that leaves at most `most` of them.

    The cutoff comes from how many words have each count, so the driver gets these counts and at most `most` words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((file_bytes, probe()))
    counts = map_rows(docs.select(F.col("text").cast("string").alias("text")), "word string, n long", lambda: _CountWords(*sent.value))
    total = counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.octet_length("word") <= LEXICON_BYTES))
    total = written(spark, total, "words")
    cutoff, held = LEAST_COUNT - 1, 0
    for n, words in total.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += words
        if held > most:
            cutoff = n
            break
    found = [r.word for r in total.where(F.col("n") > cutoff).select("word").collect()]
    dropped(spark, total)
    return found


def build(docs: DataFrame, vocab_path: str, most: int = LEXICON_WORDS) -> tuple[bytes, bytes]:
    """The vocabulary file's bytes, and the lexicon compiled from the words of docs."""
    with open(vocab_path, "rb") as f:
        file_bytes = f.read()
    merges = Merges(json.loads(file_bytes)["model"])
    return file_bytes, compile_lexicon((raw, merges(raw)) for raw in (w.encode() for w in frequent_words(docs, file_bytes, most)))


def _digest(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


class _Decimal(dict):
    """Ids as text, made once each."""

    def __missing__(self, k: int) -> str:
        out = self[k] = str(k)
        return out


_decimal = _Decimal()
#: What encode_decode can return for a document, from its ids and its decoded text.
OUTPUTS = {
    "n_tokens": ("long", lambda ids, decoded: len(ids)),
    "ids": ("array<int>", lambda ids, decoded: ids),
    "decoded": ("string", lambda ids, decoded: decoded()),
    "ids_sha256": ("string", lambda ids, decoded: _digest(" ".join(map(_decimal.__getitem__, ids)))),
    "decoded_sha256": ("string", lambda ids, decoded: _digest(decoded())),
}


def encode_decode(docs: DataFrame, vocab_path: str, outputs: Iterable[str] = ("ids", "decoded"), most: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and the named outputs of each document; decoded comes from the ids alone."""
    sc, outputs = docs.sparkSession.sparkContext, list(outputs)
    file_bytes, lexicon = build(docs, vocab_path, most)
    sent, name = sc.broadcast((file_bytes, lexicon, probe())), uuid.uuid4().hex

    def start():
        codec: Codec = once(("codec", name), lambda: Codec(*sent.value))

        def row(doc_id, text):
            ids = codec.encode(text)
            seen: list[str] = []

            def decoded() -> str:
                if not seen:
                    seen.append(codec.decode(ids))
                return seen[0]

            return (doc_id, *(OUTPUTS[c][1](ids, decoded) for c in outputs))

        return row

    schema = ", ".join(["doc_id long", *(f"{c} {OUTPUTS[c][0]}" for c in outputs)])
    return map_rows(texts(docs), schema, start)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
