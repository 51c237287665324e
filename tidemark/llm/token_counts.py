"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers give the counts, and no ids are made:

* The splitter reads character classes and marks where pieces begin. Texts are cut into chunks; each chunk is reduced
  to a state map (entry state -> exit state) in one vectorised pass over all entry states, the maps compose by a
  parallel prefix scan, and a last pass from the known entry states marks the boundaries. Composition is associative,
  so a text of any length is worked on in chunks.
* The counter reads a piece's bytes. Its state is, for each suffix that some token still could continue, the token
  that ends before it and that prefix's token count; each transition is annotated with the change of the emitted
  token count. States and transitions are compiled when first met and forgotten when there are too many.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids are carried; repeated rows give repeated
results; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import Merges, byte_chars
from .code_points import CodePoints, probe
from .common import batched, once, schema_of, ship, texts

#: Character classes.
LETTER, S, RV, LL, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(11)
#: Splitter states.
START, LET, NUM, OTH, QUO, SP1, WS1, SPN, WSN, Q_RV, Q_L, DONE = range(12)
#: Marks on a transition: a piece begins at this character, or at the one before it.
HERE, BEFORE = 1, 2
CHUNK = 128
#: The counter forgets its states at this many transitions, a worker its memo of pieces at this many entries.
TRANSITIONS, MEMO = 600_000, 250_000


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, by state and class, of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a character|white space."""
    letters = (LETTER, S, RV, LL, E)
    fresh = dict.fromkeys(letters, LET) | {NUMBER: NUM, SPACE: SP1, WHITE: WS1, QUOTE: QUO, OTHER: OTH, END: START}
    joined = dict.fromkeys(letters, LET) | {NUMBER: NUM, QUOTE: OTH, OTHER: OTH}  # after one space
    to, mark = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    for state in range(12):
        for c in range(11):
            n, m = fresh[c], HERE * (c != END)
            if state == LET and c in letters or state == NUM and c == NUMBER:
                n, m = state, 0
            elif state == OTH and c in (QUOTE, OTHER):
                n, m = OTH, 0
            elif state == QUO and c in (S, RV, LL, QUOTE, OTHER):
                n, m = {S: DONE, RV: Q_RV, LL: Q_L, QUOTE: OTH, OTHER: OTH}[c], 0
            elif state == Q_RV and c == E or state == Q_L and c == LL:
                n, m = DONE, 0
            elif state in (Q_RV, Q_L):  # no contraction: the letter before begins a piece
                n, m = (LET, BEFORE) if c in letters else (n, m | BEFORE)
            elif state in (SP1, WS1, SPN, WSN) and c in (SPACE, WHITE):
                n, m = SPN if c == SPACE else WSN, 0
            elif state in (SP1, SPN) and c in joined:
                n, m = joined[c], BEFORE * (state == SPN)
            elif state == WSN and c != END:
                m |= BEFORE
            to[state, c], mark[state, c] = n, m
    return to, mark


def class_table(points: CodePoints) -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for ranges, c in ((points.letters, LETTER), (points.numbers, NUMBER), (points.white, WHITE)):
        for a, b in ranges:
            table[a : b + 1] = c
    for chars, c in (("stmd", S), ("rv", RV), ("l", LL), ("e", E), (" ", SPACE), ("'", QUOTE)):
        for x in chars:
            table[ord(x)] = c
    return table


class Splitter:
    def __init__(self, points: CodePoints | None = None):
        self.to, self.mark = splitter()
        self.table = class_table(points or probe())

    def state_maps(self, classes: np.ndarray) -> np.ndarray:
        """The state map of each row of classes (chunks x length): exit states by entry state."""
        maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (len(classes), 12)).copy()
        flat = self.to.ravel()
        for k in range(classes.shape[1]):
            maps = flat[maps * np.uint8(11) + classes[:, k : k + 1]]
        return maps

    @staticmethod
    def entries(maps: np.ndarray, state: int) -> np.ndarray:
        """Each chunk's entry state, by a prefix scan that composes maps of doubling spans."""
        scan, step = maps.copy(), 1
        while step < len(scan):
            later = np.take_along_axis(scan[step:], scan[:-step].astype(np.intp), axis=1)
            scan[step:] = later
            step *= 2
        return np.concatenate([[state], scan[:-1, state]]).astype(np.uint8)

    def boundaries(self, text: str) -> np.ndarray:
        """Where pieces begin in text, ascending. The character \\0 may not stand for an end here: callers pass plain segments."""
        return self.of_classes(self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)])

    def of_classes(self, classes: np.ndarray) -> np.ndarray:
        n = len(classes)
        rows = -(-(n + 1) // CHUNK)
        padded = np.full(rows * CHUNK, END, np.uint8)
        padded[:n] = classes
        padded = np.ascontiguousarray(padded.reshape(rows, CHUNK))
        state = self.entries(self.state_maps(padded), START)
        marks = np.empty((rows, CHUNK), np.uint8)
        to, mark = self.to.ravel(), self.mark.ravel()
        for k in range(CHUNK):
            at = state * np.uint8(11) + padded[:, k]
            marks[:, k] = mark[at]
            state = to[at]
        marks = marks.ravel()
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins[:n])


class Counter:
    """The counting transducer over the bytes of a piece."""

    def __init__(self, merges: Merges):
        self.merges = merges
        back = {c: b for b, c in enumerate(byte_chars())}
        self.children: list[dict[int, int]] = [{}]  # a trie of the tokens
        self.token: list[int] = [-1]
        self.spelt: dict[int, bytes] = {}
        for text, k in merges.vocab.items():
            if any(c not in back for c in text):
                continue
            raw = bytes(back[c] for c in text)
            if merges(raw) != [k]:  # no text is encoded to it
                continue
            self.spelt[k] = raw
            node = 0
            for b in raw:
                if (to := self.children[node].get(b)) is None:
                    to = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = k
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.compiled = 0
        self.start = self.state(((0, -1, 0),))

    def state(self, content: tuple) -> int:
        if (k := self.states.get(content)) is None:
            k = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        return k

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a within a piece."""
        key = a << 20 | b
        if (out := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            out = self.fits[key] = self.merges(self.spelt[a] + self.spelt[b]) == [a, b]
        return out

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        alive, won = [], None
        for node, before, count in self.content[state]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            token = self.token[to]
            if won is None and token >= 0 and (before < 0 or self.compatible(before, token)):
                won = (token, count + 1)
            if self.children[to]:
                alive.append((to, before, count))
        token, delta = won  # one token always ends here: each byte is one
        content = (*((node, before, count - delta) for node, before, count in alive), (0, token, 0))
        move = self.moves[state][byte] = (self.state(content), delta)
        self.compiled += 1
        return move

    def count(self, piece: bytes) -> int:
        if self.compiled > TRANSITIONS:
            self.reset()
        state, total, moves = self.start, 0, self.moves
        for b in piece:
            move = moves[state].get(b) or self.compile(state, b)
            state = move[0]
            total += move[1]
        return total


class _Memo(dict):
    """Token counts of pieces seen by this worker, in two generations."""

    def __init__(self, counter: Counter):
        self.counter, self.old = counter, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        n = self.old.get(piece)
        if n is None:
            n = self.counter.count(piece.encode())
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Token counts of whole texts."""

    def __init__(self, file_bytes: bytes, points: CodePoints | None = None):
        spec = json.loads(file_bytes)
        self.splitter = Splitter(points)
        self.memo = _Memo(Counter(Merges(spec["model"])))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def many(self, texts: list[str | None]) -> list[int]:
        """Counts of many texts in one pass of the splitter; an end stands between segments."""
        segments, owner, out = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special and "<|" in text else [text]
            out[k] += len(parts) - 1  # the special tokens
            for part in parts:
                if part:
                    segments.append(part)
                    owner.append(k)
        if not segments:
            return out
        joined = "\n".join(segments)
        classes = self.splitter.table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(x) + 1 for x in segments])
        classes[ends[:-1] - 1] = END
        begins = self.splitter.of_classes(classes)
        of = np.searchsorted(ends, begins, side="right")  # the segment of each piece
        stops = np.append(begins[1:], len(joined))
        stops = np.minimum(stops, ends[of] - 1)
        counts = map(self.memo.__getitem__, [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist())])
        sums = np.bincount(of, weights=np.fromiter(counts, np.int64, len(begins)), minlength=len(segments)).astype(np.int64)
        for k, n in zip(owner, sums.tolist()):
            out[k] += n
        return out


class _Rows:
    """Whole texts, some megabytes at a time."""

    def __init__(self, start, schema):
        self.start, self.schema = start, schema

    def __call__(self, batches):
        counter = self.start()

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    yield from zip(ids, (len(t.encode()) if t else 0 for t in texts), counter.many(texts))

        yield from batched(rows(), self.schema)


def token_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each document; the vocabulary file is of fixed size and is broadcast."""
    sc = docs.sparkSession.sparkContext
    with open(vocab_path, "rb") as f:
        sent, name = sc.broadcast((f.read(), probe())), uuid.uuid4().hex
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long"
    start = lambda: once(("counter", name), lambda: TokenCounter(*sent.value))
    return texts(docs).mapInArrow(_Rows(start, schema_of(schema)), schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
