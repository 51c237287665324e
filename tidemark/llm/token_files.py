"""Token ids in length-delimited binary record files, with a separate offset index for shuffled reads.

A data file is a run of records: 8 bytes length (little-endian), 4 bytes masked CRC-32C of the length, the serialized
sequence, 4 bytes masked CRC-32C of it. A sequence is one byte, the width of an id (2 where every id is below 65,536,
else 4), and the ids as little-endian unsigned integers of that width. Its index file holds, for each record, 32
bytes: document id, first byte of the record, ids of the file before it, number of ids (signed 64-bit). Files hold
ascending ranges of document ids, and a manifest (Parquet) has a row for each file, so that a record is read by one
seek and a reader can take records in any order.

A task writes under a name of its own attempt and renames at its end: an attempt that is lost or repeated leaves no
half file that a reader could take, and the manifest names the files of the attempts that counted.

Defined results: a null text counts as empty (its record has the end id alone); a null id sorts first and stays null
in what is read back; repeated rows are separate records in the order of their text; an empty table gives no files and
no rows; other columns are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Words, byte_chars
from .code_points import CodePoints, probe
from .common import batched, new_path, once, schema_of, ship, texts

#: A null document id in an index file.
NULL_ID = -(1 << 63)
INDEX = struct.Struct("<4q")
#: Bytes that a reader asks for at once.
READ = 4 << 20
#: Tasks that read files; with more files than that a task reads several.
MOST_READERS = 20_000
#: The file closes and a new one begins at about this many bytes, so that no reader's share grows with a task's.
FILE_BYTES = 64 << 20


LANE = 256


def _crc_tables() -> np.ndarray:
    """CRC-32C (reflected polynomial 0x82F63B78): by place in a lane, the remainder that each byte there leaves at the lane's end."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    out = np.empty((LANE, 256), np.uint32)
    out[-1] = t
    for k in range(LANE - 2, -1, -1):
        out[k] = t[out[k + 1] & 255] ^ (out[k + 1] >> np.uint32(8))
    return out


_TABLES = _crc_tables()
_PLACES = np.arange(LANE)
#: What a lane of zero bytes makes of each byte of a remainder.
_OVER = np.array([_TABLES[k] for k in range(4)])


def crc32c(data: bytes) -> int:
    """CRC-32C. A remainder is linear in the bytes, so each lane's is one table lookup and XOR; lanes then chain."""
    n = len(data)
    if n < 4:
        c = 0xFFFFFFFF
        for b in data:
            c = int(_TABLES[-1][(c ^ b) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    lanes = -(-n // LANE)
    x = np.zeros(lanes * LANE, np.uint8)  # zeros in front change nothing
    x[-n:] = np.frombuffer(data, np.uint8)
    x[lanes * LANE - n : lanes * LANE - n + 4] ^= 255
    out = 0
    for at in range(0, lanes, 16384):
        part = x[at * LANE : (at + 16384) * LANE].reshape(-1, LANE)
        for r in np.bitwise_xor.reduce(_TABLES[_PLACES, part], axis=1).tolist():
            if out:
                r ^= int(_OVER[0][out & 255] ^ _OVER[1][out >> 8 & 255] ^ _OVER[2][out >> 16 & 255] ^ _OVER[3][out >> 24])
            out = r
    return out ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """Rotated right by 15 bits, plus a constant: a checksum of data that hold checksums stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def serialized(ids: bytes) -> bytes:
    """Ids, given as little-endian unsigned 32-bit integers, as a record's sequence."""
    wide = np.frombuffer(ids, "<u4")
    width, code = (2, "<u2") if not len(wide) or int(wide.max()) < 1 << 16 else (4, "<u4")
    return bytes([width]) + wide.astype(code).tobytes()


def restored(data: bytes) -> bytes:
    """A serialized sequence's ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, {2: "<u2", 4: "<u4"}[data[0]], offset=1).astype("<u4").tobytes()


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(crc32c(head))), data, struct.pack("<I", masked(crc32c(data)))))


def unframe(read) -> bytes:
    """One record's serialized sequence from read(n); both checksums are checked."""
    head = read(12)
    n, check = struct.unpack("<QI", head)
    if masked(crc32c(head[:8])) != check:
        raise ValueError("a record's length does not match its checksum")
    data = read(n)
    if len(data) != n or masked(crc32c(data)) != struct.unpack("<I", read(4))[0]:
        raise ValueError("a record's ids do not match their checksum")
    return data


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Write:
    """Rows (doc_id, text) in order: writes files, gives a manifest row of each."""

    def __init__(self, encoder, folder: str, end_id: int, file_bytes: int, schema):
        self.encoder, self.folder, self.end_id, self.file_bytes, self.schema = encoder, folder, end_id, file_bytes, schema

    def __call__(self, batches):
        from pyspark import TaskContext

        yield from batched(self.files(batches, TaskContext.get().partitionId()), self.schema)

    def files(self, batches, part: int) -> Iterator[tuple]:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        encode, tail = self.encoder(), struct.pack("<I", self.end_id)
        out, k = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    if out is None:
                        name = f"{folder}/part-{part:06d}-{k:04d}-{uuid.uuid4().hex}"
                        out, index, first, bytes_, tokens = fs.open_output_stream(f"{name}.tmp"), bytearray(), doc_id, 0, 0
                    record = frame(serialized(ids + tail))
                    index += INDEX.pack(NULL_ID if doc_id is None else doc_id, bytes_, tokens, len(ids) // 4 + 1)
                    out.write(record)
                    bytes_, tokens = bytes_ + len(record), tokens + len(ids) // 4 + 1
                    if bytes_ >= self.file_bytes:
                        yield self.close(fs, out, name, index, part, k, first, tokens)
                        out, k = None, k + 1
        if out is not None:
            yield self.close(fs, out, name, index, part, k, first, tokens)

    def close(self, fs, out, name, index, part, k, first, tokens) -> tuple:
        out.close()
        with fs.open_output_stream(f"{name}.idx") as f:
            f.write(bytes(index))
        fs.move(f"{name}.tmp", f"{name}.rec")
        return (part, k, name.rpartition("/")[2], first, len(index) // INDEX.size, tokens)


MANIFEST = "part int, file int, name string, first_id long, records long, tokens long"


def write(docs: DataFrame, folder: str, encoder, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) under folder in ascending id order and returns the manifest. encoder() gives a function from texts to their ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(_Write(encoder, folder, end_id, file_bytes, schema_of(MANIFEST)), MANIFEST)
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class _Read:
    """Manifest rows (name, base): the records of each file through its index."""

    def __init__(self, folder: str, schema):
        self.folder, self.schema = folder, schema

    def __call__(self, batches):
        yield from batched(self.records(batches), self.schema)

    def records(self, batches) -> Iterator[tuple]:
        fs, folder = file_system(self.folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{folder}/{name}.idx") as f:
                    index = f.read()
                with fs.open_input_stream(f"{folder}/{name}.rec", buffer_size=READ) as f:
                    place = 0
                    for doc_id, at, before, n in INDEX.iter_unpack(index):
                        if at != place:
                            raise ValueError("the index does not match its records")
                        data = unframe(f.read)
                        place += 16 + len(data)
                        ids = restored(data)
                        if len(ids) != 4 * n:
                            raise ValueError("the index does not match its records")
                        yield (None if doc_id == NULL_ID else doc_id, base + before, n, ids)


def record(folder: str, name: str, k: int) -> tuple[int | None, bytes]:
    """One record of a file by its place in the index: a shuffled read."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}.idx") as f:
        f.seek(INDEX.size * k)
        doc_id, at, _, _ = INDEX.unpack(f.read(INDEX.size))
    with fs.open_input_file(f"{path}/{name}.rec") as f:
        f.seek(at)
        return None if doc_id == NULL_ID else doc_id, restored(unframe(f.read))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian bytes) of every record. What stands before a file is summed by part, then within the part: the driver sees the number of files only."""
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = "doc_id long, start long, n_tokens long, ids binary"
    n = manifest.count()
    if not n:
        return spark.createDataFrame([], schema)
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("t").over(until(Window.orderBy("part"))), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("tokens").over(until(Window.partitionBy("part").orderBy("file"))), F.lit(0))
    files = manifest.withColumn("own", own).join(parts, "part").select("name", (F.col("before") + F.col("own")).alias("base"))
    return files.repartition(min(n, MOST_READERS)).mapInArrow(_Read(folder, schema_of(schema)), schema)


class LibraryEncoder:
    """Texts to ids by the tokenizers library, with a memo of white-space separated chunks: the file's words never cross one.

    The words of chunks that the memo lacks go to the library's model. Texts that may hold a special token's string, or
    that hold code points which Python's tables lack, go to the library whole.
    """

    MEMO = 400_000

    def __init__(self, spec: str, points: CodePoints | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        words = Words(json.loads(spec), points or probe())
        self.chunks, self.split, self.odd, self.chars = words.chunks, words.split, words.odd, byte_chars()
        self.memo, self.numbers = _Chunks(self.ids_of, self.MEMO), _Chunks(self.number_of, self.MEMO)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def tokens_of(self, word: str) -> list:
        return self.tokenize(word if word.isascii() and word.isprintable() else "".join([self.chars[b] for b in word.encode()]))

    def ids_of(self, chunk: str) -> bytes:
        words = self.split(chunk)
        if words != [chunk]:
            return b"".join(map(self.memo.__getitem__, words))
        ids = [t.id for t in self.tokens_of(chunk)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def number_of(self, chunk: str) -> int:
        words = self.split(chunk)
        return len(self.tokens_of(chunk)) if words == [chunk] else sum(map(self.numbers.__getitem__, words))

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        known = self.numbers.__getitem__
        return [0 if not t else len(self.whole(t)) // 4 if "<|" in t or self.odd(t) else sum(map(known, self.chunks(t))) for t in texts]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        known = self.memo.__getitem__
        return [b"" if not t else self.whole(t) if "<|" in t or self.odd(t) else b"".join(map(known, self.chunks(t))) for t in texts]


class _Chunks(dict):
    """What is made of chunks and words seen by this worker, in two generations: what is used again outlives the rest."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk: str):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def library_encoder(spark: SparkSession, vocab_path: str):
    """An encoder of the vocabulary file, which is of fixed size and is broadcast."""
    with open(vocab_path, encoding="utf-8") as f:
        sent, name = spark.sparkContext.broadcast((f.read(), probe())), uuid.uuid4().hex
    return lambda: once(("library", name), lambda: LibraryEncoder(*sent.value))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "token-files")
    write(docs, folder, library_encoder(spark, public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
