"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

A file holds a run of documents in ascending order of id: a header (magic,
number of documents, bytes of an id, hash of the dictionary), then one
compressed frame for each document, then the index (document id, offset and size
of the frame, number of ids) and the index's own offset. Frames are compressed
separately: IdFile reads the index at the end and then seeks to one frame. ids
are unsigned little-endian integers, of 16 bits where the vocabulary allows it.

The dictionary lies beside the files and is trained on a bounded sample: about
SAMPLE documents of smallest hash, each by CHUNKS chunks of CHUNK_IDS ids spread
over all its ids. Only the training is bounded; all documents are written whole.

Documents are range-partitioned by (id, hash of the text), about SHARD_BYTES of
text to a range and RANGES ranges at most, sorted, and encoded, compressed and
written in that one pass; a file ends at about SHARD_BYTES of frames, so memory
is bounded however large a range is. Equal and null ids spread over ranges too.
Names depend on range and place alone, so a task that runs again writes the same
files again. Where a file's ids start is the sum of the ranges before (a bounded
number, broadcast) and of the files before it in its range.

Encoding is what the library gives with add_special_tokens=False: a text that
spells an added token ("<|endoftext|>", say) gets that token's id there.

Defined cases: a null text is empty; an empty document has the end id alone;
null ids come first; rows of equal ids are ordered by a hash of their texts;
other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm.common import arrow_schema, forget_others, map_rows, memory, parts, shared_dir, table, texts
from driftlens.llm.pretokens import is_plain, is_word

END, MAGIC, NO_ID = 0, b"DLIDS2\n\0", -(1 << 63)
SAMPLE, CHUNKS, CHUNK_IDS, DICTIONARY, LEVEL = 2000, 8, 512, 112_640, 3
SHARD_BYTES, RANGES, MEMO = 8 << 20, 10_000, 250_000
_HEAD, _TAIL = struct.Struct("<8sQB7x32s"), struct.Struct("<Q8s")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])


#: One of these after a word is a word of its own.
_MARKS = frozenset(".,;:!?)\"")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """piece of a text, without the prefix that all of these have: its ids. In two generations of about MEMO pieces: what is asked for stays, what is not goes with the older one."""

    def __init__(self, prefix: str, work: Callable[[str], bytes]):
        super().__init__()
        self.prefix, self.work, self.old = prefix, work, {}

    def age(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.work(self.prefix + piece)
        self[piece] = ids
        return ids


class Encoder:
    """The tokenizers library over pieces of texts, each split into words, encoded by the library's model and then remembered.

    A text that spells an added token goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.end = array(self.kind, [END]).tobytes()
        self.model, self.letters, self.pattern = self.library.model, _byte_letters(), regex.compile(public_tokenizers.PATTERN)
        self.starts, self.after = _Pieces("", self._piece), _Pieces(" ", self._piece)  # at the start of a line, and after a space

    @property
    def width(self) -> int:
        return len(self.end)

    def _piece(self, piece: str) -> bytes:
        if piece[-1:] in _MARKS and is_word(piece[:-1]):
            words = [piece[:-1], piece[-1]]
        else:
            words = [piece] if is_word(piece) else self.pattern.findall(piece)
        if words == [piece]:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            return array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return b"".join([self.after[w[1:]] if w[0] == " " else self.starts[w] for w in words])

    def _plain(self, text: str) -> bytes:
        """The ids of a text whose spaces and line feeds stand alone."""
        out, after, lines = [], self.after.__getitem__, text.split("\n")
        for k, line in enumerate(lines):
            if k:
                out.append(self.starts["\n"])
            first, *rest = line.split(" ")
            out.append(self.starts[first])
            out.extend(map(after, rest))
        return b"".join(out)

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned integers of width bytes."""
        self.starts.age()
        self.after.age()
        out = []
        for text in texts_:
            if any(t in text for t in self.added):
                ids = array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()
            elif is_plain(text):
                ids = self._plain(text)
            else:
                ids = b"".join([self.after[w[1:]] if w[0] == " " else self.starts[w] for w in self.pattern.findall(text)])
            out.append(ids + self.end)
        return out


_encoders: dict[str, Encoder] = memory(__name__)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or no bytes if the samples are too few for one."""
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_file(documents: list[tuple[int, bytes, int]], dictionary: bytes, width: int = 2) -> bytes:
    """A file of (id, frame, number of ids)."""
    index = np.zeros(len(documents), _ENTRY)
    at = _HEAD.size
    for k, (doc, frame, n) in enumerate(documents):
        index[k] = (doc, at, len(frame), n)
        at += len(frame)
    head = _HEAD.pack(MAGIC, len(documents), width, hashlib.sha256(dictionary).digest())
    return b"".join([head, *(frame for _, frame, _ in documents), index.tobytes(), _TAIL.pack(at, MAGIC)])


class IdFile:
    """Reads single documents of an open file: the header and the index at first, then one frame by one seek."""

    def __init__(self, source: BinaryIO, dictionary: bytes):
        self.source = source
        magic, n, width, digest = _HEAD.unpack(source.read(_HEAD.size))
        source.seek(-_TAIL.size, os.SEEK_END)
        at, tail = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a file of ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        source.seek(at)
        self.index, self.dtype = np.frombuffer(source.read(n * _ENTRY.itemsize), _ENTRY), np.dtype(f"<u{width}")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def find(self, doc_id: int | None) -> range:
        """Places of the documents of an id."""
        low, high = (int(np.searchsorted(self.index["doc_id"], NO_ID if doc_id is None else doc_id, side)) for side in ("left", "right"))
        return range(low, high)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the document in place k."""
        entry = self.index[k]
        self.source.seek(int(entry["offset"]))
        out = np.frombuffer(self.decompressor.decompress(self.source.read(int(entry["size"]))), self.dtype)
        if len(out) != entry["n"]:
            raise ValueError(f"document {entry['doc_id']} is damaged")
        return out


def _writer(folder: str, path: str, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes, compresses and writes a range's documents, in the order in which they come."""
    schema = arrow_schema("part long, place long, file string, tokens long")
    limit = SHARD_BYTES  # the driver's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        own = encoder(path)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        fs, base = pafs.FileSystem.from_uri(folder)
        held: list[tuple[int, bytes, int]] = []
        size = place = part = 0

        def close() -> pa.RecordBatch:
            name = f"{base}/{part:08d}-{place:08d}.ids"
            draft = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(write_file(held, dictionary, own.width))
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                fs.move(draft, name)  # whole or not at all
            else:
                fs.delete_file(draft)  # another run of this task wrote the same
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, place, name, sum(n for _, _, n in held))], schema=schema)

        for batch in batches:
            for rows in parts(batch):
                for part, doc, ids in zip(rows.column("part").to_pylist(), rows.column("doc_id").to_pylist(), own.encode(rows.column("text").to_pylist()), strict=True):  # noqa: B007
                    held.append((NO_ID if doc is None else doc, compressor.compress(ids), len(ids) // own.width))
                    size += len(held[-1][1])
                    if size >= limit:
                        yield close()
                        held, size, place = [], 0, place + 1
        if held:
            yield close()

    return run


def _reader(folder: str, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = arrow_schema("doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(name) as source:
                    own = IdFile(source, dictionary)
                    crcs = [zlib.crc32(own.ids(k).astype("<u4").tobytes()) for k in range(len(own.index))]
                n = own.index["n"].astype(np.int64)
                docs = [None if d == NO_ID else d for d in own.index["doc_id"].tolist()]
                columns = [docs, start + np.cumsum(n) - n, n, crcs, own.index["size"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _chunks(path: str) -> Callable[[], Callable[[dict[str, list]], dict[str, list]]]:
    """Of each document, chunks at even distances over all its ids."""

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        own = encoder(path)
        size = CHUNK_IDS * own.width

        def one(columns: dict[str, list]) -> dict[str, list]:
            out = []
            for ids in own.encode(columns["text"]):
                n = -(-len(ids) // size)
                out += [ids[k * n // CHUNKS * size : (k * n // CHUNKS + 1) * size] for k in range(CHUNKS)] if n > CHUNKS else [ids]
            return {"ids": out}

        return one

    return make


def _dictionary(docs: DataFrame, path: str, n: int) -> bytes:
    """Trained on about SAMPLE of n documents, those whose hash is least; twice as many at most, should many have one hash."""
    if not n:
        return b""
    share = min(1.0, SAMPLE / n)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * SAMPLE)
    return train_dictionary(sorted(r[0] for r in map_rows(sample, _chunks(path), "ids binary").collect()))


def write_ids(docs: DataFrame, folder: str, path: str) -> tuple[DataFrame, bytes]:
    """Writes the files to a shared folder; returns (part, place, file, tokens) of each, in a table, and the dictionary."""
    docs = texts(docs)
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length("text") + 16)).first()
    dictionary = _dictionary(docs, path, n)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranges = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(min(RANGES, max(1, round((total or 0) / SHARD_BYTES))), *key)
    ordered = ranges.sortWithinPartitions(*key).select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")
    ordered.mapInArrow(_writer(folder, path, dictionary), "part long, place long, file string, tokens long").write.parquet(f"{folder}/files")
    return docs.sparkSession.read.parquet(f"{folder}/files"), dictionary


def read_ids(files: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, frame_bytes) of every document in the files."""
    starts, at = [], 0
    for part, tokens in sorted(files.groupBy("part").agg(F.sum("tokens")).collect()):  # RANGES rows at most
        starts.append((part, at))
        at += tokens
    bases = files.sparkSession.createDataFrame(starts, "part long, base long")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    todo = placed.join(F.broadcast(bases), "part").select("file", (F.col("base") + F.col("before")).alias("start"))
    return todo.repartition(max(1, len(starts)), "file").mapInArrow(_reader(folder, dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")


def op5_ids_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ids"
    files, dictionary = write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(files, folder, dictionary)
