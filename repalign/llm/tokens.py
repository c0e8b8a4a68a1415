"""Token files: ids in blocks, transposed to planes and compressed, with an index of chunks and documents."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyarrow import fs

from .storage import kept, new_path, process_cache, shuffle_parts, text_batches

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
CACHE_WORDS = 800_000
_SEPARATOR = "~"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block: byte k of every id, or bit k of every id packed eight to a byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")[:n]
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class Writer:
    """Writes one file: MAGIC, compressed planes of all blocks, an index, its length, MAGIC.

    The index (JSON, compressed) has the mode, the block size, for each chunk its place, number of ids
    and plane sizes, and the documents' ids and lengths.
    """

    def __init__(self, stream, mode: str, block: int, level: int = 3) -> None:
        self.stream, self.mode, self.block = stream, mode, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held, self.place, self.ids = 0, len(MAGIC), 0
        self.chunks: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if rest else len(ids) - len(ids) % self.block
        for a in range(0, whole, self.block):
            part = ids[a:min(a + self.block, whole)]
            planes = [self.pack.compress(p) for p in to_planes(part, self.mode)]
            self.stream.write(b"".join(planes))
            self.chunks.append([self.place, len(part), *map(len, planes)])
            self.place += sum(map(len, planes))
        self.ids += whole
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.pack.compress(json.dumps({"mode": self.mode, "block": self.block, "chunks": self.chunks, "docs": self.docs, "lengths": self.lengths}).encode())
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.stream.close()


class Reader:
    """Random access to a file of ``Writer``."""

    def __init__(self, path: str) -> None:
        system, local = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(local)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        length = struct.unpack("<Q", tail[:8])[0]
        self.unpack = zstandard.ZstdDecompressor()
        index = json.loads(self.unpack.decompress(self.file.read_at(length, size - 16 - length)))
        self.mode, self.block, self.chunks, self.docs, self.lengths = (index[k] for k in ("mode", "block", "chunks", "docs", "lengths"))

    def chunk(self, k: int) -> np.ndarray:
        place, n, *sizes = self.chunks[k]
        data = self.file.read_at(sum(sizes), place)
        ends = np.cumsum(sizes)
        return from_planes([self.unpack.decompress(data[e - s:e]) for s, e in zip(sizes, ends)], n, self.mode)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any range of ids: only the chunks that hold it are read."""
        first, last = start // self.block, (start + count - 1) // self.block
        flat = np.concatenate([self.chunk(k) for k in range(first, last + 1)]) if count else np.zeros(0, np.uint32)
        return flat[start - first * self.block:][:count]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) one after the other; holds a chunk and a document at a time."""
        held, have, k = [], 0, 0
        for doc_id, length in zip(self.docs, self.lengths):
            while have < length:
                held.append(self.chunk(k))
                have += len(held[-1])
                k += 1
            flat = np.concatenate(held) if len(held) != 1 else held[0]
            yield doc_id, flat[:length]
            held, have = [flat[length:]], have - length


class Words:
    """Token ids of texts. Texts are cut at spaces, tabs and line feeds, which no token crosses, and
    the ids of each distinct part are computed once until there are more than ``CACHE_WORDS``. ``keep``
    hands them on to later tasks of the worker process."""

    def __init__(self, file: str, end: int) -> None:
        from tokenizers import Tokenizer

        loaded = process_cache("tokens")
        self.kept = loaded.setdefault(f"words:{file}", {})
        if "model" not in self.kept:
            self.kept["model"] = Tokenizer.from_file(file)
        self.model = self.kept["model"]
        self.end = np.array([end], np.uint32)
        mark = self.model.encode(_SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        if "words" in self.kept:  # of an earlier task of this worker
            self.place, self.starts, self.sizes, self.flat = self.kept["words"]
        else:
            self.forget()

    def keep(self) -> None:
        self.kept["words"] = self.place, self.starts, self.sizes, self.flat

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.starts, self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if _SEPARATOR not in w] if self.mark is not None else []
        odd = [w for w in words if self.mark is None or _SEPARATOR in w]
        ids = [np.array(self.model.encode(w, add_special_tokens=False).ids, np.uint32) for w in odd]
        sizes = [np.array([len(x) for x in ids], np.int64)]
        if plain:  # one call for all: the separator's id stands after each
            got = np.array(self.model.encode_batch_fast([f" {_SEPARATOR} ".join(plain) + f" {_SEPARATOR}"], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(got == self.mark)
            sizes.append(np.diff(np.concatenate([[-1], marks])) - 1)
            ids.append(got[got != self.mark])
        sizes = np.concatenate(sizes)
        for w in odd + plain:
            self.place[w] = len(self.place)
        begin = len(self.flat)
        self.starts = np.concatenate([self.starts, begin + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.forget()
        new = {w for words in split for w in words if w not in self.place}
        if new:
            self._learn(sorted(new))
        for words in split:
            at = np.array([self.place[w] for w in words], np.int64)
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            yield np.concatenate([self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - sizes), sizes)], self.end])


_MANIFEST = "part int, path string, docs long, ids long"


def write(docs: DataFrame, folder: str, tokenizer_file: str, end: int = 2, mode: str = "byte", block: int = BLOCK) -> DataFrame:
    """Write the token ids of all texts in ascending doc_id order; the manifest (part, path, docs, ids, start).

    Rows are dealt by ranges of doc_id (nulls first; rows of one id by text), and each task writes one
    file under a name of its own. Only files of tasks whose result counted are in the manifest,
    which is a table in the shared folder; ``start`` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = writer = None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if writer is None:
                    words = Words(tokenizer_file, end)
                    task = TaskContext.get().partitionId()
                    path = f"{folder}/part-{task:06d}-{uuid.uuid4().hex}.ids"
                    system, local = fs.FileSystem.from_uri(path)
                    system.create_dir(local.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(local), mode, block)
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    writer.add(doc_id, ids)
        if writer is not None:
            words.keep()
            writer.close()
            yield pa.record_batch([pa.array([task], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.ids], pa.int64())],
                                  names=["part", "path", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = kept(ranged.mapInArrow(run, _MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in Reader(path).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    files = manifest.select("path", "start")
    return files.repartition(max(1, shuffle_parts(manifest.sparkSession))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and return what reading them back gives.

    Null and empty texts have the end id only. An empty table writes no file and gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    return read(write(docs, new_path(spark, "tokens"), tokenizer_file, **options))
