"""Token-id files with bit-plane shuffling.

A file holds the ids of many documents, in ascending key order. Ids are cut into blocks of ``block`` ids; a block is
transposed into planes (bit planes: bit k of every id; byte planes: byte k of every id), planes of zeros are left out,
and each other plane is compressed with zstandard, or stored as it is where that is smaller. A chunk index gives each
block's place, so a range of ids is read by decoding only the blocks it touches.

Layout, little-endian: ``GLTP``, u8 version, u8 plane width in bits (1 or 8), u16 0, u32 block, u64 ids, u64 documents,
u64 start of the index; the blocks; the index: per block u64 start, u32 ids, u32 mask of stored planes, u32 mask of
compressed planes, then one u32 size for each stored plane; at last the documents: zstandard of their int64 keys and
int64 id counts, and a null mask.

Texts are dealt to ranges of the key, and each range is encoded and becomes a file in the shared folder: one shuffle, of
about the size that the ids would have. The table of files names those whose task came to its end, so a task that was
lost, or ran twice, leaves no file in it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
BLOCK = 65_536
#: Text bytes that go into one file, about.
FILE_BYTES = 8 << 20
_HEAD = struct.Struct("<4sBBHIQQQ")


def _planes(ids: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    top = int(ids.max()).bit_length() if len(ids) else 0
    narrow = ids.astype(np.uint16) if top <= 16 else ids
    for k in range(-(-top // width)):
        if width == 1:
            plane = np.packbits(((narrow >> k) & 1).astype(np.uint8), bitorder="little")
        else:
            plane = ((narrow >> (8 * k)) & 255).astype(np.uint8)
        if plane.any():
            yield k, plane.tobytes()


def write_ids(ids: np.ndarray, keys: list[int | None], counts: list[int], block: int = BLOCK, width: int = 1) -> bytes:
    """One file. ``ids`` are the documents' ids in order; ``counts`` says how many each document has."""
    press = zstandard.ZstdCompressor(level=1)
    body, index, at = [], [], _HEAD.size
    for start in range(0, len(ids), block):
        part = ids[start : start + block]
        stored = pressed = 0
        sizes, begun = [], at
        for k, plane in _planes(part, width):
            small = press.compress(plane)
            if len(small) < len(plane):
                plane, pressed = small, pressed | 1 << k
            stored |= 1 << k
            sizes.append(len(plane))
            body.append(plane)
            at += len(plane)
        index.append(struct.pack(f"<QIII{len(sizes)}I", begun, len(part), stored, pressed, *sizes))
    docs = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array(counts, "<i8").tobytes() + bytes(k is None for k in keys)
    head = _HEAD.pack(b"GLTP", 1, width, 0, block, len(ids), len(keys), at)
    return b"".join([head, *body, *index, press.compress(docs)])


class TokenFile:
    """Reads one file, given as bytes or as an open file that can seek. ``ids(start, stop)`` reads and decodes the blocks
    it touches only; ``bytes_read`` counts what was read."""

    def __init__(self, source):
        self._source, self.bytes_read = source, 0
        size = len(source) if isinstance(source, bytes) else source.size()
        magic, version, self.width, _, self.block, self.n_ids, self.n_docs, at = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != b"GLTP" or version != 1:
            raise ValueError("not a token file of this version")
        tail, base = self._read(at, size - at), 0
        self._index = []
        for _ in range(-(-self.n_ids // self.block)):
            begun, n, stored, pressed = struct.unpack_from("<QIII", tail, base)
            sizes = struct.unpack_from(f"<{stored.bit_count()}I", tail, base + 20)
            self._index.append((begun, n, stored, pressed, sizes))
            base += 20 + 4 * len(sizes)
        docs = zstandard.ZstdDecompressor().decompress(tail[base:], max_output_size=17 * self.n_docs + 1)
        keys, counts = (np.frombuffer(docs, "<i8", self.n_docs, 8 * self.n_docs * k) for k in (0, 1))
        missing = docs[16 * self.n_docs :]
        self.keys = [None if m else int(k) for k, m in zip(keys, missing)]
        self.counts = counts

    def _read(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        if isinstance(self._source, bytes):
            return self._source[at : at + size]
        self._source.seek(at)
        return self._source.read(size)

    def _block(self, k: int) -> np.ndarray:
        at, n, stored, pressed, sizes = self._index[k]
        data, at = self._read(at, sum(sizes)), 0
        whole = zstandard.ZstdDecompressor()
        wide = np.uint16 if stored < 1 << (16 // self.width) else np.uint32
        out = np.zeros(n, dtype=wide)
        planes = [p for p in range(32 // self.width) if stored >> p & 1]
        for p, size in zip(planes, sizes):
            raw = data[at : at + size]
            at += size
            if pressed >> p & 1:
                raw = whole.decompress(raw, max_output_size=n + 1)
            plane = np.frombuffer(raw, np.uint8)
            if self.width == 1:
                plane = np.unpackbits(plane, count=n, bitorder="little")
            out |= plane.astype(wide) << wide(p * self.width)
        return out.astype("<u4")

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        found = np.concatenate([self._block(k) for k in range(first, last + 1)])
        return found[start - first * self.block : stop - first * self.block]


def write_token_files(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 0, key: str = "doc_id", text: str = "text", block: int = BLOCK, width: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text and write the ids into files of about ``file_bytes`` of text. Returns the table of files, in the order
    of file_no: file_no, path, n_ids, n_docs. Files and documents follow ascending keys, null keys first.

    Null text counts as empty and leaves its end id alone. Rows that repeat a key stay, ordered by a hash of their text;
    however many they are, they are spread over files. Only key and text are read.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = common.new_folder(df.sparkSession, "token-files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            packed = encoder(tokenizer).encode(batch["text"].tolist())
            keys += [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            counts += [len(x) // 4 + 1 for x in packed]
            ids.append(np.frombuffer(tail.join([*packed, b""]), "<u4"))
        if not keys:
            return
        number = TaskContext.get().partitionId()
        path = f"{folder}/part-{number:08d}-{uuid.uuid4().hex}.gltp"
        store, inner = common.open_store(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(write_ids(np.concatenate(ids), keys, counts, block, width))
        yield pd.DataFrame({"file_no": [number], "path": [path], "n_ids": [sum(counts)], "n_docs": [len(keys)]})

    by = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("tie")]
    dealt = rows.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()}).repartitionByRange(total // file_bytes + 1, *by)
    files = dealt.sortWithinPartitions(*by).select("doc_id", "text").mapInPandas(write, "file_no int, path string, n_ids long, n_docs long")
    return common.shared_table(files, "files")


def _opened(path: str):
    store, inner = common.open_store(path)
    return store.open_input_file(inner)


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, read back from its file: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and the ids themselves if asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin in zip(batch["path"], batch["begin"]):
                with _opened(path) as source:
                    file = TokenFile(source)
                    packed = memoryview(file.ids().tobytes())
                ends = np.cumsum(file.counts)
                starts = ends - file.counts
                out = {"doc_id": pd.array(file.keys, dtype="Int64"), "start": starts + begin, "n_tokens": file.counts}
                out["ids_crc32"] = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                if with_ids:
                    out["ids"] = [np.frombuffer(packed[4 * a : 4 * b], "<u4").astype("int32") for a, b in zip(starts, ends)]
                yield pd.DataFrame(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    placed = common.running_total(files, "file_no", "n_ids", "begin")
    return placed.select("path", "begin").repartition(max(1, files.count()), "path").mapInPandas(read, schema)


def read_ranges(files: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The ids of ranges of places (start, stop) in the whole sequence of ids: at, part (place of its first id) and ids.
    Only the files and blocks that a range touches are read; ``bytes_read`` says how much of the file that was."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, at, start, stop in batch[["path", "begin", "at", "start", "stop"]].itertuples(index=False):
                with _opened(path) as source:
                    file = TokenFile(source)
                    first = max(start - begin, 0)
                    ids = file.ids(first, min(stop - begin, file.n_ids))
                yield pd.DataFrame({"at": [at], "part": [begin + first], "ids": [ids.astype("int32")], "bytes_read": [file.bytes_read]})

    asked = files.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(ranges)], "at int, start long, stop long")
    placed = common.running_total(files, "file_no", "n_ids", "begin")
    touched = placed.join(F.broadcast(asked), (F.col("begin") < F.col("stop")) & (F.col("begin") + F.col("n_ids") > F.col("start")))
    return touched.mapInPandas(read, "at int, part long, ids array<int>, bytes_read long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(common.documents(spark, sf_dir)))
