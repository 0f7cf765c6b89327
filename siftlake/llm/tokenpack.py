"""Token ids in files of fixed-width packed bits.

A file holds ids of one vocabulary in the fewest bits that fit it.  Layout, all
little-endian: the header (8 bytes magic, uint32 vocabulary, bits, ids in a
block), the blocks (each of whole bytes; the last may be shorter), the offsets
of the blocks (uint64), a document table (int64 id, uint8 whether the id is
null, uint64 first id of each document), and a footer (uint64 place of the
offsets, number of blocks, of documents, of ids; 8 bytes magic).  A block's ids
are unpacked by numpy at once; any range of ids needs only its own blocks.

Documents are dealt to files by ranges of their id, so the files in order hold
all documents in ascending id; rows of one id follow each other by text, a null
id comes first.  A null text is an empty one; bytes that are no UTF-8 count as the
replacement character.  Ids are numbers of 64 bits or their decimal text.  A task
writes under a name of its
own and reports it, so a task that runs twice leaves an unread file and no doubt.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import shared
from siftlake.llm.text import ragged, slices, strings

MAGIC, END = b"IDPACK01", b"IDPACKED"
BLOCK, FILE_IDS, FILE_DOCS = 1 << 14, 1 << 26, 1 << 22
_HEAD, _FOOT = struct.Struct("<8sIII"), struct.Struct("<QQQQ8s")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, the first in the lowest bits, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """One file; add() documents, close()."""

    def __init__(self, uri: str, vocabulary: int, block: int = BLOCK):
        fs, path = store(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.bits, self.block = uri, bits_for(vocabulary), block
        self.out = fs.open_output_stream(path)
        self.out.write(_HEAD.pack(MAGIC, vocabulary, self.bits, block))
        self.at, self.offsets, self.left, self.n_ids = _HEAD.size, [], np.zeros(0, np.uint32), 0
        self.doc_ids, self.null, self.starts, self.n_docs = [], [], [], 0

    def add(self, doc_ids: pa.Array, edge: np.ndarray, ids: np.ndarray) -> None:
        """Documents with ids[edge[i]:edge[i + 1]]."""
        self.null.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy().astype("<i8"))
        self.n_docs += len(doc_ids)
        self.starts.append(edge[:-1] + self.n_ids)
        self.n_ids += len(ids)
        ids = np.concatenate((self.left, ids.astype(np.uint32)))
        whole = len(ids) // self.block * self.block
        for lo in range(0, whole, self.block):
            self._block(ids[lo : lo + self.block])
        self.left = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_ids(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        null = np.concatenate([np.zeros(0, np.uint8), *self.null]).astype(np.uint8)
        ids, starts = np.concatenate([np.zeros(0, "<i8"), *self.doc_ids]), np.concatenate([np.zeros(0), *self.starts])
        self.out.write(np.array(self.offsets, "<u8").tobytes() + ids.tobytes() + null.tobytes() + starts.astype("<u8").tobytes())
        self.out.write(_FOOT.pack(self.at, len(self.offsets), len(ids), self.n_ids, END))
        self.out.close()


class Reader:
    """Random access to the ids and documents of one file."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.vocabulary, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        at, blocks, docs, self.n_ids, end = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or end != END:
            raise ValueError(f"{uri} is no file of packed ids")
        raw = self.file.read_at(size - _FOOT.size - at, at)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), at).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(raw, np.uint8, docs, 8 * blocks + 8 * docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs), self.n_ids).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop; only the blocks that hold them are read."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        if self.block * self.bits % 8 == 0:  # full blocks are contiguous bits
            got = unpack_ids(data, min(self.n_ids, (b + 1) * self.block) - a * self.block, self.bits)
        else:
            got = np.concatenate([unpack_ids(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], min(self.n_ids, (k + 1) * self.block) - k * self.block, self.bits) for k in range(a, b + 1)])
        return got[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, at_once: int = 1 << 22):
        """(first, ids, edge) of runs of documents with about at_once ids."""
        first = 0
        while first < len(self.doc_ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + at_once, "right")) - 1)
            yield first, self.ids(int(self.starts[first]), int(self.starts[last])), self.starts[first : last + 1] - self.starts[first]
            first = last


class _Memo(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


#: A space that does not begin a chunk: white space or the end follows.
_LOOSE = re.compile(r" (?=\s|\Z)")


class Encoder:
    """Whole texts to ids with a byte-level BPE tokenizer of the tokenizers library.

    Its pattern takes a space to the word after it, and nothing that it matches
    reaches over a space between two words; so a text is the sequence of its
    chunks (words with the space before), and each distinct chunk is encoded once.
    A text where a space stands before white space or the end is encoded whole; so is
    every text where the tokenizer cuts or changes texts in another way.
    """

    def __init__(self, path: str, most: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        how = made.get("pre_tokenizer") or {}
        self.chunked = not made.get("normalizer") and how.get("type") == "ByteLevel" and not how.get("add_prefix_space", True) and how.get("use_regex", True)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.size = np.zeros(self.vocabulary, np.int64)  # bytes of each token: its string has a character for each
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.memo = _Memo()
        self.memo.new = []
        self.pool, self.first, self.count, self.chars = [], [], [], 0

    def _learn(self) -> None:
        """Encodes the new chunks: those that begin with a space as runs of text, cut at the chunks' edges."""
        new, self.memo.new = self.memo.new, []
        self.chars += sum(map(len, new))
        at = sum(map(len, self.pool))
        spaced = [c for c in new if c[0] == " "]
        order = [i for i, c in enumerate(new) if c[0] == " "] + [i for i, c in enumerate(new) if c[0] != " "]
        runs = [spaced[i : i + 1000] for i in range(0, len(spaced), 1000)]
        rest = [c for c in new if c[0] != " "]
        ids, n = [], []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            stop = np.cumsum(self.size[got])
            edge = np.cumsum([len(c.encode()) for c in run])
            cut = np.searchsorted(stop, edge)
            if len(stop) and stop[-1] == edge[-1] and (stop[cut] == edge).all():
                ids.append(got)
                n.append(np.diff(np.concatenate(([0], cut + 1))))
            else:
                each = [x.ids for x in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
                ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
                n.append(np.fromiter(map(len, each), np.int64, len(each)))
        each = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
        n.append(np.fromiter(map(len, each), np.int64, len(each)))
        n = np.concatenate(n).astype(np.int64)
        first, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        first[order], count[order] = at + np.cumsum(n) - n, n
        self.pool.append(np.concatenate(ids))
        self.first.append(first)
        self.count.append(count)
        if len(self.pool) > 1:
            self.pool, self.first, self.count = [np.concatenate(self.pool)], [np.concatenate(self.first)], [np.concatenate(self.count)]

    def encode(self, texts: list[str | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edge) of the texts, each with the end id if there is one."""
        if self.chars > self.most:
            self._clear()
        memo, codes, sizes, whole = self.memo, [], [], []
        for k, text in enumerate(texts):
            if not text:
                sizes.append(0)
            elif not self.chunked or _LOOSE.search(text):
                whole.append(k)
                sizes.append(0)
            else:
                chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else None
                if chunks is None:
                    whole.append(k)
                    sizes.append(0)
                    continue
                if not chunks[0]:
                    del chunks[0]
                codes += map(memo.__getitem__, chunks)
                sizes.append(len(chunks))
        self._learn()
        code = np.array(codes, np.int64)
        first, count, pool = self.first[0], self.count[0], self.pool[0]
        n = count[code]
        ids = pool[ragged(first[code], n)]
        edge = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        if whole or end is not None:
            direct = dict(zip(whole, (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)), strict=True)) if whole else {}
            tail = np.array([] if end is None else [end], np.uint32)
            parts = [np.concatenate((direct[k] if k in direct else ids[edge[k] : edge[k + 1]], tail)) for k in range(len(texts))]
            edge = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            ids = np.concatenate(parts) if parts else ids
        return ids, edge


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker, which keeps what it has learned."""
    return Encoder(path)


_MANIFEST = "part int, seq int, uri string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", end: int | None = 0, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes and writes all rows; (part, seq, uri, n_docs, n_ids) of the files, already written."""
    spark = docs.sparkSession
    to = shared.fresh(spark, "ids")
    given = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    # rows of one id may be many, as those without: their texts' first letters divide them too
    ranged = given.repartitionByRange(shared.partitions(spark), F.col("id"), F.substring("text", 1, 24)).sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, writer, coder = TaskContext.get().partitionId(), 0, None, encoder(tokenizer)

        def done():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([writer.uri]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "seq", "uri", "n_docs", "n_ids"])

        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                writer = writer or Writer(f"{to}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids", coder.vocabulary, block)
                ids, edge = coder.encode(strings(piece.column(1)), end)
                writer.add(piece.column(0), edge, ids)
                if writer.n_ids >= file_ids or writer.n_docs >= FILE_DOCS:
                    yield done()
                    writer, seq = None, seq + 1
        if writer:
            yield done()
        shared.release()

    return shared.written(ranged.mapInArrow(run, _MANIFEST), "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files; one manifest row for each file goes through the driver."""
    files = sorted(manifest.select("part", "seq", "uri", "n_ids").collect())
    start, rows = 0, []
    for f in files:
        rows.append((f.uri, start))
        start += f.n_ids
    listed = spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows)), F.col("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(uri)
                for first, ids, edge in reader.documents():
                    n = len(edge) - 1
                    crc = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                    columns = [pa.array(reader.doc_ids[first : first + n], pa.int64(), mask=reader.null[first : first + n].astype(bool)), pa.array(edge[:-1] + before + reader.starts[first]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return listed.mapInArrow(run, schema)
