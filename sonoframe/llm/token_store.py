"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents. Every id takes the minimum number of bits that the vocabulary needs, in
blocks of BLOCK ids that start on byte borders. Its end says where all is: the block offsets, and each document's id and
number of tokens. Thus any document or block can be read alone, and blocks are packed and unpacked by numpy.

    payload blocks | document ids, int64 | document sizes, int64 | block offsets, uint64 | tail of TAIL bytes

Documents are dealt to files by range of id, so the files in order hold all documents in ascending order. Writers put
files into the shared folder under names of their own attempt; only those that the manifest (a table Spark commits)
names count, so a lost or repeated task does no harm.

Defined cases: a null text counts as empty and still gets its end id; a null id comes first; documents that share an id
stand in order of their texts' hashes; very long texts are encoded whole; an empty table gives no files and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.llm.common import WordTable, fresh_path, full_text, keep, lean, partitions, pieces_between, short_batches, totals

BLOCK = 1 << 16
MAGIC = b"TOKBITS1"
#: Magic, bits for an id, ids in a block, documents, ids, blocks.
TAIL = struct.Struct("<8sIIQQQ")
NULL_ID = -(2**63)
END_ID = 2


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]


class TokenWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at, self.waiting, self.n_waiting = out, bits, 0, [], 0
        self.doc_ids, self.sizes, self.offsets = [], [], []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for i in range(0, n, BLOCK):
            data = pack(ids[i : min(n, i + BLOCK)], self.bits)
            self.offsets.append(self.at)
            self.at += self.out.write(data) or len(data)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.n_waiting:
            self._flush(self.n_waiting)
        none = np.zeros(0, np.int64)
        doc_ids, sizes = np.concatenate([none, *self.doc_ids]), np.concatenate([none, *self.sizes])
        n_ids = int(sizes.sum())
        for x in (doc_ids.astype("<i8"), sizes.astype("<i8"), np.array(self.offsets, "<u8")):
            self.out.write(x.tobytes())
        self.out.write(TAIL.pack(MAGIC, self.bits, BLOCK, len(doc_ids), n_ids, len(self.offsets)))
        return len(doc_ids), n_ids


class TokenFile:
    """Random access to a file of ids."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        magic, self.bits, self.block, n_docs, self.n_ids, n_blocks = TAIL.unpack(self._read(end - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        tables = end - TAIL.size - 16 * n_docs - 8 * n_blocks
        self.doc_ids = np.frombuffer(self._read(tables, 8 * n_docs), "<i8")
        self.sizes = np.frombuffer(self._read(tables + 8 * n_docs, 8 * n_docs), "<i8")
        self.offsets = np.frombuffer(self._read(tables + 16 * n_docs, 8 * n_blocks), "<u8").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ends = np.append(self.offsets[1:], tables)

    def _read(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at) if n else b""

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place ``start`` on, reading only their blocks."""
        if not n:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block
        parts = []
        for k in range(a, b + 1):
            there = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(self._read(int(self.offsets[k]), int(self.ends[k] - self.offsets[k])), there, self.bits))
        return np.concatenate(parts)[start - a * self.block :][:n]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.sizes[i]))


class PieceTokenizer:
    """The library's tokenizer over pieces between spaces and newlines, for vocabularies that drop white space: no token
    crosses such a border, so equal pieces are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = WordTable(self._make, np.int32, limit=400_000)

    def _make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(n.sum())), n

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, with the end id after each text, and the number for each."""
        # A point or comma between a letter and a space is a piece of its own in any case, and letters lose their case, so
        # fewer different pieces are left; but special tokens are told by their case.
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        pieces, n = pieces_between(pc.replace_substring_regex(texts, r"([A-Za-z])([.,])( |$)", r"\1 \2\3"), " ")
        pieces = pc.if_else(pc.match_substring(pieces, "<|"), pieces, pc.ascii_lower(pieces))
        ids, per = self.pieces.joined(self.pieces.places_of(pieces))
        n = totals(per, n)
        return np.insert(ids, np.cumsum(n), end_id), n + 1


@lru_cache(2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of ids in ``folder``, documents in ascending order of id; returns the manifest: shard, path, n_docs, n_ids."""
    spark = docs.sparkSession
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        t = tokenizer(path)
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bits"
        first = next(batches, None)
        if first is None:
            return
        with store.open_output_stream(f"{at}/{name}", compression=None) as out:
            w = TokenWriter(out, bits_for(t.vocabulary_size))
            for b in _chain(first, batches):
                w.add(b.column(0).fill_null(NULL_ID).to_numpy(), *t.encode(b.column(1), end_id))
            n_docs, n_ids = w.close()
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), full_text(F.col(text_col)).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text")
    return keep(rows.mapInArrow(lean(run), "shard long, path string, n_docs long, n_ids long"), "token-manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read_tokens(manifest: DataFrame, each: Callable[[np.ndarray], object], schema: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, and ``each`` of the document's ids."""
    spark = manifest.sparkSession
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one line per file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, at = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(at) as source:
                    f = TokenFile(source)
                    for group in _groups(f):
                        a, z = group[0], group[-1] + 1
                        ids = f.ids(int(f.starts[a]), int(f.sizes[a:z].sum()))
                        found = [each(x) for x in np.split(ids, np.cumsum(f.sizes[a:z])[:-1])]
                        doc = f.doc_ids[a:z]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(row["before"] + f.starts[a:z]), pa.array(f.sizes[a:z]), pa.array(found)], ["doc_id", "start", "n_tokens", *names]
                        )

    dealt = placed.repartition(partitions(spark), "shard")
    return dealt.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {schema}")


def _groups(f: TokenFile) -> Iterator[range]:
    """Consecutive documents of some blocks together."""
    a = 0
    while a < len(f.sizes):
        z = max(a + 1, int(np.searchsorted(f.starts, f.starts[a] + 4 * BLOCK)))
        yield range(a, z)
        a = z


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "tokens"))
    return read_tokens(manifest, crc32_of, "ids_crc32 long")
