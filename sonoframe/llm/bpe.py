"""Byte-level BPE, encoding and decoding, by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair in the sorted array of mergeable
pair keys by binary search, finds each word's lowest rank, merges that pair wherever it stands in the word from left to
right, and closes the gaps; words without a mergeable pair drop out. The vocabulary file's path is a parameter.

Texts are first cut where no token can cross: at a single space or newline between other characters. Equal pieces are
worked out once per worker. Texts with runs of white space, or with the strings of special tokens, take the plain way
over the same split pattern.

Defined cases: a null text counts as empty; an empty text has no tokens; repeated rows each keep their row; very long
texts are encoded whole; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import WordTable, lean, pieces_between, ragged, short_batches, totals

#: The split pattern of the byte-level pre-tokenizer, and the bytes that stand for themselves in its alphabet.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Ids of one document are decoded in pieces of so many.
PIECE = 1 << 20


class BytePairCoder:
    """Encodes and decodes as the file's tokenizer does without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        letters = {chr(b): b for b in PRINTABLE}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(map(letters.__getitem__, token))
        for t in added:
            spelled[t["id"]] = t["content"].encode()
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab.get(c, 0)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.never = len(merges)
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.fromiter(map(len, spelled), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.split = regex.compile(SPLIT)
        self.special = {t["content"]: t["id"] for t in added}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # White space in the widest sense: more hard texts do no harm.
        self.hard = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2}" + "".join("|" + re.escape(s) for s in self.special)
        self.words = WordTable(self.encode_words, np.int32)
        self.pieces = WordTable(self._encode_pieces, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search over the sorted pair keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.never)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, by merge rounds over all of them at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.cumsum(size) - size
        word = np.flatnonzero(size)
        begin, size = begin[word], size[word]
        rank = self.ranks(ids, np.append(ids[1:], 0))
        rank[begin + size - 1] = self.never  # the last symbol of a word has no partner
        done_ids, done_words = [], []
        while len(ids):
            lowest = np.minimum.reduceat(rank, begin)
            over = lowest == self.never
            if over.any():
                gone = np.repeat(over, size)
                done_ids.append(ids[gone])
                done_words.append(np.repeat(word[over], size[over]))
                ids, rank, word, size, lowest = ids[~gone], rank[~gone], word[~over], size[~over], lowest[~over]
                begin = np.cumsum(size) - size
                if not len(ids):
                    break
            # A pair that overlaps a merged one to its left must wait: in a run of hits every other one merges.
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            run = np.concatenate([[True], np.diff(hit) > 1])
            if not run.all():
                nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[nth % 2 == 0]
            ids[hit] = self.result[rank[hit]]
            last = np.zeros(len(ids), bool)
            last[begin + size - 1] = True
            ended = last[hit + 1]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            where = np.cumsum(stays) - 1
            size = size - np.diff(np.append(np.searchsorted(hit, begin), len(hit)))
            begin = np.cumsum(size) - size
            ids, rank, hit = ids[stays], rank[stays], where[hit]
            # Only the pairs beside a merge have changed.
            open_hit = hit[~ended]
            rank[hit[ended]] = self.never
            rank[open_hit] = self.ranks(ids[open_hit], ids[open_hit + 1])
            first = np.zeros(len(ids), bool)
            first[begin] = True
            before = hit[~first[hit]] - 1
            rank[before] = self.ranks(ids[before], ids[before + 1])
        all_ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        all_words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        all_ids = all_ids[np.argsort(all_words, kind="stable")].astype(np.int32)
        return all_ids, np.bincount(all_words, minlength=len(raw))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces start with a newline, or else follow a space."""
        tokens = [self.split.findall(p if p[:1] == "\n" else " " + p) for p in pieces]
        ids, n = self.words.joined(self.words.places(list(chain.from_iterable(tokens))))
        return ids, totals(n, np.fromiter(map(len, tokens), np.int64, len(tokens)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each."""
        texts = pc.fill_null(texts, "")
        led = pc.binary_join_element_wise("\n", texts, "")
        hard = pc.match_substring_regex(led, self.hard).to_numpy(zero_copy_only=False)
        led = pc.if_else(pa.array(hard), "\n", led)
        # Pieces start with their newline, or else follow a space; what comes before the first newline is empty.
        pieces, n = pieces_between(pc.replace_substring(led, "\n", " \n"), " ")
        there = np.ones(len(pieces), bool)
        there[np.cumsum(n) - n] = False
        ids, per = self.pieces.joined(self.pieces.places_of(pieces.filter(pa.array(there))))
        n = totals(per, n - 1)
        # The newline put before each text is its first token.
        there = np.ones(len(ids), bool)
        there[np.cumsum(n) - n] = False
        ids, n = ids[there], n - 1
        if hard.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(hard).tolist():
                parts[i] = self.encode_plainly(texts[i].as_py())
            ids, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, n

    def encode_plainly(self, text: str) -> np.ndarray:
        parts = self.special_split.split(text) if self.special_split else [text]
        out = [np.zeros(0, np.int32)]
        for p in parts:
            if p in self.special:
                out.append(np.array([self.special[p]], np.int32))
            elif p:
                out.append(self.words.joined(self.words.places(self.split.findall(p)))[0])
        return np.concatenate(out)

    def clear(self) -> None:
        self.words.clear()
        self.pieces.clear()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        parts = [ids[i : i + PIECE] for i in range(0, len(ids), PIECE)]
        return b"".join(self.bytes[ragged(self.start[p], self.length[p])].tobytes() for p in parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its token ids."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = coder(path).encode(b.column(1))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])
        coder(path).clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its token ids."""
    short_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [coder(path).decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (unsigned 32 bit, little-endian) and of the text decoded from them."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = coder(path)
            ids, n = c.encode(b.column(1))
            ends = np.cumsum(n)
            words = memoryview(ids.astype("<u4").tobytes())
            of_ids, of_text = [], []
            for to, k in zip(ends.tolist(), n.tolist(), strict=True):
                of_ids.append(hashlib.sha256(words[4 * (to - k) : 4 * to]).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids[to - k : to]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder(path).clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
