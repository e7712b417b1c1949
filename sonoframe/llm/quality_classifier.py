"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a random index vector (sparse, of +1 and -1, drawn from its hash). A word's vector is its own index vector
plus the sum of those of its neighbours in the training sample, scaled to length one; words that the sample lacks have
their own index vector only. Shapes of words (letters as a or A, digits as 0, marks as they are) are indexed likewise,
and three more words stand for repetition and layout: one for each word that repeats the word before it, one for each word
triple that stands earlier in the text, one for each line begun; the last number is the length. A document is the mean of
its words' vectors. The network is trained by Adam on
the driver over one short vector per sampled document; its temperature is fitted on rows that it was not trained on.

The sample has SAMPLE labelled rows at most, those with the smallest hashes; where these have more than MOST_WORDS different
words, half as many are taken until they fit. All words of the sample have context vectors, found by the words' hashes in a
file of the shared folder that every worker loads. Texts are scored whole.

Defined cases: a null or empty text has the vector zero and still gets a score; null labels and labels without a document
teach nothing; label rows and documents that are repeated teach once, and such documents keep their rows; equal hashes of
sampled rows are one row's; very long texts are read whole; without both classes in the sample the score is the share of class 1 (0.5
without labels); an empty table gives an empty result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import WordTable, built_file, crc32_of_id, full_text, keep, lean, load_arrays, packed, pieces_between, sampled, short_batches

#: At most so many labelled rows are learned from.
SAMPLE = 8000
#: Different words that one task and each worker hold at most.
MOST_WORDS = 4_000_000
DIM = 32
NONZERO = 6
SHAPES = 512
WINDOW = 2
HIDDEN = 32
#: Passes over the sample, and gradient steps at least, for small samples.
EPOCHS = 150
LEAST_STEPS = 3000
THRESHOLD = 0.3
SEED = 7
_RUNS = [(re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0")]


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def index_vectors(words: list[str], dim: int = DIM) -> np.ndarray:
    return vectors_of(hashes(words), dim)


def vectors_of(h: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Sparse ternary vectors drawn from the words' hashes."""
    out = np.zeros((len(h), dim), np.float32)
    at = np.arange(len(h))
    for k in range(NONZERO):
        part = (h >> np.uint64(10 * k)) & np.uint64(1023)
        out[at, (part >> np.uint64(1)) % np.uint64(dim)] += np.where(part & np.uint64(1), 1, -1).astype(np.float32)
    return out


def shape(word: str) -> str:
    """Runs of letters as a, A or Aa, digits as 0; marks as they are, at most two in a row."""
    word = _RUNS[0][0].sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() else "Aa", word)
    return re.sub(r"(\W)\1+", r"\1\1", _RUNS[1][0].sub("0", word))[:12]


class Featurizer:
    """Vectors of documents; ``known`` are the sorted hashes of known words, ``context`` their vectors."""

    def __init__(self, known: np.ndarray, context: np.ndarray):
        self.known, self.context = known, context
        self.shape_rows = index_vectors([f"\0shape{i}" for i in range(SHAPES)])
        self.words = WordTable(self._make, np.float32, limit=100_000)

    def _make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.zeros((len(words), DIM + 1), np.float32)
        h = hashes(words)
        rows[:, :DIM] = vectors_of(h)
        rows[:, DIM] = (hashes([shape(w) for w in words]) % np.uint64(SHAPES)).astype(np.float32)
        if len(self.known):
            of = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[of] == h
            rows[hit, :DIM] += self.context[of[hit]].astype(np.float32) * np.float32(NONZERO**0.5)
        return rows.ravel(), np.full(len(words), DIM + 1)

    def vectors(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        # A newline stays at the head of the word after it.
        pieces, n = pieces_between(pc.replace_substring(texts, "\n", " \n"), " ")
        lines = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        place = self.words.places_of(pc.utf8_ltrim(pieces, "\n"))
        return self._pooled(place, lines, n)

    def _pooled(self, place: np.ndarray, lines: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows = self.words.pool.reshape(-1, DIM + 1)
        doc = np.repeat(np.arange(len(n)), n)
        out = np.zeros((len(n), 2 * DIM + 4), np.float32)
        filled = np.flatnonzero(n)
        step = 1 << 16  # words at once
        for a in range(0, len(place), step):
            part = rows[place[a : a + step]]
            here = doc[a : a + step]
            begin = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            out[here[begin], :DIM] += np.add.reduceat(part[:, :DIM], begin, axis=0)
            kinds, inverse = np.unique(part[:, DIM].astype(np.int64), return_inverse=True)
            counts = np.bincount((here - here[0]) * len(kinds) + inverse, minlength=(here[-1] - here[0] + 1) * len(kinds)).reshape(-1, len(kinds))
            out[here[0] : here[-1] + 1, DIM : 2 * DIM] += counts.astype(np.float32) @ self.shape_rows[kinds]
        again = np.zeros(len(place), bool)
        again[1:] = (place[1:] == place[:-1]) & (doc[1:] == doc[:-1])
        mixed = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        triple = mixed[:-2] + mixed[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[2:] * np.uint64(0x94D049BB133111EB) if len(place) > 2 else mixed[:0]
        same = doc[2:] == doc[:-2]
        triple = (triple ^ (doc[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[same]
        _, at = np.unique(triple, return_index=True)
        earlier = np.ones(len(triple), bool)
        earlier[at] = False
        size = np.maximum(n, 1)
        out[:, : 2 * DIM] /= size[:, None]
        out[:, 2 * DIM] = np.bincount(doc[again], minlength=len(n)) / size
        out[:, 2 * DIM + 1] = np.bincount(doc[2:][same][earlier], minlength=len(n)) / size
        out[:, 2 * DIM + 2] = np.bincount(doc[lines], minlength=len(n)) / size
        out[filled, 2 * DIM + 3] = np.log1p(n[filled]) / 10
        return out


class Network:
    """Two layers over standardised vectors; sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        held, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[fit].mean(0), 1 / (x[fit].std(0) + 1e-3)
        z = (x - self.mean) * self.scale
        d = x.shape[1]
        p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(max(EPOCHS, LEAST_STEPS // (len(fit) // 128 + 1))):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                rows = fit[i : i + 128]
                a, target = z[rows], y[rows]
                h = np.maximum(a @ p[0] + p[1], 0)
                g = (_sigmoid(h @ p[2] + p[3]) - target) / len(rows)
                gh = np.outer(g, p[2]) * (h > 0)
                grads = [a.T @ gh + 1e-3 * p[0], gh.sum(0), h.T @ g + 1e-3 * p[2], g.sum(keepdims=True)]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.layers = p
        logits = self._logits(x[held])
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / c).mean() for c in grid] if len(held) else [0]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) * self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self._logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pieces, n = pieces_between(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    return pieces.to_numpy(zero_copy_only=False), n


def word_vectors(path: str) -> tuple[np.ndarray, np.ndarray]:
    found = load_arrays(path)
    return found["known"], found["context"]


CONTEXT = [f"c{i}" for i in range(DIM)]


def sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c0, c1, ...): the hashes of a partition's words and the sums of their neighbours' index vectors, which are whole
    numbers, so that no order of adding changes them."""
    number: dict[str, int] = {}
    sums = np.zeros((1 << 14, DIM), np.int32)
    for b in batches:
        words, n = _words_of(b.column(0))
        coded = pa.array(words, pa.string()).dictionary_encode()
        mine = coded.dictionary.to_pylist()
        for w in mine:
            if w:
                number.setdefault(w, len(number))
        while len(number) > len(sums):
            sums = np.concatenate([sums, np.zeros_like(sums)])
        index = index_vectors(mine).astype(np.int32)
        place = coded.indices.to_numpy()
        row = np.array([number.get(w, -1) for w in mine], np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        for k in range(1, WINDOW + 1):
            near = np.flatnonzero((doc[k:] == doc[:-k]) & (row[place[k:]] >= 0) & (row[place[:-k]] >= 0)) if len(doc) > k else np.zeros(0, np.int64)
            for i in range(0, len(near), 1 << 16):
                a, z = place[near[i : i + (1 << 16)]], place[near[i : i + (1 << 16)] + k]
                for one, other in ((a, z), (z, a)):
                    order = np.argsort(row[one], kind="stable")
                    begin = np.flatnonzero(np.diff(row[one][order], prepend=-1))
                    sums[row[one][order][begin]] += np.add.reduceat(index[other[order]], begin, axis=0)
    keys = hashes(list(number)).view(np.int64)
    for i in range(0, len(keys), 1 << 14):
        part = sums[i : min(len(keys), i + (1 << 14))]
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 14)]), *[pa.array(part[:, k].copy()) for k in range(DIM)]], ["word", *CONTEXT])


def make_vectors(table: pa.Table | None) -> dict[str, np.ndarray]:
    if table is None:
        return {"known": np.zeros(0, np.uint64), "context": np.zeros((0, DIM), np.float16)}
    known = table["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    context = np.empty((len(known), DIM), np.float32)
    for k, c in enumerate(CONTEXT):  # column by column, which bounds memory
        context[:, k] = table[c].to_numpy()[order]
    context /= np.maximum(np.sqrt(np.einsum("ij,ij->i", context, context)), 1e-6)[:, None]
    return {"known": known[order], "context": context.astype(np.float16)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[str, Network]:
    """The path of the word vectors' file, and the network. ``labels`` has doc_id and quality."""
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("y IS NOT NULL AND id IS NOT NULL")
    texts = docs.select(F.col(id_col).alias("id"), full_text(F.col(text_col)).alias("text"))
    while True:
        some = known.distinct().orderBy(F.xxhash64("id", "y"), "id", "y").limit(sample)
        # Ids that many rows share are sampled again.
        rows = sampled(texts.join(F.broadcast(some), "id").select("id", "y", "text"), sample, "labelled").coalesce(8)
        sums = rows.select("text").mapInArrow(lean(sum_contexts), "word long, " + ", ".join(f"{c} int" for c in CONTEXT))
        sums = keep(sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in CONTEXT]), "word-contexts")
        if sums.count() <= MOST_WORDS or sample == 1:
            break
        sample //= 2
    path = built_file(sums, make_vectors, "word-vectors")
    found = featurize(rows.select("text", "y", F.xxhash64("id", "y", "text").alias("key")), path, ["y", "key"]).orderBy("key").toPandas()
    x = np.array(found["vector"].tolist(), np.float64).reshape(len(found), 2 * DIM + 4)
    return path, Network(x, found["y"].to_numpy(np.float64))


def featurize(rows: DataFrame, path: str, others: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(*word_vectors(path))
        for b in batches:
            x = f.vectors(b.column(0))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *b.columns[1:]], ["vector", *others])

    kinds = dict(rows.dtypes)
    return rows.select("text", *others).mapInArrow(lean(run), "vector array<float>, " + ", ".join(f"{c} {kinds[c]}" for c in others))


def scored(docs: DataFrame, model: tuple[str, Network], text_col: str = "text") -> DataFrame:
    """``row``, a struct of the columns of docs, and ``score``, that of each whole text."""
    short_batches(docs.sparkSession)
    path, network = model
    rows = packed(docs)
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(*word_vectors(path))
        for b in batches:
            p = network.scores(f.vectors(b.column(0).field(text_col)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["row", "score"])

    return rows.mapInArrow(lean(run), schema)


def score(docs: DataFrame, model: tuple[str, Network], text_col: str = "text", carry: tuple = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``carry`` and the score of each whole text."""
    found = scored(docs.select(*dict.fromkeys([*carry, text_col])), model, text_col)
    return found.select(*[F.col("row")[c].alias(c) for c in carry], F.col("score").alias(name))


def good(docs: DataFrame, model: tuple[str, Network], text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The documents with that score at least, with the columns they came with."""
    return scored(docs, model, text_col).where(F.col("score") >= least).select("row.*")


def taught(labels: DataFrame) -> DataFrame:
    """The label rows that may be learned from."""
    return labels.where(crc32_of_id(F.col("doc_id")) % 5 != 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, taught(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select(
        "doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
