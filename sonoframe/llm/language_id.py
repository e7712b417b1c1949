"""Language identification by word-first backoff.

Each language has log frequencies of its words, and of character n-grams of 5 down to 1 inside words (with word borders).
A known word scores by its own log frequencies. An unseen word falls back to n-grams: the longest length at which the
sample knows any of its n-grams, shorter ones only if none is known. The language with the largest sum wins.

The sample has SAMPLE labelled documents at most, those with the smallest hashes of their rows; where these have more than
MOST_PAIRS different pairs of language and word, half as many are taken until they fit. All words of the sample and all
n-grams of those are kept, by their 64-bit hashes, with numbers only for the languages that have them, in a file of the
shared folder that every worker loads. Texts are scored whole.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without any labelled text every text is;
repeated documents keep their row, and teach once; null ids teach as others do; very long texts are read whole; ties go to
the language that sorts first; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import WordTable, built_file, crc32_of_id, keep, lean, load_arrays, pieces_between, ragged, sampled, short_batches

SAMPLE = 20_000
#: Pairs of language and word that one task and each worker hold at most.
MOST_PAIRS = 4_000_000
LONGEST = 5
#: Added to every count, so that no frequency is zero.
FLOOR = 0.5
#: A text is at most as sure as so many words of its mean evidence.
SURE_WORDS = 40
UNKNOWN = "und"
_PRIME = np.uint64(0x100000001B3)


def core(piece: str) -> str:
    """The piece in lower case without what stands before its first and after its last letter; empty without letters."""
    a, z = 0, len(piece)
    while a < z and not piece[a].isalpha():
        a += 1
    while z > a and not piece[z - 1].isalpha():
        z -= 1
    return piece[a:z].lower()


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return pieces_between(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of the words in their borders, and each one's word."""
    bordered = [f" {w} " for w in words]
    size = np.fromiter(map(len, bordered), np.int64, len(bordered))
    code = np.frombuffer("".join(bordered).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    m = max(0, len(code) - n + 1)
    h = np.full(m, 14695981039346656037, np.uint64)
    for k in range(n):
        h ^= code[k : k + m]
        h *= _PRIME
        h ^= h >> np.uint64(29)
    whole = word[n - 1 :] == word[:m]
    return h[whole], word[:m][whole]


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Frequencies:
    """Log frequencies of keys by language, stored for the languages that have a key; the others have the floor."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, langs: np.ndarray, extra: np.ndarray, floor: np.ndarray):
        self.arrays = {"keys": keys, "ends": ends, "langs": langs, "extra": extra, "floor": floor}
        self.keys, self.ends, self.langs, self.extra, self.floor = keys, ends, langs, extra, floor
        self.begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    @classmethod
    def counted(cls, key: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int) -> Frequencies:
        """From counts n of (key, lang), which may repeat."""
        order = np.lexsort((lang, key))
        key, lang, n = key[order], lang[order], n[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        new = new_key.copy()
        new[1:] |= lang[1:] != lang[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(n, first) if len(first) else n
        lang, keys = lang[first], key[new_key]
        ends = np.append(np.flatnonzero(new_key[first])[1:], len(first)) if len(first) else np.zeros(0, np.int64)
        total = np.bincount(lang, n, languages) + FLOOR * len(keys) + 1
        return cls(keys, ends.astype(np.int64), lang.astype(np.int32), np.log((n + FLOOR) / FLOOR).astype(np.float32), np.log(FLOOR / total).astype(np.float32))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def logs(self, at: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """For n words, the sums over their keys at ``at``, of which ``of`` names the words (n x languages)."""
        wide = len(self.floor)
        size = self.ends[at] - self.begin[at]
        pairs = ragged(self.begin[at], size)
        extra = np.bincount(np.repeat(of, size) * wide + self.langs[pairs], self.extra[pairs], n * wide).reshape(n, wide)
        return extra + np.bincount(of, minlength=n)[:, None] * self.floor.astype(np.float64)


class LanguageModel:
    """Frequencies of words and n-grams. From counts of words by language (words x languages)."""

    def __init__(self, languages: list[str], words: list[str], counts: np.ndarray):
        word, lang = np.nonzero(counts)
        self._count(languages, [words[i] for i in word.tolist()], lang, counts[word, lang])

    def _count(self, languages: list[str], words: list[str], lang: np.ndarray, n: np.ndarray) -> None:
        self.languages = languages
        self.words = Frequencies.counted(hashes(words), lang, n, len(languages))
        self.grams = {}
        for k in range(1, LONGEST + 1):
            h, of = grams(words, k)
            self.grams[k] = Frequencies.counted(h, lang[of], n[of], len(languages))

    @classmethod
    def of_pairs(cls, languages: list[str], words: list[str], lang: np.ndarray, n: np.ndarray) -> LanguageModel:
        """From counts n of pairs of a word and a language."""
        model = cls.__new__(cls)
        model._count(languages, words, lang, n)
        return model

    def arrays(self) -> dict[str, np.ndarray]:
        tables = {0: self.words} | self.grams
        return {"languages": np.array([x.encode() for x in self.languages], object).astype("S"), **{f"{k}_{name}": a for k, t in tables.items() for name, a in t.arrays.items()}}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray]) -> LanguageModel:
        model = cls.__new__(cls)
        model.languages = [x.decode() for x in arrays["languages"].tolist()]
        tables = {k: Frequencies(*[arrays[f"{k}_{name}"] for name in ("keys", "ends", "langs", "extra", "floor")]) for k in range(LONGEST + 1)}
        model.words = tables.pop(0)
        model.grams = tables
        return model

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log frequencies (words x languages)."""
        out = np.zeros((len(words), len(self.languages)))
        place = self.words.find(hashes(words))
        known = np.flatnonzero(place >= 0)
        out[known] = self.words.logs(place[known], np.arange(len(known)), len(known))
        open_ = np.flatnonzero(place < 0)
        # Every length is looked up over the words that no longer one has settled.
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            h, of = grams([words[i] for i in open_.tolist()], n)
            at = self.grams[n].find(h)
            of, at = of[at >= 0], at[at >= 0]
            found = np.bincount(of, minlength=len(open_))
            some = found > 0
            out[open_[some]] = self.grams[n].logs(at, of, len(open_))[some] / found[some, None]
            open_ = open_[~some]
        return out.astype(np.float32)


def loaded(path: str) -> LanguageModel:
    return LanguageModel.of_arrays(load_arrays(path))


class Identifier:
    def __init__(self, model: LanguageModel):
        self.model, self.width = model, len(model.languages) + 1
        self.pieces = WordTable(self._make, np.float32, limit=150_000)

    def _make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [core(p) for p in pieces]
        rows = np.zeros((len(pieces), self.width), np.float32)
        some = [i for i, w in enumerate(words) if w]
        if some:
            rows[some, :-1] = self.model.word_scores([words[i] for i in some])
            rows[some, -1] = 1
        return rows.ravel(), np.full(len(pieces), self.width)

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        pieces, n = pieces_of(texts)
        place = self.pieces.places_of(pieces)
        rows = self.pieces.pool.reshape(-1, self.width)
        doc = np.repeat(np.arange(len(n)), n)
        sums = np.stack([np.bincount(doc, rows[place, j], len(n)) for j in range(self.width)], 1)
        count = sums[:, -1]
        none = (count == 0) | (self.width == 1)
        if self.width == 1:
            return [UNKNOWN] * len(n), np.zeros(len(n))
        best = sums[:, :-1].argmax(1)
        log = sums[:, :-1] / np.maximum(count, 1)[:, None] * np.minimum(count, SURE_WORDS)[:, None]
        p = np.exp(log - log.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True)).max(1)
        names = [UNKNOWN if x else self.model.languages[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
        return names, np.where(none, 0.0, p)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of batches of (text, lang)."""
    for b in batches:
        pieces, n = pieces_of(b.column(0))
        langs = b.column(1).to_pylist()
        total: dict = defaultdict(int)
        per = np.repeat(np.arange(len(n)), n)
        coded = pieces.dictionary_encode()
        words = [core(p) for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        pair, times = np.unique(per * len(words) + coded.indices.to_numpy(), return_counts=True) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for k, c in zip(pair.tolist(), times.tolist(), strict=True):
            if w := words[k % len(words)]:
                total[langs[k // len(words)], w] += c
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> str:
    """Path of the model's file."""
    short_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    while True:
        rows = sampled(known, sample, "language-sample").select("text", "lang")
        counts = keep(rows.mapInArrow(lean(count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
        if counts.count() <= MOST_PAIRS or sample == 1:
            break
        sample //= 2

    def make(table: pa.Table | None) -> dict[str, np.ndarray]:
        if table is None:
            return LanguageModel([], [], np.zeros((0, 0))).arrays()
        coded = table["lang"].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        languages = sorted(names)
        lang = np.array([languages.index(x) for x in names], np.int32)[coded.indices.to_numpy()]
        return LanguageModel.of_pairs(languages, table["word"].to_pylist(), lang, table["n"].to_numpy().astype(np.float32)).arrays()

    return built_file(counts, make, "language-model")


def identify(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; ``model`` is the path that train gives."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Identifier(loaded(model)).judge
        for b in batches:
            names, p = judge(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
