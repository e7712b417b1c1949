import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import language_id as L
from sonoframe.llm import quality_classifier as Q
from sonoframe.llm.common import sampled


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, "abcdefgh" if i % 2 else "mnopqrst", rng.randint(20, 120))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "xx" if i % 2 else "yy"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(spark, corpus, odd, empty):
    docs, labels = corpus
    model = Q.train(docs, Q.taught(labels))
    held = Q.score(docs, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).join(labels, "doc_id").collect()
    assert len(held) > 60 and sum((r.score >= 0.3) == (r.quality == 1) for r in held) >= 0.97 * len(held)
    again = Q.score(docs.repartition(2), Q.train(docs.repartition(3), Q.taught(labels))).collect()
    first = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert all(abs(first[r.doc_id] - r.score) < 1e-3 for r in again)
    got = Q.score(odd, model, carry=tuple(odd.columns), name="sure").collect()
    assert len(got) == odd.count() and all(0 <= r.sure <= 1 for r in got)
    assert Q.score(empty, model).count() == 0
    kept = Q.good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.sure >= Q.THRESHOLD for r in got)
    assert Q.good(empty, model).count() == 0
    repeated = labels.unionByName(labels)
    assert Q.score(docs, Q.train(docs.unionByName(docs.limit(50)), Q.taught(repeated))).count() == docs.count()


def test_quality_without_labels(corpus, odd, spark):
    docs, labels = corpus
    none = labels.where("false")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    ones = labels.where("quality = 1").limit(20).unionByName(spark.createDataFrame([(5, None), (None, 1), (10**9, 0)], "doc_id long, quality int"))
    assert {r.score for r in Q.score(docs, Q.train(docs, ones)).collect()} == {1.0}


def test_language(corpus, odd, odd_rows, empty):
    docs, _ = corpus
    model = L.train(docs.where("doc_id % 3 <> 0"))
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    text = {r[0]: r[1] for r in odd_rows}
    rows = L.identify(odd, model).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        no_letters = not any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == no_letters and 0 <= r.score <= 1
    assert L.identify(empty, model).count() == 0
    nothing = L.train(docs.where("false"))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_all_words_are_kept(spark, corpus):
    """The file against counts of the whole sample, word by word and n-gram by n-gram."""
    docs, _ = corpus
    taught = docs.where("doc_id % 3 <> 0").limit(200)
    model = L.loaded(L.train(taught))
    rows, gram = Counter(), Counter()
    for r in taught.collect():
        for p in re.split("[ \n]", r.text):
            if w := L.core(p):
                rows[w, r.lang] += 1
    words = sorted({w for w, _ in rows})
    for (w, lang), n in rows.items():
        b = f" {w} "
        for k in range(1, 6):
            for i in range(len(b) - k + 1):
                gram[k, b[i : i + k], lang] += n
    assert len(model.words.keys) == len(words)
    total = {x: sum(n for (_, lang), n in rows.items() if lang == x) + L.FLOOR * len(words) + 1 for x in ("xx", "yy")}
    got = model.word_scores(words)
    for w, s in zip(words, got, strict=True):
        assert s == pytest.approx([np.log((rows[w, x] + L.FLOOR) / total[x]) for x in ("xx", "yy")], abs=1e-4)
    unseen = ["".join(random.Random(i).choice("abcdmnop") for _ in range(7)) for i in range(50)]
    unseen = [w for w in unseen if w not in set(words)]
    for w, s in zip(unseen, model.word_scores(unseen), strict=True):
        b = f" {w} "
        for k in range(5, 0, -1):
            found = [b[i : i + k] for i in range(len(b) - k + 1) if gram[k, b[i : i + k], "xx"] + gram[k, b[i : i + k], "yy"]]
            if found:
                break
        size = len({g for kk, g, _ in gram if kk == k})
        for j, x in enumerate(("xx", "yy")):
            whole = sum(n for (kk, _, lang), n in gram.items() if kk == k and lang == x) + L.FLOOR * size + 1
            assert s[j] == pytest.approx(np.mean([np.log((gram[k, g, x] + L.FLOOR) / whole) for g in found]), abs=1e-4)


def test_word_vectors_against_brute_force(corpus):
    docs, labels = corpus
    path, _ = Q.train(docs, labels)
    known, context = Q.word_vectors(path)
    sums = defaultdict(lambda: np.zeros(Q.DIM))
    for r in docs.collect():
        w = r.text.split(" ")
        v = Q.index_vectors(w)
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    sums[w[i]] += v[j]
    assert len(known) == len(sums)
    for w, v in sums.items():
        at = int(np.searchsorted(known, Q.hashes([w])[0]))
        assert context[at] == pytest.approx(v / max(np.linalg.norm(v), 1e-6), abs=1e-3)  # half precision


def test_small_samples_are_bounded(spark, corpus, monkeypatch):
    """Where a sample has too many words, a smaller one is taken; ids that all rows share don't make it larger."""
    docs, labels = corpus
    monkeypatch.setattr(L, "MOST_PAIRS", 2000)
    monkeypatch.setattr(Q, "MOST_WORDS", 2000)
    assert 0 < len(L.loaded(L.train(docs)).words.keys) <= 2000
    path, _ = Q.train(docs, labels)
    assert 0 < len(Q.word_vectors(path)[0]) <= 2000
    hot = docs.withColumn("doc_id", F.lit(1).cast("long"))
    assert sampled(hot, 40, "t").count() == 40
    assert L.identify(docs, L.train(hot, sample=50)).count() == docs.count()


def test_ties_go_to_the_first_language():
    m = L.LanguageModel(["x", "y"], ["ab"], np.array([[2.0, 2.0]]))
    assert L.Identifier(m).judge(pa.array(["ab ab", "", None, "12 --"])) == (["x", "und", "und", "und"], pytest.approx([0.5, 0, 0, 0]))


def test_backoff():
    m = L.LanguageModel(["x", "y"], ["abcde", "abcxy", "zzzzz"], np.array([[5.0, 0], [3, 0], [0, 9]]))
    s = m.word_scores(["abcde", "abcde1", "zzz", "q"])
    assert s[0, 0] == pytest.approx(np.log((5 + L.FLOOR) / (8 + L.FLOOR * 3 + 1)))  # known: its own frequency
    assert s[1, 0] > s[1, 1] and s[2, 1] > s[2, 0] and abs(s[3, 0] - s[3, 1]) < 0.1
