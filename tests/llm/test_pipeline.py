import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from sonoframe.llm import simhash
from sonoframe.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables = [docs]
    for _, stage in P.STAGES:
        out = stage(spark, tables[-1], SF)
        out.write.parquet(path := fresh_path(spark, "stage"))
        tables.append(spark.read.parquet(path))
    assert all(t.columns == docs.columns for t in tables[:-1])
    good, distinct, apart, mixed, last = tables[1:]
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.98 * sum(labels.values())
    texts = [r.text for r in distinct.collect()]
    assert len(texts) == len(set(texts)) == good.select("text").distinct().count()
    assert {r.doc_id for r in apart.collect()} <= {r.doc_id for r in distinct.collect()}
    uses = [r.doc_id for r in mixed.collect()]
    assert set(uses) <= {r.doc_id for r in apart.collect()} and max(map(uses.count, uses)) <= 2
    assert sorted(r.doc_id for r in last.collect()) == sorted(uses)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_odd_documents(spark, odd, empty):
    """Nulls, empty and very long texts, copies, repeated rows and columns of clashing names, through every stage."""
    docs = odd
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != P.STAGES[-1][0]:
            assert out.columns == odd.columns, name
            assert stage(spark, empty, SF).columns == odd.columns and stage(spark, empty, SF).count() == 0
        else:
            assert out.count() == docs.count() and stage(spark, empty, SF).count() == 0
        out.write.parquet(path := fresh_path(spark, "odd"))
        docs = spark.read.parquet(path)
    by_name = dict(P.STAGES)
    apart = by_name["exact_dedup"](spark, odd, SF)
    texts = [r.text or "" for r in apart.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()})


def shingle_set(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_copies_against_brute_force(spark):
    """All pairs of texts that share 0.8 of their shingles or more, found through their rarest shingles."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    often = Counter(s for x in rows.values() for s in x)
    met = defaultdict(list)
    pairs = []
    for i, x in sorted(rows.items(), key=lambda r: len(r[1])):
        ranked = sorted(x, key=lambda s: (often[s], s))
        seen = set()
        for s in ranked[: len(x) - math.ceil(0.8 * len(x)) + 1]:
            seen.update(met[s])
            met[s].append(i)
        for j in seen:
            both = len(x & rows[j])
            if both >= 0.8 * (len(x) + len(rows[j]) - both):
                pairs.append((i, j))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, simhash.NEAR_BITS, simhash.NEAR_WORDS, simhash.NEAR_SHARE).collect()}
    different = [(i, j) for i, j in pairs if rows[i] != rows[j]]
    assert all(found[i] == found[j] for i, j in pairs if rows[i] == rows[j])
    assert len(different) > 30 and found[3660] == found[3986]
    assert sum(found[i] == found[j] for i, j in different) >= 0.98 * len(different)
    # Nothing else is joined: components are those of the pairs.
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    assert all(root(i) == root(c) for i, c in found.items())
    again = simhash.near_duplicates(docs.repartition(13), 5, simhash.NEAR_BITS, simhash.NEAR_WORDS, simhash.NEAR_SHARE)
    assert {r.doc_id: r.component_id for r in again.collect()} == found
