import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sonoframe.llm import simhash
from sonoframe.llm.components import connected_components


def brute(rows, k=4, most=4):
    fps, ids = [], [r[0] for r in rows]
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
        count = [0] * 64
        for s in sh:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                count[b] += h >> b & 1
        fps.append(sum(1 << b for b in range(64) if 2 * count[b] > len(sh)))
    f, comp = np.array(fps, np.uint64), np.array(ids)
    near = [np.flatnonzero(np.bitwise_count(x ^ f) <= most) for x in f]
    while True:
        new = np.array([comp[n].min() for n in near])
        if (new == comp).all():
            return fps, comp
        comp = new


def test_against_brute_force(spark, odd, odd_rows):
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 100_000]
    fps, comp = brute(rows)
    want = sorted((r[0], f"{f:016x}", int(c)) for r, f, c in zip(rows, fps, comp, strict=True))
    got = simhash.near_duplicates(odd.where("text IS NULL OR length(text) < 100000"), 4, 4).collect()
    assert sorted((r.doc_id, r.fp.hex(), r.component_id) for r in got) == want


def test_large_blocks_are_tiled(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.unique([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in center for a, b in rng.integers(0, 64, (60, 2))] + list(rng.integers(0, 2**64, 300, dtype=np.uint64)))
    df = spark.createDataFrame([(i, bytearray(int(x).to_bytes(8, "big"))) for i, x in enumerate(fps)], "node long, fp binary")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    comp = np.arange(len(fps))
    while (new := np.array([comp[n].min() for n in near])).tolist() != comp.tolist():
        comp = new
    for tile in (4096, 16):
        monkeypatch.setattr(simhash, "TILE", tile)
        links = simhash.block_links(spark, df, simhash.exact_parts(len(fps), 64, 4), 1, 4)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert all(found.get(i, i) == c for i, c in enumerate(comp.tolist()))


def test_every_plan_finds_all_links():
    rng = random.Random(1)
    for n in (10, 10**7, 10**9, 10**11):
        parts = simhash.exact_parts(n, 64, 4)
        for _ in range(300):
            differ = set(rng.sample(range(64), 4))
            assert any(not differ & set(p) for p in parts)


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, (3000, 1), dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    t, u = simhash.pivot_table(a, 1), simhash.pivot_table(b, 1)
    assert (np.abs(t - u).max(1) <= 4).all()
    find = simhash.Links(np.concatenate([a, rng.integers(0, 2**64, (3000, 1), dtype=np.uint64)]), 4)
    find.pairs_across(np.arange(3000), np.arange(3000, 6000))
    assert find.passed < 1e-3 * find.seen


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(200, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_near_copies(spark):
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, groups = [], {}
    for g in range(40):
        w = say(400)
        for c in range(3):
            v = list(w)
            for _ in range(4 * c):
                v[rng.randrange(400)] = say(1)[0]
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(v)))
    alone = [(len(rows) + i, " ".join(say(300))) for i in range(40)]
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows + alone, "doc_id long, text string")).collect()}
    assert {i for i, _ in alone} <= got  # clean documents stay
    sets = [{tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if groups[i] == groups[j] and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]):
                assert not (i in got and j in got)
            if i not in got and groups[i] == groups[j] and j == 3 * groups[i]:
                assert len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])


def test_empty_and_odd(spark, empty, odd):
    assert simhash.near_duplicates(empty, 4, 4).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns
    nulls = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (None, "zz")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(nulls, 4, 4).collect()) == ["2", "2", "None"]
    assert simhash.drop_near_duplicates(nulls).count() == 3  # a null id names nothing to drop


def test_a_chain_through_a_null_id(spark, monkeypatch):
    """Fingerprints of 0, 4 and 8 bits, the middle one only a null id's, join the other two."""
    bits = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 2**63 - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a, **k: docs.sparkSession.createDataFrame([(i, bytearray(bits[t].to_bytes(8, "big")), bytearray(bits[t].to_bytes(8, "big"))) for i, t in docs.collect()], "doc_id long, fp binary, same binary"))
    df = spark.createDataFrame([(7, "a"), (None, "b"), (9, "c"), (None, "d"), (4, "c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df, 4, 4).collect())
    assert got == [("4", "4"), ("7", "4"), ("9", "4"), ("None", "4"), ("None", "None")]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def star(rng, center, leaves):
    """A text, and copies of it with five-word shingles lost in distant places: similar to it, but not to each other."""
    w = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(center, " ".join(w))]
    for i in range(leaves):
        v = list(w)
        for at in rng.sample(range(0, 400, 10), 8):
            v[at + 5] = f"new{rng.randrange(10**6)}"
        rows.append((center + 1 + i, " ".join(v)))
    return rows


def test_a_failed_link_hides_no_other(spark, monkeypatch):
    rng = random.Random(3)
    rows = star(rng, 0, 120) + star(rng, 1000, 60)
    for i, t in rows:
        if i % 1000:
            assert 0.8 <= jaccard(t, rows[0 if i < 1000 else 121][1]) <= 0.85
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    # A forest of candidates of which no link holds: a chain of leaves, with the center at its end by way of another star.
    chain = [*range(1, 121), *range(1001, 1061), 0, 1000]
    a, b = chain[:-1], chain[1:]
    for grams in (1 << 19, 8000):
        monkeypatch.setattr(simhash, "TILE_GRAMS", grams)
        links = simhash.similar_links(texts, spark.createDataFrame(list(zip(a, b, strict=True)), "a long, b long"), 5, 0.8)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert found == {i: 0 if i < 1000 else 1000 for i, _ in rows}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(texts).collect()) == [0, 1000]


def keys_of(hashes):
    return simhash.band_keys(simhash.least_hashes(hashes)[None])[0]


def test_recall():
    """Pairs just above 0.8, whatever the number of texts; unlike texts hardly meet."""
    assert simhash.recall_of(256, 0.8, simhash.NEAR_BITS) >= 0.99
    rng = random.Random(6)
    met, strangers = 0, []
    for _ in range(600):
        w = [f"w{rng.randrange(10**7)}" for _ in range(400)]
        v = [f"x{rng.randrange(10**7)}" for _ in range(3)] + w[3:]
        for at in rng.sample(range(10, 390, 10), 8):
            v[at] = f"y{rng.randrange(10**7)}"
        assert 0.8 <= jaccard(" ".join(w), " ".join(v)) <= 0.85
        h = [np.unique(simhash.shingle_hashes(" ".join(t).encode(), 5)) for t in (w, v)]
        fps = [np.frombuffer(simhash.majority(x, 4), np.uint8) for x in h]
        keys = [keys_of(x) for x in h]
        met += bool((keys[0] == keys[1]).any()) and np.bitwise_count(fps[0] ^ fps[1]).sum() <= simhash.NEAR_BITS
        strangers.append(keys[0])
    assert met >= 0.985 * 600
    assert len({k for x in strangers for k in x.tolist()}) == 600 * simhash.BANDS


def test_blocks_of_long_and_short_texts():
    h = np.random.default_rng(1).integers(0, 2**64, 10_000, dtype=np.uint64)
    whole = keys_of(h)
    assert (keys_of(h[::-1].copy()) == whole).all() and len(keys_of(h[:0])) == len(keys_of(h[:1])) == simhash.BANDS
    agree = np.mean([(keys_of(np.concatenate([h[:800], x])) == keys_of(h[:800])).mean() for x in np.random.default_rng(2).integers(0, 2**64, (60, 200), dtype=np.uint64)])
    assert abs(agree - 0.8**5) < 0.06  # as often as the similarity, 0.8, gives


def test_repeats_move_no_wide_fingerprint(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    once, often = " ".join(w[:30] * 2 + w[30:]), " ".join(w[:30] * 20 + w[30:])
    bits = [np.frombuffer(simhash.fingerprint(t.encode(), 5, 4), np.uint8) for t in (once, often)]
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() > simhash.NEAR_BITS  # all shingles, repeats too, lead too far apart
    assert jaccard(once, often) == 1
    df = spark.createDataFrame([(1, once), (2, often)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [1]


def test_equal_fingerprints_are_checked(spark, monkeypatch):
    rng = random.Random(10)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, "same " * 404 + say(300)) for i in range(4)] + [(9, say(300))]
    assert max(jaccard(rows[0][1], t) for _, t in rows[1:]) < 0.1
    df = spark.createDataFrame([*rows, (10, rows[0][1])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [0, 1, 2, 3, 9]
    # Texts of one fingerprint, as any two sets of shingles may be.
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a, **k: FINGERPRINTS(docs, *a, **k).withColumn("fp", F.lit(bytearray(32))))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [0, 1, 2, 3, 9]


FINGERPRINTS = simhash.fingerprints
