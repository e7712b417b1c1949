import hashlib
from collections import Counter

from sonoframe.llm import exact_dedup
from sonoframe.llm.common import fresh_path
from sonoframe.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_against_brute_force(spark, odd, odd_rows):
    got = exact_duplicates(odd, DigestIndex(spark, fresh_path(spark, "t"))).collect()
    assert len(got) == len(odd_rows)
    keep, size = {}, Counter()
    for r in odd_rows:
        keep[sha(r[1])] = max(keep.get(sha(r[1]), -1), r[0])
        size[sha(r[1])] += 1
    by_id = {r[0]: sha(r[1]) for r in odd_rows}
    for r in got:
        assert r.text_sha256 == by_id[r.doc_id] and r.keep_id == keep[r.text_sha256] and r.group_size == size[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(keep)  # one row each, repeated rows too


def test_index_persists(spark, odd, odd_rows):
    path = fresh_path(spark, "t")
    half = odd.where("doc_id < 60")
    exact_duplicates(half, DigestIndex(spark, path, buckets=3))
    spark.sql(f"DROP TABLE {DigestIndex(spark, path).name}")  # as in a new session: files stay
    index = DigestIndex(spark, path, buckets=99)
    assert index.buckets == 3
    known = {sha(r[1]) for r in odd_rows if r[0] < 60}
    again = exact_duplicates(odd.where("doc_id >= 60"), index)
    rows = again.collect()
    assert all(not r.kept and r.keep_id < 60 for r in rows if r.text_sha256 in known)
    assert all(r.keep_id >= 60 for r in rows if r.text_sha256 not in known)
    assert index.table().count() == len({sha(r[1]) for r in odd_rows})
    plan = index.table().join(index.table().selectExpr("digest", "1 as x").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the index needs no shuffle
    assert sorted(map(tuple, exact_duplicates(half, DigestIndex(spark, path)).where("kept").collect())) == sorted(
        map(tuple, exact_duplicates(half, DigestIndex(spark, fresh_path(spark, "t"))).where("kept").collect())
    )


def test_drop(spark, odd, odd_rows):
    got = drop_exact_duplicates(odd, DigestIndex(spark, fresh_path(spark, "t")))
    assert got.columns == odd.columns
    assert sorted(sha(r.text) for r in got.collect()) == sorted({sha(r[1]) for r in odd_rows})


def test_empty(spark, empty):
    assert exact_duplicates(empty, DigestIndex(spark, fresh_path(spark, "t"))).count() == 0
    assert drop_exact_duplicates(empty, DigestIndex(spark, fresh_path(spark, "t"))).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (1, "x"), (None, "y")], "doc_id long, text string")
    got = exact_duplicates(df, DigestIndex(spark, fresh_path(spark, "t"))).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in got) == [("1", "1", True), ("None", "1", False), ("None", "1", False), ("None", "None", True)]


def test_many_batches_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 3)
    path = fresh_path(spark, "t")
    known = set()
    for i in range(9):
        index = DigestIndex(spark, path, buckets=2)
        rows = [(10 * i + j, f"text {10 * i + j - j % 3 * 7}") for j in range(10)]
        got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), index).collect()
        assert sum(r.kept for r in got) == len({sha(t) for _, t in rows} - known)
        known |= {sha(t) for _, t in rows}
        assert index.files() <= 8 and index.table().count() == len(known)
    assert index.version > 0 and DigestIndex(spark, path).version == index.version
    index.compact()
    assert index.files() == 2 and index.table().count() == len(known)
