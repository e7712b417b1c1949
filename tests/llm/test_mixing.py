import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sonoframe.llm import mixing
from sonoframe.llm.common import in_order
from sonoframe.llm.mixing import mix, mixed_documents, targets
from tests.llm.conftest import plain


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shares(sizes, weights=(5, 2, 1), share=1.5):
    """Rounds of sharing until no target is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000, None: 5}, {"x": 7}, {"a": 0, "b": 3}, {f"s{i}": (i * 37) % 50 + 1 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def fair_queueing(rows, packet):
    """(id, size, words taken) of each row, by serving packets one after another."""
    size = [len(words(r[1])) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    goal, at, packets = shares(sizes), Counter(), []
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    turn = sorted(range(len(rows)), key=lambda i: (hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), size[i]))
    for _ in range(2):
        for i in turn:
            s = rows[i][3]
            for a in range(0, size[i], packet):
                n = min(packet, size[i] - a)
                at[s] += n
                packets.append((at[s] / goal[s], order.index(s), at[s], n, i))
    left, taken = int(1.5 * sum(sizes.values())), Counter()
    for *_, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return sorted((str(r[0]), size[i], taken[i]) for i, r in enumerate(rows)), goal, sizes


@pytest.mark.parametrize("packet", [256, 20, 10**6])
def test_mix(odd, odd_rows, monkeypatch, packet):
    monkeypatch.setattr(mixing, "PACKET", packet)
    rows = odd_rows + NULL_IDS
    df = odd.select("doc_id", "text", "lang", "source").unionByName(odd.sparkSession.createDataFrame([r[:4] for r in NULL_IDS], "doc_id long, text string, lang string, source string"))
    want, goal, sizes = fair_queueing(rows, packet)
    got = mix(df).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == want
    by_id = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(goal[by_id[r.doc_id]])
        taken[by_id[r.doc_id]] += r.taken
    if packet <= 256:
        assert all(abs(taken[s] - t) <= 2 * packet for s, t in goal.items())
    assert plain(mix(df.repartition(3)), "doc_id", "size", "taken", "finish") == plain(mix(df), "doc_id", "size", "taken", "finish")  # reruns agree
    order = [r.finish for r in got]
    assert order == sorted(order)


NULL_IDS = [(None, "some words without an id " * 9, "en", "b"), (None, "other words without one " * 7, "en", "b"), (None, None, "en", "b")]


def test_documents(odd, odd_rows):
    out = mixed_documents(odd)
    assert out.columns == odd.columns
    given = Counter()
    first = defaultdict(set)
    for r in odd_rows:
        first[r[0]].add(r[1] or "")
    for r in out.collect():
        given[r.doc_id] += len(words(r.text))
        assert any(t.startswith(r.text) for t in first[r.doc_id])
    plan = Counter()
    for r in mix(odd).collect():
        plan[r.doc_id] += r.taken
    assert +given == +plan
    assert plain(out, *odd.columns) == plain(mixed_documents(odd.repartition(2)), *odd.columns)


def test_equal_rows_at_the_cut(spark):
    """Rows that repeat an id and its text, more than fit."""
    rows = [(7, "a b c d e f g", "s")] * 50 + [(None, "x y z", "s")] * 40 + [(3, "q " * 40, "t")] * 3 + [(9, "u v", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan, given = mix(df).collect(), mixed_documents(df).collect()
    for i in (7, None, 3, 9):
        assert sum(r.taken for r in plan if r.doc_id == i) == sum(len(words(r.text)) for r in given if r.doc_id == i)
    assert max(r.taken / r.size for r in plan) <= 2 and sum(r.taken for r in plan) == int(1.5 * sum(len(words(r[1])) for r in rows))


def test_a_hot_source_is_spread(spark):
    """No task holds a source or the rows of one id."""
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 1, id) AS doc_id", "'some words of a text' AS text", "if(id % 4 = 0, 'b', 'a') AS source").repartition(8)
    rows = df.selectExpr("doc_id", "source", "CAST(size(split(text, ' ')) AS long) AS size", "monotonically_increasing_id() AS row_id").cache()
    monkeyed = in_order(rows, [rows.source.asc(), rows.doc_id.asc(), rows.row_id.asc()], {"size": "upto"}, "t", 10**7)
    assert sorted(r.upto for r in monkeyed.collect()) == list(range(5, 20001, 5))
    assert sum(r.taken for r in mix(df).collect()) == 30000


def test_empty(empty):
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
