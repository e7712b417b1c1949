import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import bits as B
from sonoframe.functions import scalar as S
from sonoframe.operators import gains as G
from sonoframe.operators.syntax import BitCounter, BitReader, BitWriter, MergingWriter


def plan(window, previous=None):
    peaks, before = G.peaks_of(window[None].astype(np.float32))
    return G.planned(peaks[0].tolist(), float(before[0]), previous or G.Record())


def test_an_attack():
    x = np.zeros(768)
    x[256:264], x[264:] = 1, 64
    assert plan(x) == G.Record([(0, 8)], 64.0)


def test_silence_and_steady_sound():
    x = np.zeros(768)
    x[256:512] = 1
    assert plan(x) == G.Record([], 1.0)
    assert plan(np.full(768, 500.0), G.Record([], 500.0)).points == []


def test_a_release_after_an_attack():
    x = np.full(768, 2.0)
    x[300:400] = 3000
    got = plan(x)
    assert got.points and all(0 <= a <= 31 and 0 <= v <= 15 for a, v in got.points)
    assert [a for a, _ in got.points] == sorted({a for a, _ in got.points})
    assert got.points[-1][1] < 4 < got.points[0][1]  # up before the attack, down after it


def test_limits():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.normal(0, 1, 768) * 10 ** rng.uniform(0, 5, 96).repeat(8)
        got = plan(x, G.Record([(3, 9), (9, 4)], 100.0))
        assert got is None or (len(got.points) <= 7 and all(0 <= v <= 15 for _, v in got.points) and all(a[0] < b[0] and a[1] != b[1] for a, b in zip(got.points, got.points[1:], strict=False)))
    assert plan(np.zeros(768), G.Record([(0, 16)])) is None


def test_continuity():
    none = [G.Record() for _ in range(4)]
    now = [G.Record(), G.Record([(3, 10)]), G.Record([(9, 15)]), G.Record()]
    assert G.bridge(np.zeros(768, np.float32), none, now) == (3, 5)
    assert G.continued(np.zeros(768, np.float32), none, now)[0].points == []  # nothing changes, so nothing is coded
    heard = np.full(768, 1000, np.float32)
    assert G.continued(heard, none, now)[0].points in ([], [(3, 5)])
    assert G.bridge(np.full(768, 20000, np.float32), none, now) is None
    assert G.bridge(heard, none, [G.Record([(1, 5)]), *now[1:]]) is None


def test_records_of_streams(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, [(rng.normal(0, 1, 768) * 10 ** rng.uniform(0, 4, 96).repeat(8)).astype(np.float32).tolist() for _ in range(2)]) for s in "ab" for i in range(12)]
    df = spark.createDataFrame(rows, "stream string, frame_no long, windows array<array<float>>").repartition(3)
    got = {(r.stream, r.frame_no): r.records for r in G.planned_records(df, ["stream"]).collect()}
    for s in "ab":
        state = [G.Record(), G.Record()]
        for i in range(12):
            x = np.array(next(w for a, b, w in rows if (a, b) == (s, i)), np.float32)
            found = [plan(w, r) for w, r in zip(x, state, strict=True)]
            found = None if None in found else G.continued(x[0], state, found)
            if found is None:
                assert got[s, i] is None
                continue
            state = found
            assert [[(p.location, p.level) for p in r.points] for r in got[s, i]] == [r.points for r in found]


def test_single_precision_images(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 50) * 10.0 ** rng.integers(-40, 38, 50), [0.0, 1.0, -1.0, 0.5, 2.0**-126, 2.0**-149, 2.0**-127, 3.4028235e38, np.inf, -np.inf, 1 - 2**-24]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float")
    got = df.select("i", S.float32_to_bits(F.col("x")).alias("b")).withColumn("back", S.float32_from_bits(F.col("b"))).orderBy("i").collect()
    assert [r.b for r in got] == x.view(np.uint32).astype(np.int64).tolist()
    assert [r.back for r in got] == x.tolist()


def test_small_functions(spark):
    rows = [(5, 0.0), (-7, 3.0), (40000, -40000.9), (31, float("nan")), (2, 3e9), (1, -3e9)]
    df = spark.createDataFrame(rows, "n int, x double")
    got = df.select(S.clamp_int16(F.col("n")).alias("a"), S.clamp_symbol(F.col("n"), F.lit(5)).alias("b"), S.truncate_to_int32(F.col("x")).alias("t"), S.unordered_less_equal(F.col("x"), F.lit(0.0)).alias("le"), S.bounded_gain_step(F.col("n"), F.lit(3), 10).alias("g")).collect()
    assert [r.a for r in got] == [5, -7, 32767, 31, 2, 1] and [r.b for r in got] == [5, -7, 7, 7, 2, 1]
    assert [r.t for r in got] == [0, 3, -40000, -(2**31), -(2**31), -(2**31)] and [r.le for r in got] == [True, False, True, True, False, True]
    assert [r.g for r in got] == [5, 0, 7, 7, 2, 1]
    r = df.limit(1).select(S.band_width(F.lit(31)).alias("w"), S.step_of_mode(F.lit(0)).alias("s0"), S.step_of_mode(F.lit(9)).alias("s9"), S.least_band_bits(F.lit(7), F.lit(128)).alias("b"), S.gain_steps_for_ratio(F.lit(3.0)).alias("g"), S.gain_steps_for_ratio(F.lit(0.2)).alias("h")).first()
    assert tuple(r) == (128, 0, 18, 6 + 64 * 6, math.floor(math.log2(3 * 2**0.5)), math.floor(math.log2(0.2 * 2**0.5)))
    e = df.limit(1).select(S.reconstruction_error(F.array(F.lit(1.0), F.lit(-0.5)), F.array(F.lit(7), F.lit(-4)), F.lit(1.0), F.lit(5)).alias("e")).first().e
    assert e == pytest.approx((1 - 7 / 7.5) ** 2 + (-0.5 + 4 / 7.5) ** 2)


def test_frames_are_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], b"ab"), ([1.0], [1.0, 2.0], b"a"), ([1.0], [1.0], None), (None, [1.0], b"abc")], "l array<double>, r array<double>, d binary")
    got = df.select(S.frame_error(F.col("l"), F.col("r"), 2).alias("e"), S.coded_frame_error(F.col("d"), 2).alias("c")).collect()
    assert [r.e for r in got] == [None, "unequal channels", "incomplete", "missing channel"]
    assert [r.c is None for r in got] == [True, False, False, False]


def test_fields_into_bytes(spark):
    df = spark.createDataFrame([(5, 1, 300), (7, 0, 1)], "a int, b int, c int")
    fields = [(F.col("a"), 3), (F.col("b"), 1), (F.col("c"), 9)]
    for r in df.select("*", B.pack_bits(fields).alias("d")).collect():
        w = BitWriter()
        for v, n in ((r.a, 3), (r.b, 1), (r.c, 9)):
            w.write(v, n)
        assert bytes(r.d) == w.bytes(2)
    assert B.counted_bits(fields) == 13


def test_merging_writer():
    rng = np.random.default_rng(3)
    fields = [(int(rng.integers(0, 1 << n)), int(n)) for n in rng.integers(1, 9, 60)]
    one, other, count = BitWriter(), bytearray(100), BitCounter()
    merging = MergingWriter(other)
    for v, n in fields:
        for w in (one, merging, count):
            w.write(v, n)
    assert bytes(other) == one.bytes(100) and merging.position == one.position == count.position
    r = BitReader(bytes(other))
    assert [r.read(n) for _, n in fields] == [v for v, _ in fields]
    short = bytearray(2)
    w = MergingWriter(short, 12)
    for _ in range(4):
        w.write(255, 8)
    assert short == bytearray([0, 15]) and w.position == 44
