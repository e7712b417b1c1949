import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonoframe.operators import kernels, spectral
from sonoframe.plans import framing as FR
from sonoframe.streaming.framing import Framer, stream_frames


@pytest.mark.parametrize("n, want", [(0, 0), (1, 4), (69, 4), (1024, 4), (1500, 5), (2048, 5), (10240, 13)])
def test_frame_counts(spark, n, want):
    f = Framer()
    x = np.arange(2 * n, dtype=np.float32).reshape(2, n)
    at, out = 0, []
    for size in [17, 333, 2048, 1, 777] * (n // 3000 + 2):
        out += list(f.write(x[:, at : at + size]))
        at += size
    out += list(f.finish()) + list(f.finish())
    assert len(out) == want and [i for i, _ in out] == list(range(want))
    assert spark.range(1).select(FR.frame_count(F.lit(n))).first()[0] == want
    if n >= 69:
        assert (out[0][1][0, -69:] == x[0, :69]).all() and not out[0][1][0, :-69].any()
    with pytest.raises(ValueError):
        list(f.write(x))


def test_batch_frames_match_streaming(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for s, n in (("a", 3), ("b", 70), ("c", 500)):
        x = rng.normal(size=(2, n)).astype(np.float32)
        rows += [(s, i, float(x[0, i]), float(x[1, i])) for i in range(n)]
        f = Framer(size=64, delay=5)
        want[s] = list(f.write(x)) + list(f.finish())
    df = spark.createDataFrame(rows, "stream_id string, sample_no long, l float, r float")
    framed = FR.with_drain(FR.frames(df, "stream_id", ["l", "r"], 64, 5), "stream_id", ["l", "r"], 64)
    short = framed.groupBy("stream_id").agg(F.max("frame_no").alias("m")).collect()
    assert {r.stream_id: r.m for r in short}["c"] == 1 + 494 // 64 + 3
    got = {}
    for r in FR.emitted(framed).orderBy("stream_id", "frame_no").collect():
        got.setdefault(r.stream_id, []).append(np.array([r.l, r.r], np.float32))
    # A stream within its alignment frame has no block to leave out, so the first silent frame takes that number.
    for s in ("b", "c"):
        assert len(got[s]) == len(want[s])
        for a, (_, b) in zip(got[s], want[s], strict=True):
            assert (a == b).all()


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 300)).astype(np.float32)
    chunks = [("s", 0, x[:, :10]), ("s", 1, x[:, 10:200]), ("s", 2, x[:, 200:]), ("s", 1, x[:, :5]), ("s", 3, x[:, :0])]
    (tmp_path / "in").mkdir()
    for i, c in enumerate(chunks):
        time.sleep(0.02)  # files are read in order of their times
        pd.DataFrame({"stream_id": [c[0]], "chunk_no": [c[1]], "left": [c[2][0].tolist()], "right": [c[2][1].tolist()]}).to_json(tmp_path / "in" / f"{i}.json", orient="records", lines=True, double_precision=15)
    schema = "stream_id string, chunk_no long, left array<float>, right array<float>"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    q = stream_frames(read, 64, 5).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("framed").collect()
    assert [r.error for r in got if r.error] == ["chunk 1 is late"]
    frames = sorted((r.frame_no, r.left) for r in got if not r.error)
    f = Framer(size=64, delay=5)
    want = list(f.write(x)) + list(f.finish())
    assert [n for n, _ in frames] == [n for n, _ in want]
    assert all((np.array(a, np.float32) == b[0]).all() for (_, a), (_, b) in zip(frames, want, strict=True))


def test_interleave(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "l array<double>, r array<double>")
    both = FR.interleave(F.col("l"), F.col("r"))
    row = df.select(both.alias("x"), FR.deinterleave(both, 0).alias("l"), FR.deinterleave(both, 1).alias("r")).first()
    assert row.x == [1, 3, 2, 4] and row.l == [1, 2] and row.r == [3, 4]


def test_spectra_do_not_depend_on_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 1024)).astype(np.float32)
    df = spark.createDataFrame([("s", i, x[i].tolist()) for i in range(6)], "stream_id string, frame_no long, samples array<float>")
    before = np.concatenate([np.zeros((1, 1024), np.float32), x[:-1]])
    bands = kernels.four_bands(before, x)
    earlier = np.concatenate([np.zeros((1, 4, 256), np.float32), bands[:-1]])
    want = kernels.spectrum(np.concatenate([earlier, bands], 2))
    for chunk in (4096, 2):
        monkeypatch.setattr(spectral, "CHUNK", chunk)
        got = spectral.spectra(spectral.subbands(df, ["stream_id"]), ["stream_id"]).orderBy("frame_no").collect()
        assert len(got) == 6
        assert (np.array([r.lines for r in got], np.float32) == want).all()


def test_trims_cover_the_timeline(spark):
    d = spark.createDataFrame([("s", i, 5000) for i in range(8)], "stream_id string, frame_no long, sample_count long")
    t = FR.trims(d, "stream_id")
    assert FR.incomplete(t, "stream_id").first().complete
    assert not FR.incomplete(t.where("frame_no < 5"), "stream_id").first().complete


def test_gained_spectra(spark):
    rng = np.random.default_rng(11)
    bands = rng.normal(size=(3, 4, 256)).astype(np.float32)
    gains = [[[], [], [], []], [[(0, 5)], [], [(3, 9), (20, 2)], []], [[], [], [], []]]
    rows = [("s", i, *[b.tolist() for b in bands[i]], gains[i]) for i in range(3)]
    df = spark.createDataFrame(rows, f"stream_id string, frame_no long, b0 array<float>, b1 array<float>, b2 array<float>, b3 array<float>, gains {spectral.GAINS}")
    got = {r.frame_no: np.array(r.lines, np.float32) for r in spectral.gained_spectra(df, ["stream_id"]).collect()}
    plain = {r.frame_no: np.array(r.lines, np.float32) for r in spectral.spectra(df, ["stream_id"]).collect()}
    assert (got[0] == plain[0]).all()
    for i in (1, 2):
        window = np.concatenate([bands[i - 1], bands[i]], 1)[None]
        scale = np.stack([kernels.gain_scale(a, b) for a, b in zip(gains[i - 1], gains[i], strict=True)])[None]
        assert (got[i] == kernels.spectrum(window, scale)[0]).all()
        assert (got[i][256:512] == plain[i][256:512]).all() and (got[i][:256] != plain[i][:256]).any()


def test_long_streams_are_cut(spark, monkeypatch):
    """Ceilings and smoothed rises of a stream over many blocks are those of the stream in one piece."""
    from sonoframe.plans import analysis as A

    rng = np.random.default_rng(12)
    peaks = (10 ** rng.uniform(0, 3, 400)).tolist()
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(peaks)] + [("t", 3, 1.0)], "stream string, chunk_no long, peak double").repartition(3)
    monkeypatch.setattr(A, "BLOCK", 32)
    rows = {r.chunk_no: r for r in A.running_ceiling(df, "stream").where("stream = 's'").collect()}
    for i in range(400):
        assert rows[i].ceiling == (max(peaks[:i]) if i else None) and rows[i].release_ceiling == (max(peaks[i + 1 :]) if i < 399 else None)
    monkeypatch.setattr(A, "WARM_UP", 32)
    monkeypatch.setattr(A, "BLOCK", 64)
    got = {r.chunk_no: r for r in A.log_flux(df, "stream").where("stream = 's'").collect()}
    smoothed = 0.0
    for i in range(400):
        assert abs(got[i].smoothed - smoothed) < 1e-4 and got[i].detected == (got[i].rise > got[i].smoothed + 0.7)
        smoothed = 0.3 * got[i].rise + 0.7 * smoothed
