import numpy as np
import pytest

from sonoframe.sources import wave


@pytest.fixture(scope="module")
def coded():
    frames = [bytes([i]) * 384 for i in range(7)]
    return frames, wave.coded_wave(132, frames)


def test_header_layout(coded):
    frames, image = coded
    assert len(image) == 80 + 7 * 384
    word = lambda at: int.from_bytes(image[at : at + 2], "little")
    assert image[:4] == b"RIFF" and image[8:16] == b"WAVEfmt " and image[52:56] == b"fact" and image[72:76] == b"data"
    assert [word(a) for a in (20, 22, 32, 36, 38, 44, 46, 48, 50)] == [0x270, 2, 384, 14, 1, 0, 0, 1, 0]
    assert int.from_bytes(image[28:32], "little") == 16538
    i = wave.parse(image)
    assert (i.bitrate, i.frames, i.sample_count, i.align) == (132, 7, 4 * 1024, 1024)
    assert list(wave.frames_of(image)) == frames


@pytest.mark.parametrize("bitrate, per_second, flag", [(66, 8269, 1), (105, 13092, 0), (132, 16538, 0)])
def test_rates(bitrate, per_second, flag):
    h = wave.coded_header(bitrate, 0)
    assert int.from_bytes(h[28:32], "little") == per_second and int.from_bytes(h[44:46], "little") == flag


def test_bad_images(coded):
    _, image = coded
    for bad in (b"", image[:60], b"RIFX" + image[4:], image[:20] + b"\x01\x00" + image[22:], image[:-1]):
        with pytest.raises((wave.WaveError, Exception)):
            wave.parse(bad)
    without_fact = image[:52] + image[72:]
    assert wave.parse(without_fact).sample_count is None
    with pytest.raises(wave.WaveError):
        wave.walk(lambda a, n: without_fact[a : a + n], len(without_fact), True, need_fact=True)
    with pytest.raises(wave.WaveError):
        wave.coded_wave(132, [b"short"])


def test_pcm16():
    x = np.array([2, -2, np.nan, 0.5, 1 / 32768, -1 / 32768], np.float32)
    assert wave.pcm16(x).tolist() == [32767, -32767, -32767, 16384, 1, -1]


def test_sources(spark, tmp_path, coded):
    frames, image = coded
    left = np.sin(np.arange(3000) / 50).astype(np.float32) / 2
    (tmp_path / "pcm").mkdir()
    (tmp_path / "pcm" / "a.wav").write_bytes(wave.pcm_wave(left, -left))
    mono = wave.pcm16(left).tobytes()
    (tmp_path / "pcm" / "b.wav").write_bytes(wave.pcm_header(0, 1) + mono)  # a size of 0 means up to the end
    wave.register(spark)
    rows = spark.read.format("wav_pcm").option("range", 1024).load(str(tmp_path / "pcm")).orderBy("path", "sample_no").collect()
    assert [r.sample_no for r in rows] == [0, 1024, 2048] * 2
    got = np.concatenate([r.left for r in rows[:3]])
    assert (got == wave.pcm16(left).astype(np.float32) / 32768).all()
    assert rows[3].left == rows[3].right
    (tmp_path / "coded").mkdir()
    (tmp_path / "coded" / "a.wav").write_bytes(image)
    back = spark.read.format("coded_wav").option("range", 2).load(str(tmp_path / "coded"))
    assert [bytes(r.bytes) for r in back.orderBy("frame_no").collect()] == frames
    two = back.selectExpr("'s' || (frame_no % 2) stream_id", "frame_no", "bytes")
    two.write.format("coded_wav").option("bitrate", 132).option("sampleCount", 1000).mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.wav", "s1.wav"]
    assert list(wave.frames_of((tmp_path / "out" / "s1.wav").read_bytes())) == frames[1::2]


def test_images_in_columns(spark, coded):
    frames, image = coded
    df = spark.createDataFrame([("a", image), ("b", b"junk" * 5)], "path string, content binary")
    m = {r.path: r for r in wave.wave_metadata(df).collect()}
    assert m["a"].frame_count == 7 and m["a"].bitrate_kbps == 132 and m["a"].error is None
    assert m["b"].frame_count is None and "RIFF" in m["b"].error
    got = wave.wave_frames(df.where("path = 'a'")).orderBy("frame_no").collect()
    assert [bytes(r.bytes) for r in got] == frames


def test_streams_to_files_and_back(spark, tmp_path, coded):
    frames, _ = coded
    wave.register(spark)
    rows = [(s, i, b) for s in ("a", "b") for i, b in enumerate(frames)]
    df = spark.createDataFrame(rows, "stream_id string, frame_no long, bytes binary").repartition(4)
    wave.write_coded(df, f"file://{tmp_path}/coded", 132)
    assert (tmp_path / "coded" / "a.wav").read_bytes() == wave.coded_wave(132, frames)
    assert sorted(p.name for p in (tmp_path / "coded").iterdir()) == ["a.wav", "b.wav"]  # parts are gone
    with pytest.raises(Exception, match="has files"):
        wave.write_coded(df, str(tmp_path / "coded"), 132)
    with pytest.raises(Exception, match="takes 304"):
        wave.write_coded(df, str(tmp_path / "other"), 105)
    back = spark.read.format("coded_wav").option("range", 1).load(f"file://{tmp_path}/coded/a*.wav")
    assert [(r.frame_no, bytes(r.bytes)) for r in back.orderBy("frame_no").collect()] == list(enumerate(frames))
    left = np.sin(np.arange(5000) / 40).astype(np.float32) / 2
    x = [(s, i, left[i : i + 1000].tolist(), (-left[i : i + 1000]).tolist()) for s in ("l", "r") for i in range(0, 5000, 1000)]
    wave.write_pcm(spark.createDataFrame(x, "stream_id string, sample_no long, left array<float>, right array<float>").repartition(3), str(tmp_path / "pcm"))
    assert (tmp_path / "pcm" / "r.wav").read_bytes() == wave.pcm_wave(left, -left)


def test_images_from_tables(spark, coded):
    frames, image = coded
    df = spark.createDataFrame([("a", i, b, 4096) for i, b in enumerate(frames)], "s string, frame_no long, bytes binary, n long").repartition(3)
    assert bytes(wave.coded_images(df, "s", 132, "n").first().content) == image
    x = spark.createDataFrame([("a", 2, [0.5], [0.25]), ("a", 0, [0.0, 1.0], [0.0, -1.0])], "s string, sample_no long, left array<float>, right array<float>")
    assert bytes(wave.pcm_images(x, "s").first().content) == wave.pcm_wave(np.array([0, 1, 0.5]), np.array([0, -1, 0.25]))


def test_reader_in_memory(coded):
    import asyncio

    frames, image = coded
    r = wave.WaveReader(memoryview(image))
    assert list(r) == frames and r.metadata["frame_count"] == 7 and r.metadata["alignment_sample_count"] == 1024

    async def all_of():
        return [f async for f in r]

    assert asyncio.run(all_of()) == frames
