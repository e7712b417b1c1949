import numpy as np
import pytest

from sonoframe import __main__ as command
from sonoframe import codec
from sonoframe.sources import wave


@pytest.fixture
def pcm(tmp_path):
    i = np.arange(2048)
    x = [(a * np.sin(2 * np.pi * f * i / 44100) / 32768).astype(np.float32) for a, f in ((8000, 440), (8000, 660))]
    (tmp_path / "in.wav").write_bytes(wave.pcm_wave(*x))
    return tmp_path, x


@pytest.mark.parametrize("bitrate", [66, 105, 132])
def test_files(pcm, bitrate, capsys):
    folder, _ = pcm
    a, b, c = (str(folder / n) for n in ("in.wav", "coded.wav", "out.wav"))
    assert command.main(["--encode", a, b, "--bitrate", str(bitrate)]) == 0
    info = wave.file_info(b, True, True)
    assert (info.bitrate, info.frames, info.sample_count) == (bitrate, 5, 2048)
    assert "RT:" in capsys.readouterr().err
    assert command.main(["-d", b, c, "-q"]) == 0
    left, right = codec.decode_wave_pcm(open(b, "rb").read())
    assert open(c, "rb").read() == wave.pcm_wave(left, right)
    assert capsys.readouterr().err == ""


def test_options(pcm, capsys):
    folder, _ = pcm
    a, b = str(folder / "in.wav"), str(folder / "b.wav")
    for bad in (["--encode", "--decode", a, b], [a, b], ["--decode", a, b, "--bitrate", "66"], ["--encode", a, a], ["--encode", a, b, "--bitrate", "96"]):
        with pytest.raises(SystemExit):
            command.options(bad)
    (folder / "b.wav").write_bytes(b"kept")
    with pytest.raises(SystemExit):
        command.options(["--encode", a, b])
    assert command.main(["--decode", a, str(folder / "c.wav")]) == 1  # not a coded file
    assert not (folder / "c.wav").exists() and not (folder / "c.wav.new").exists()
    assert command.main(["--encode", a, b, "--force", "-q"]) == 0 and (folder / "b.wav").read_bytes()[:4] == b"RIFF"


def test_clock():
    assert command.clock(61.9) == "1:01"
    assert command.Progress("x", 10, True).factor(44100) > 0
