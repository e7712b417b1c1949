"""Command line: python -m sonoframe --encode in.wav out.wav [--bitrate 66|105|132], or --decode in.wav out.wav."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterator

import numpy as np

from sonoframe import codec
from sonoframe.operators import synthesis
from sonoframe.plans.dimensions import DELAY, FRAME, PROFILES, SAMPLE_RATE
from sonoframe.sources import wave

#: Samples read at once.
STEP = 1 << 16


class Progress:
    """How far a file is, and how much faster than playing it takes."""

    def __init__(self, label: str, total: int, quiet: bool, out=None):
        self.label, self.total, self.quiet, self.out, self.began = label, total, quiet, out or sys.stderr, time.monotonic()

    @property
    def seconds(self) -> float:
        return max(1e-9, time.monotonic() - self.began)

    def factor(self, samples: int) -> float:
        return samples / SAMPLE_RATE / self.seconds

    def show(self, samples: int, end: str = "\r") -> None:
        if not self.quiet:
            share = 100 * samples // max(1, self.total)
            print(f"{self.label} {min(100, share)}% of {clock(self.total / SAMPLE_RATE)} RT: {self.factor(samples):.2f}x", end=end, file=self.out)


def clock(seconds: float) -> str:
    whole = int(seconds)
    return f"{whole // 60}:{whole % 60:02d}"


def pcm_chunks(f, info: wave.WaveInfo) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    f.seek(info.data_at)
    left = info.data_bytes
    while left:
        data = f.read(min(left, STEP * info.block))
        if not data:
            raise wave.WaveError("the file is cut short")
        left -= len(data)
        yield wave.planar(data, info.channels)


def encode_file(source: str, target: str, bitrate: int, quiet: bool = True) -> int:
    """Samples coded. The header is written first as a placeholder, and again when the totals are known."""
    info = wave.file_info(source, coded=False)
    encoder, bar, n, size = codec.StreamingEncoder(bitrate), Progress("encode", info.frames, quiet), 0, 0
    with open(source, "rb") as f, open(target, "wb") as out:
        out.write(wave.coded_header(bitrate, 0))
        for left, right in pcm_chunks(f, info):
            size += sum(out.write(b) for b in encoder.write(left, right))
            n += len(left)
            bar.show(n)
        size += sum(out.write(b) for b in encoder.finish())
        out.seek(0)
        out.write(wave.coded_header(bitrate, size, FRAME, n))
    bar.show(n, "\n")
    return n


def decode_file(source: str, target: str, quiet: bool = True) -> int:
    """Samples decoded."""
    info = wave.file_info(source, coded=True, need_fact=True)
    if info.bitrate is None:
        raise wave.WaveError("no known profile")
    bar, n, skip = Progress("decode", info.sample_count, quiet), 0, info.align + DELAY

    def frames() -> Iterator[bytes]:
        with open(source, "rb") as f:
            f.seek(info.data_at)
            for _ in range(info.frames):
                yield f.read(info.block)

    with open(target, "wb") as out:
        out.write(wave.pcm_header(0))
        for part in synthesis.batches_of(frames(), *codec.profile(info.bitrate), size=codec.BATCH):
            x = part.transpose(1, 0, 2).reshape(2, -1)
            cut, skip = min(skip, x.shape[1]), max(0, skip - x.shape[1])
            x = x[:, cut : cut + info.sample_count - n]
            out.write(np.stack([wave.pcm16(c) for c in x], 1).tobytes())
            n += x.shape[1]
            bar.show(n)
        if n != info.sample_count:
            raise wave.WaveError(f"the timeline lacks {info.sample_count - n} samples")
        out.seek(0)
        out.write(wave.pcm_header(4 * n))
    bar.show(n, "\n")
    return n


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sonoframe", description="Encode and decode framed stereo audio.")
    verb = p.add_mutually_exclusive_group(required=True)
    verb.add_argument("-e", "--encode", action="store_true", help="PCM to coded")
    verb.add_argument("-d", "--decode", action="store_true", help="coded to PCM")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-b", "--bitrate", type=int, choices=[b for b, *_ in PROFILES], help="kbps, when encoding (132)")
    p.add_argument("-f", "--force", action="store_true", help="replace the output")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress")
    o = p.parse_args(arguments)
    if o.decode and o.bitrate is not None:
        p.error("--bitrate goes with --encode")
    if os.path.realpath(o.input) == os.path.realpath(o.output):
        p.error("input and output are the same file")
    if os.path.exists(o.output) and not o.force:
        p.error(f"{o.output} exists; --force replaces it")
    return o


def main(arguments: list[str] | None = None) -> int:
    o = options(arguments)
    new = f"{o.output}.new"
    try:
        if o.encode:
            encode_file(o.input, new, o.bitrate or 132, o.quiet)
        else:
            decode_file(o.input, new, o.quiet)
        os.replace(new, o.output)
    except (OSError, ValueError) as e:
        print(f"sonoframe: {e}", file=sys.stderr)
        return 1
    finally:
        if os.path.exists(new):
            os.remove(new)
    return 0


if __name__ == "__main__":
    sys.exit(main())
