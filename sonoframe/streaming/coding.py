"""Encoding and decoding of endless streams with state.

The state of a stream is what later frames look back to: the samples of its last two frames, or the bytes of its last three
coded ones. A trigger's frames are taken in order; one that is late, has unequal channels or can't be read is reported and
leaves the state as it was, so a stream goes on as if it had not come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonoframe.codec import profile
from sonoframe.operators import encoding, synthesis
from sonoframe.operators.syntax import SyntaxFault
from sonoframe.plans.dimensions import FRAME

ENCODED = "stream_id string, frame_no long, bytes binary, error string"
DECODED = "stream_id string, frame_no long, left array<float>, right array<float>, error string"
SCALE = np.float32(32768)


class EncoderState:
    """Samples (frames x 2 x 1024) that the next frame looks back to, and the last frame's number."""

    def __init__(self, saved: tuple | None = None):
        data, self.last = saved or (b"", -1)
        self.frames = np.frombuffer(data, np.float32).reshape(-1, 2, FRAME)

    def saved(self) -> tuple:
        return (self.frames.tobytes(), self.last)

    def encode(self, samples: np.ndarray, last: int, bitrate: int) -> list[bytes]:
        """Coded frames of samples (frames x 2 x 1024); the state moves on only if all goes well."""
        both = np.concatenate([self.frames, samples.astype(np.float32)])
        out = encoding.encoded(both * SCALE, bitrate)[len(self.frames) :]
        self.frames, self.last = both[-encoding.HALO :], last
        return out


class DecoderState:
    """Coded frames that the next one looks back to, and the last one's number."""

    def __init__(self, saved: tuple | None = None):
        self.frames, self.last = (list(saved[0]), saved[1]) if saved else ([], -1)

    def saved(self) -> tuple:
        return (self.frames, self.last)

    def decode(self, frame: bytes, last: int, size: int, joint: bool) -> np.ndarray:
        """Samples (2 x 1024) of a frame; the state moves on only if it can be read."""
        parsed = [synthesis.parsed(bytes(b), size, joint) for b in [*self.frames, frame]]
        out = (synthesis.decoded(parsed)[-1] / SCALE).astype(np.float32)
        self.frames, self.last = [*self.frames, frame][-synthesis.LOOK_BACK :], last
        return out


def stream_encoded(frames: DataFrame, bitrate: int) -> DataFrame:
    """``frames``: stream_id string, frame_no long, left and right array<float> of 1024 samples, as a stream."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, out = EncoderState(state.get if state.exists else None), []
        good: list = []
        last = s.last
        for r in pd.concat(list(parts)).sort_values("frame_no").itertuples():
            if r.frame_no <= last:
                out.append((key[0], r.frame_no, None, "late"))
            elif r.left is None or r.right is None or len(r.left) != FRAME or len(r.right) != FRAME:
                out.append((key[0], r.frame_no, None, f"a frame takes two channels of {FRAME}"))
            else:
                good.append((r.frame_no, np.stack([r.left, r.right])))
                last = r.frame_no
        if good:
            coded = s.encode(np.stack([x for _, x in good]), last, bitrate)
            out += [(key[0], n, b, None) for (n, _), b in zip(good, coded, strict=True)]
            state.update(s.saved())
        yield pd.DataFrame(out, columns=["stream_id", "frame_no", "bytes", "error"])

    return frames.groupBy("stream_id").applyInPandasWithState(step, ENCODED, "frames binary, last long", "append", GroupStateTimeout.NoTimeout)


def stream_decoded(frames: DataFrame, bitrate: int) -> DataFrame:
    """``frames``: stream_id string, frame_no long, bytes binary, as a stream."""
    size, joint = profile(bitrate)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, out = DecoderState(state.get if state.exists else None), []
        for r in pd.concat(list(parts)).sort_values("frame_no").itertuples():
            if r.frame_no <= s.last:
                out.append((key[0], r.frame_no, None, None, "late"))
                continue
            try:
                left, right = s.decode(r.bytes, r.frame_no, size, joint).tolist()
                out.append((key[0], r.frame_no, left, right, None))
            except SyntaxFault as e:
                out.append((key[0], r.frame_no, None, None, str(e)))
        state.update(s.saved())
        yield pd.DataFrame(out, columns=["stream_id", "frame_no", "left", "right", "error"])

    return frames.groupBy("stream_id").applyInPandasWithState(step, DECODED, "frames array<binary>, last long", "append", GroupStateTimeout.NoTimeout)
