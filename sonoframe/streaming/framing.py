"""Framing of endless streams: chunks of any length in, full frames out.

The state of a stream is the samples that don't fill a frame yet and the number of frames so far. Chunks of one trigger are
taken in order of their number; a chunk that comes late or twice is not framed but reported. A chunk without samples ends
its stream, pads the last frame and adds the silent frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonoframe.plans.dimensions import DELAY, DRAIN_FRAMES, FRAME

OUTPUT = "stream_id string, frame_no long, left array<float>, right array<float>, error string"
STATE = "rest binary, seen long, frames long, next_chunk long, ended boolean"


class Framer:
    """Frames of one stream: the first DELAY samples end the alignment frame, blocks follow, the first one isn't given out."""

    def __init__(self, state: tuple | None = None, size: int = FRAME, delay: int = DELAY):
        self.size, self.delay = size, delay
        rest, self.seen, self.frames, self.next_chunk, self.ended = state or (b"", 0, 0, 0, False)
        self.rest = np.frombuffer(bytes(rest), np.float32).reshape(2, -1)

    def state(self) -> tuple:
        return (self.rest.tobytes(), self.seen, self.frames, self.next_chunk, self.ended)

    def _give(self, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if self.frames != 1:
            yield self.frames - (self.frames > 1), block
        self.frames += 1

    def write(self, chunk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if self.ended:
            raise ValueError("the stream has ended")
        self.seen += chunk.shape[1]
        self.rest = np.concatenate([self.rest, chunk.astype(np.float32)], 1)
        if self.frames == 0 and self.rest.shape[1] >= self.delay:
            yield from self._give(np.pad(self.rest[:, : self.delay], ((0, 0), (self.size - self.delay, 0))))
            self.rest = self.rest[:, self.delay :]
        while self.frames and self.rest.shape[1] >= self.size:
            yield from self._give(self.rest[:, : self.size])
            self.rest = self.rest[:, self.size :]

    def finish(self, drain: int = DRAIN_FRAMES) -> Iterator[tuple[int, np.ndarray]]:
        """Nothing for an empty stream, and nothing the second time."""
        if not self.ended and self.seen:
            if self.frames == 0:
                short = self.rest.shape[1]
                yield from self._give(np.pad(self.rest, ((0, 0), (self.size - self.delay, self.delay - short))))
                self.rest = self.rest[:, :0]
            if self.rest.shape[1]:
                yield from self._give(np.pad(self.rest, ((0, 0), (0, self.size - self.rest.shape[1]))))
                self.rest = self.rest[:, :0]
            # A stream that ended within its alignment frame has no first block to leave out.
            self.frames = max(self.frames, 2)
            for _ in range(drain):
                yield from self._give(np.zeros((2, self.size), np.float32))
        self.ended = True


def stream_frames(chunks: DataFrame, size: int = FRAME, delay: int = DELAY) -> DataFrame:
    """``chunks``: stream_id string, chunk_no long, left and right array<float>, as a stream."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Framer(state.get if state.exists else None, size, delay)
        out = []
        for r in pd.concat(list(parts)).sort_values("chunk_no").itertuples():
            if r.chunk_no < f.next_chunk or f.ended:
                out.append((key[0], None, None, None, f"chunk {r.chunk_no} is late"))
                continue
            f.next_chunk = r.chunk_no + 1
            if len(r.left) != len(r.right):
                out.append((key[0], None, None, None, f"chunk {r.chunk_no} has unequal channels"))
                continue
            given = f.write(np.array([r.left, r.right], np.float32)) if len(r.left) else f.finish()
            out += [(key[0], n, x[0].tolist(), x[1].tolist(), None) for n, x in given]
        state.update(f.state())
        yield pd.DataFrame(out, columns=["stream_id", "frame_no", "left", "right", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
