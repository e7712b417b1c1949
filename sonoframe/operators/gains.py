"""Gain control: which attacks and releases of a band are worth a point, and the records that code them.

A record depends on the one before it in its stream, so a band's frames are walked in order; what is heavy, the peaks of a
window's chunks, is worked out for all frames at once and leaves 65 numbers a frame. Rows come sorted, and the walk keeps
one record a band, so its memory doesn't grow with a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sonoframe.operators import kernels

#: Window of a band: 256 samples before, then 512; chunks of 8, and of 4 chunks for releases.
BEFORE, CHUNKS, CHUNK = 256, 64, 8
ATTACKS, RELEASES = 32, 8
MOST_POINTS = 7
PLAIN = 4
#: The peak below which nothing counts, how far a rise must exceed the smoothed one, and the smoothing.
QUIET, MARGIN, NEW, OLD = 10, 0.7, 0.3, 0.7
LOG2_E = float(np.float32(math.log2(math.e)))
#: Most steps up, most steps down, level of a continuity point, its limit, and the change that it must make.
MOST_UP, MOST_DOWN, BRIDGE, LOUD, CHANGE = 10, 4, 5, 16384, 0.1


@dataclass
class Record:
    """Points (location, level) and the peak of the window's first half."""

    points: list[tuple[int, int]] = field(default_factory=list)
    peak: float = 0.0

    @property
    def bits(self) -> int:
        return 3 + 9 * len(self.points)


def peaks_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of the 64 chunks behind the first 256 samples (rows x 64), and of the last 32 of those 256."""
    size = np.abs(windows)
    return size[:, BEFORE : BEFORE + CHUNKS * CHUNK].reshape(len(windows), CHUNKS, CHUNK).max(2), size[:, BEFORE - 4 * CHUNK : BEFORE].max(1)


def log2_step(ratio: float) -> int:
    return math.trunc(math.log10(max(ratio, 1e-20)) / math.log10(2) + 0.5)


def step_between(value: float, ceiling: float) -> int:
    return log2_step(value / ceiling if ceiling > 4 else value * 0.25)


class Flux:
    """Rises of a peak above its ceiling, in octaves, against their smoothed course."""

    def __init__(self):
        self.smoothed = 0.0

    def fires(self, value: float, ceiling: float) -> bool:
        rise = max(0.0, math.log(value / ceiling) * LOG2_E) if ceiling > 0 and value > ceiling else 0.0
        fired = rise > self.smoothed + MARGIN
        self.smoothed = NEW * rise + OLD * self.smoothed
        return fired


@dataclass
class Detection:
    attacks: dict[int, int]
    releases: dict[int, int]
    chosen: set[int]  # slots: attacks as they are, releases behind them
    first_gain: int
    fallback: int
    peak: float

    @property
    def count(self) -> int:
        return len(self.attacks) + len(self.releases)


def detected(peaks: list[float], before: float, previous: Record) -> Detection:
    """Candidates with the steps that they ask for, and those chosen: the largest steps, earlier ones first among equals."""
    peak = max(peaks[:ATTACKS])
    if not previous.points and peak <= QUIET and peaks[ATTACKS] <= QUIET:
        return Detection({}, {}, set(), 0, 0, peak)
    attacks, releases, flux = {}, {}, Flux()
    ceiling = previous.peak
    for i in range(ATTACKS):
        ceiling = max(ceiling, peaks[i])
        if flux.fires(peaks[i + 1], ceiling) and peaks[i + 1] > QUIET:
            attacks[i] = max(0, step_between(peaks[i + 1], ceiling))
    if previous.points or attacks:
        groups = [max(peaks[4 * g : 4 * g + 4]) for g in range(CHUNKS // 4)]
        ceiling, flux = max(peaks[-1], *groups[RELEASES:]), Flux()
        for g in range(RELEASES - 1, -1, -1):
            ceiling = max(ceiling, groups[g])
            value = groups[g - 1] if g else before
            if flux.fires(value, ceiling) and value > QUIET:
                releases[g] = max(0, step_between(value, ceiling))
    steps = attacks | {ATTACKS + g: s for g, s in releases.items()}
    wanted = min(len(steps), MOST_POINTS)
    ranked = sorted((s for s in steps if steps[s] > 0), key=lambda s: (-steps[s], s))[:MOST_POINTS]
    chosen = set(ranked[:wanted])
    fallback = 0
    if len(ranked) < wanted:
        chosen.add(0)
        if 0 not in attacks:
            fallback = step_between(peaks[1], max(previous.peak, peaks[0]))
    first = max([0, *(level - PLAIN for _, level in previous.points)])
    return Detection(attacks, releases, chosen, first, fallback, peak)


def lowered(d: Detection, previous: Record) -> tuple[list[list[int]], list[list[int]]]:
    """The chosen candidates as steps up and steps down, [place, amount], within the limits."""
    up, down, gain = [], [], d.first_gain
    for i in range(ATTACKS):
        if i in d.chosen:
            amount = min(max(0, d.attacks.get(i, d.fallback)), MOST_UP - gain)
            gain += amount
            if amount > 0:
                up.append([i, amount])
                if len(up) == MOST_POINTS:
                    break
    limit, fallen = min(gain, MOST_DOWN), 0
    if up or previous.points:
        for g in range(RELEASES - 1, -1, -1):
            if fallen >= limit:
                break
            if ATTACKS + g not in d.chosen:
                continue
            amount = min(max(0, d.releases.get(g, 0)), limit - fallen)
            fallen += amount
            if amount > 0 and len(up) < MOST_POINTS:
                down.append([4 * g if g else 1, amount])
            if len(up) + len(down) == MOST_POINTS:
                break
    return up, down


def steps_of(up: list[list[int]], down: list[list[int]]) -> list[int]:
    """The gain of each of the 33 places: what the steps from there on add up to."""
    total = 0
    for step in reversed(down):
        total = step[1] = min(step[1] + total, MOST_DOWN)
    limit, total_up = 11 + total, 0
    for step in reversed(up):
        total_up = step[1] = min(step[1] + total_up, limit)
    out, at = [0] * (ATTACKS + 1), 0
    for place, amount in up:
        while at <= place:
            out[at] += amount
            at += 1
    at = ATTACKS
    for place, amount in down:
        while at >= place:
            out[at] += amount
            at -= 1
    return out


def record_of(gains: list[int], peak: float) -> Record | None:
    """The points at which the gain changes; none if a level can't be coded or there are too many."""
    total, last, points = 0, 0, []
    for location in range(ATTACKS - 1, -1, -1):
        total += gains[location] - gains[location + 1]
        if total == last:
            continue
        if not 0 <= total + PLAIN <= 15 or len(points) == MOST_POINTS:
            return None
        points.append((location, total + PLAIN))
        last = total
    points.reverse()
    while points and points[-1][1] == PLAIN:
        points.pop()
    return Record(points, peak)


def planned(peaks: list[float], before: float, previous: Record) -> Record | None:
    """A band's record from its window's peaks and the record before."""
    if any(level > 15 for _, level in previous.points):
        return None
    d = detected(peaks, before, previous)
    if not previous.points and not d.count:
        return Record([], d.peak)
    return record_of(steps_of(*lowered(d, previous)), d.peak)


def fall_to_lowest(record: Record) -> int:
    """From the highest level up to the lowest one (4 at most), down to that."""
    if not record.points:
        return 0
    levels = [level for _, level in record.points]
    low = min(PLAIN, *levels)
    at = levels.index(low) if low in levels and low < PLAIN else 0
    return max(levels[: at + 1]) - low


def bridge(window: np.ndarray, previous: list[Record], now: list[Record]) -> tuple[int, int] | None:
    """The point that the lowest band takes where only the band above it has some and nothing is loud."""
    if fall_to_lowest(now[1]) <= 1 or previous[0].points or now[0].points or previous[0].peak > LOUD:
        return None
    location = now[1].points[0][0]
    if (np.abs(window[BEFORE : BEFORE + 8 * (location + 1)]) > LOUD).any():
        return None
    return location, BRIDGE


def gained(window: np.ndarray, previous: Record, now: Record) -> np.ndarray | None:
    """The 512 samples behind the first 256, divided by the envelope of two records."""
    x = window[BEFORE : BEFORE + CHUNKS * CHUNK].astype(np.float32)
    if not previous.points and not now.points:
        return x
    scale = kernels.gain_scale(previous.points, now.points)
    return None if scale is None else x / scale


def continued(window: np.ndarray, previous: list[Record], now: list[Record]) -> list[Record] | None:
    """The records of a frame's bands, the lowest with its bridging point if that changes the signal."""
    point = bridge(window, previous, now)
    if point is None:
        return now
    other = Record([point], now[0].peak)
    old, new = gained(window, previous[0], now[0]), gained(window, previous[0], other)
    if old is None or new is None:
        return None
    a, b = new.astype(float), old.astype(float)
    energy, difference = float((a * a).sum()), float(((a - b) ** 2).sum())
    back = now[0].bits <= other.bits and (difference / energy if energy > 0 else 0.0) <= CHANGE
    return now if back else [other, *now[1:]]


def planned_records(windows: DataFrame, keys: list[str], frame: str = "frame_no", value: str = "windows") -> DataFrame:
    """``records`` of each frame's bands from ``windows``, an array of the bands' 768 samples; null where none can be coded, and
    the walk goes on from the record before."""
    rows = windows.select(*keys, F.col(frame).alias("frame_no"), F.col(value).alias("windows"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "frame_no")
    n = len(keys)
    point = T.StructType([T.StructField("location", T.IntegerType()), T.StructField("level", T.IntegerType())])
    record = T.StructType([T.StructField("points", T.ArrayType(point)), T.StructField("peak", T.FloatType())])
    schema = T.StructType([*rows.schema.fields[: n + 1], T.StructField("records", T.ArrayType(record))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, []
        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.array(row[-1], np.float32)
                if row[:n] != key:
                    key, state = row[:n], [Record() for _ in x]
                peaks, before = peaks_of(x)
                found = [planned(p, w, r) for p, w, r in zip(peaks.tolist(), before.tolist(), state, strict=True)]
                found = continued(x[0], state, found) if len(found) > 1 and None not in found else None if None in found else found
                if found:
                    state = found
                out.append([{"points": [{"location": a, "level": v} for a, v in r.points], "peak": r.peak} for r in found] if found else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(out, to_arrow_type(schema[-1].dataType))], schema.names)

    return rows.mapInArrow(run, schema)
