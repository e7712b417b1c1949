"""Analysis of the two layers of the lower bit rates: residual source profile, stereo modes and ratios.

Modes and ratios depend on the frame before (hysteresis, a limited rate of change), so a stream's frames are walked in order,
over a handful of numbers each: the energies come from a parallel aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sonoframe.plans.dimensions import ACTIVITY, BAND_EDGES

F32 = np.float32
GROUP = 4
SLOTS = 4
#: Limits of a balanced slot, of slots that are scaled by ratio, and of silence.
BALANCED, PRIMARY, SECONDARY, SILENCE = float(F32(19.697716)), 2304.0, 96.0, 4791991795712.0
#: Fixed values, as 32-bit or 64-bit images: bounds and steps of the ratios.
UPPER, FALLBACK, MAPPING = (float(np.array([x], np.uint32).view(np.float32)[0]) for x in (1132462080, 1070945621, 1071059752))
LOWER, STEP = (float(np.array([x], np.uint64).view(np.float64)[0]) for x in (4616054510065937285, 4587366580439587226))


@dataclass
class SourceProfile:
    groups: np.ndarray  # scale estimate of every four lines
    loud: np.ndarray  # groups above 7 up to the end of each band
    scale_factors: np.ndarray
    total: int
    budgets: np.ndarray  # budget from which a band is worth coding in mono, -1 if it sets no new peak


def scale_estimates(lines: np.ndarray) -> np.ndarray:
    """Scale estimate of every four lines, from the largest one's exponent (thirds of an octave) and mantissa."""
    key = (lines.astype(F32).view(np.uint32) << np.uint32(1)).reshape(-1, GROUP).max(1).astype(np.int64)
    mantissa = key & 0xFFFFFF
    # The exponent and mantissa are those of the doubled image: eight bits, then 24.
    out = 3 * (key >> 24) - np.where(mantissa <= 0x965FE9, 0x16C, 0x16B) - (mantissa < 0x428A30)
    return np.where((out >= 0) & (out < 64), out, 0)


def source_profile(lines: np.ndarray) -> SourceProfile:
    groups = scale_estimates(lines)
    edges = np.array(BAND_EDGES) // GROUP
    peaks = np.maximum.reduceat(groups, edges[:-1])
    sums = np.add.reduceat(groups, edges[:-1])
    loud = np.cumsum(groups > 7)[edges[1:] - 1]
    before = np.maximum.accumulate(np.concatenate([[0], peaks[:-1]]))
    record = peaks > before
    quiet = ~record & ((peaks < 3) | (sums < np.array(ACTIVITY)))
    band = np.arange(32)
    heavy = ((np.array(BAND_EDGES[:-1]) >> 7) & 1 == 1) & (band <= 21)
    budgets = np.where(record, loud * np.where(heavy, 16, 8), -1)
    return SourceProfile(groups, loud, np.where(quiet, 0, peaks), int(np.where(quiet, 0, sums).sum()), budgets)


def band_limit(p: SourceProfile, limit: int, budget: int, mono: bool) -> int:
    """Bands to code: a mono layer takes more if its budget allows the bands that set new peaks."""
    if not mono:
        return limit
    worth = np.flatnonzero((p.budgets >= 0) & (budget > p.budgets))
    return max([limit, *(min(b + 2, 32) if b > 26 else 28 for b in worth.tolist())])


#: Scales of a slot's sum by selector (as 32-bit images): balanced, left dominant, right dominant.
SLOT_SCALES = np.array([
    1068827891, 1069965582, 1070980006, 1071865150, 1072609823, 1073195371, 1073590838, 1073741824, 0, 1049774373, 1058162981, 1062956471,
    1066551589, 1068948334, 1071345079, 1073741824, 1077216499, 1077155817, 1076971869, 1076658640, 1076204941, 1075592116, 1074789211, 1073741824,
], np.uint32).view(F32).astype(np.float64)
#: Weights of a mode, for the middle and, one on, for the ratio.
MODE_WEIGHTS = [0, 2, 2, 1, 1]
RAMP = 8


def slot_scale(mode: int, selector: int) -> float:
    """Scale of an unscaled slot's sum; a dominant side has the selector's own or the other half of the table."""
    at = {3: selector & 7, 1: selector + 8, 0: (selector ^ 8) + 8}.get(mode, selector)
    return float(SLOT_SCALES[at])


def joined(left: np.ndarray, right: np.ndarray, modes: list[int], hints: list[int], scaled: int, ratios: tuple[list[float], list[float]], selectors: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both layers' 1024 interleaved lines out of the two channels': a scaled slot's middle and its scaled difference, or a
    slot's sum over its scale. ``ratios`` and ``selectors`` are the frame's before and this one's: the first eight lines of a
    slot move from one to the other. Sums are in double precision, and stored in single."""
    first, second = left.astype(F32).copy(), right.astype(F32).copy()
    back = np.maximum(RAMP - np.arange(len(left) // SLOTS), 0) / RAMP  # one at the start, none behind the ramp
    with np.errstate(divide="ignore", invalid="ignore"):
        for slot in range(SLOTS):
            a, b = (x[slot::SLOTS].astype(np.float64) for x in (left.astype(F32), right.astype(F32)))
            mode = abs(modes[slot])
            if slot < scaled:
                weight, old_weight = MODE_WEIGHTS[mode], MODE_WEIGHTS[hints[slot]]
                scale = float(F32(MODE_WEIGHTS[mode + 1] * F32(ratios[1][slot])))
                old_scale = ratios[0][slot] * MODE_WEIGHTS[hints[slot] + 1]
                middle = (a + b) * 0.5
                first[slot::SLOTS] = middle
                second[slot::SLOTS] = (a - (weight + back * (old_weight - weight)) * middle) * (1 / (scale + back * (old_scale - scale)))
            else:
                scale, old_scale = slot_scale(mode, selectors[1]), slot_scale(mode, selectors[0])
                first[slot::SLOTS] = (1 / (scale + back * (old_scale - scale))) * (a + b)
    return first, second


@dataclass
class StereoState:
    scaled: int = 0  # slots that a ratio scales
    modes: list[int] = field(default_factory=lambda: [0] * SLOTS)
    ratios: list[float] = field(default_factory=lambda: [0.0] * SLOTS)
    selector: int = 0


def slot_mode(left: float, right: float, before: int, scaled: bool) -> int:
    """1 left dominant, 0 right dominant, 3 balanced, -3 balanced and silent."""
    low, high = BALANCED, BALANCED
    if scaled:
        low, high = {0: (SECONDARY, PRIMARY), 1: (PRIMARY, SECONDARY)}.get(before, (PRIMARY, PRIMARY))
    if not low * left >= right:
        return 0
    if not high * right >= left:
        return 1
    return 3 if left + right >= SILENCE else -3


def slot_ratio(left: float, right: float) -> float:
    """Ratio of a balanced slot from its energies in single precision: between the bounds the difference over the sum,
    beyond them one or the fallback."""
    left, right = float(F32(left)), float(F32(right))
    for a, b in ((left, right), (right, left)):  # b is the louder one
        if not (a * LOWER >= b or b >= UPPER * a):
            return float(F32((b - a) * MAPPING / (b + a)))
    if left == 0 or right == 0 or np.isnan(left) or np.isnan(right):
        return 1.0
    if right * UPPER <= left:
        return FALLBACK
    return 1.0 if left * UPPER > right else FALLBACK


def stereo_step(s: StereoState, energies: list[tuple[float, float]]) -> tuple[StereoState, list[int]]:
    """The state after a frame, and the hints (the modes before it)."""
    modes, ratios = [], []
    total = [float(F32(0.1)), float(F32(0.1))]
    for i, (left, right) in enumerate(energies):
        scaled = i < s.scaled
        mode = slot_mode(left, right, s.modes[i], scaled)
        modes.append(mode)
        if not scaled and abs(mode) == 3:
            total = [t * 16 + float(F32(e)) for t, e in zip(total, (left, right), strict=True)]
        ratio = s.ratios[i]
        if scaled:
            ratio = slot_ratio(left, right) if abs(mode) == 3 else 1.0
            if ratio - s.ratios[i] >= STEP:
                ratio = float(F32(s.ratios[i] + STEP))
            if s.ratios[i] - ratio >= STEP:
                ratio = float(F32(s.ratios[i] - STEP))
        ratios.append(ratio)
    louder_left = total[0] > total[1]
    share = min(total) * (1.0 / (total[0] + total[1]))
    level = int(np.array([share * 14 + 12582912.0]).astype(F32).view(np.uint32)[0]) & 7
    selector = max(level, 1) + 8 * louder_left
    return StereoState(s.scaled, modes, ratios, selector), [abs(m) for m in s.modes]


def stereo_plan(energies: DataFrame, scaled: int = 0) -> DataFrame:
    """Modes, hints, ratios and selector of each frame; ``energies``: stream_id, frame_no, and arrays left and right. Rows come
    sorted and the walk keeps one state, so its memory doesn't grow with a stream."""
    rows = energies.select("stream_id", "frame_no", "left", "right").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    lists = [T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("modes", "hints")]
    schema = T.StructType([*rows.schema.fields[:2], *lists, T.StructField("ratios", T.ArrayType(T.DoubleType())), T.StructField("selector", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, s = None, StereoState(scaled)
        for b in batches:
            out = []
            for of, left, right in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if of != stream:
                    stream, s = of, StereoState(scaled)
                s, hints = stereo_step(s, list(zip(left, right, strict=True)))
                out.append((s.modes, hints, s.ratios, s.selector))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]], schema.names)

    return rows.mapInArrow(walk, schema)
