import numpy as np
import pytest

from sonoframe.operators import layers as L

SPECTRUM = (((np.arange(1024) * 73 + 19) % 2047 - 1023) * 0.375).astype(np.float32)


def test_source_profile_hash():
    p = L.source_profile(SPECTRUM)
    h = 1469598103934665603
    for word in [*p.groups.tolist(), 0, *p.loud.tolist(), 0, *p.scale_factors.tolist(), p.total, *p.budgets.tolist()]:
        h = (h ^ (word & 0xFFFFFFFF)) * 1099511628211 % 2**64
    assert f"{h:016x}" == "b720b245f658a5fe"
    assert L.band_limit(p, 12, 357, True) == 28 and L.band_limit(p, 12, 357, False) == 12


def test_stereo_modes():
    s, hints = L.stereo_step(L.StereoState(0), [(0.0, 0.0)] * 4)
    assert s.modes == [-3] * 4 and hints == [0] * 4 and s.selector not in (0, 8)
    s, _ = L.stereo_step(L.StereoState(4), [(256_000.0, 0.0)] + [(0.0, 0.0)] * 3)
    assert s.modes[0] == 1
    s, _ = L.stereo_step(L.StereoState(0), [(5e12, 5e12), (1.0, 100.0), (100.0, 1.0), (1.0, 1.0)])
    assert s.modes == [3, 0, 1, -3]


def test_ratios_move_slowly():
    s, seen = L.StereoState(1), []
    for _ in range(60):
        s, _ = L.stereo_step(s, [(1.0, 30.0)] * 4)
        seen.append(s.ratios[0])
    assert all(0 < b - a <= L.STEP + 1e-6 for a, b in zip(seen, seen[1:], strict=False) if a != b)
    assert seen[-1] == L.slot_ratio(1.0, 30.0)


def test_stereo_plan(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f, rng.random(4).tolist(), rng.random(4).tolist()) for s in (1, 2) for f in range(5)]
    got = L.stereo_plan(spark.createDataFrame(rows, "stream_id long, frame_no long, left array<double>, right array<double>").repartition(3), 1).collect()
    assert len(got) == 10
    state = L.StereoState(1)
    for r in sorted((r for r in got if r.stream_id == 2), key=lambda r: r.frame_no):
        state, hints = L.stereo_step(state, list(zip(*[x for x in rows if x[:2] == (2, r.frame_no)][0][2:], strict=True)))
        assert (r.modes, r.hints, r.selector) == (state.modes, hints, state.selector)


def test_joined_layers():
    """Against the definition, line by line."""
    rng = np.random.default_rng(4)
    left, right = rng.normal(0, 1000, (2, 1024)).astype(np.float32)
    modes, hints, ratios, selectors = [3, 1, 0, -3], [1, 3, 3, 0], ([0.5, 0, 0, 0], [1.25, 0, 0, 0]), (5, 11)
    first, second = L.joined(left, right, modes, hints, 1, ratios, selectors)
    for slot in range(4):
        for t in (0, 3, 7, 8, 200):
            i, share = slot + 4 * t, max(8 - t, 0) / 8
            a, b = float(left[i]), float(right[i])
            if slot == 0:
                weight, scale = 1 + share * (2 - 1), 1.25 * 1 + share * (0.5 * 2 - 1.25)
                mid = (a + b) / 2
                assert first[i] == np.float32(mid) and second[i] == pytest.approx((a - weight * mid) / scale, rel=1e-6)
            else:
                at = {1: (5 + 8, 11 + 8), 2: ((5 ^ 8) + 8, (11 ^ 8) + 8), 3: (5 & 7, 11 & 7)}[slot]
                old, new = (L.SLOT_SCALES[k] for k in at)
                assert first[i] == pytest.approx((a + b) / (new + share * (old - new)), rel=1e-6)
                assert second[i] == right[i]


def test_slot_scales():
    assert L.slot_scale(3, 15) == L.SLOT_SCALES[7] and L.slot_scale(1, 2) == L.SLOT_SCALES[10] and L.slot_scale(0, 2) == L.SLOT_SCALES[18]
