import numpy as np
import pytest

from sonoframe.operators import residual as R
from sonoframe.plans.dimensions import BAND_EDGES

SPECTRUM = (((np.arange(1024) * 73 + 19) % 2047 - 1023) * 0.375).astype(np.float32)
#: Bits, and error as a 64-bit image, of each mode at scale factor 23.
COSTS = {
    0: [(0, 4693931671639031808), (14, 4693933970290961508), (24, 4693932114934331126), (28, 4693910462055316133), (28, 4693899908231903824), (49, 4694073704291547510), (49, 4693938663204790821), (59, 4693934031933114357)],
    10: [(0, 4693692722744131584), (29, 4693675637484158814), (36, 4693657185730248172), (54, 4693687702382576915), (50, 4693670621714121326), (79, 4693557936059971576), (95, 4693649410159699331), (105, 4693703244997767758)],
    31: [(0, 4708637160637464576), (169, 4708635650432917329), (258, 4708642693433658288), (390, 4708619882779606932), (342, 4708665946737616376), (551, 4708657971707888354), (691, 4708624672862568697), (849, 4708638765556528679)],
}


def test_scales_and_symbols():
    images = [int(np.float32(R.quantizer_scale(m, 23)).view(np.uint32)) for m in R.MODES]
    assert images == [1047652260, 1053398622, 1057823861, 1060466107, 1066873030, 1075591919, 1084145667]
    assert [int(R.symbols(np.array([-137.625]), m, 23, 6)[0]) for m in R.MODES] == [31, 10, 52, 30, 29, 48, 21]


@pytest.mark.parametrize("band", COSTS)
def test_costs(band):
    lines = SPECTRUM[BAND_EDGES[band] : BAND_EDGES[band + 1]]
    for mode, want in enumerate(COSTS[band]):
        bits, error = R.cost(lines, mode, 23)
        assert (bits, int(np.float64(error).view(np.uint64))) == want


def test_neighbours():
    x = SPECTRUM[:8]
    n = R.neighbours(x, 1, 63)
    assert n["lower_mode"] is None and n["higher_scale"] is None
    assert n["higher_mode"] == R.cost(x, 2, 63) and n["lower_scale"] == R.cost(x, 1, 62)


def test_band_costs(spark):
    df = spark.createDataFrame([("a", SPECTRUM.tolist(), [23] * 32), ("b", [], [])], "k string, lines array<float>, f array<int>")
    got = {(r.band, r.mode): (r.bits, r.error) for r in R.band_costs(df, ["k"], "lines", "f").collect()}
    assert len(got) == 256
    for band, costs in COSTS.items():
        assert [got[band, m][0] for m in range(8)] == [c[0] for c in costs]


def test_many_spectra_cost_what_each_does():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 300, (40, 16)).astype(np.float32)
    factors = rng.integers(0, 64, 40)
    for mode in range(8):
        bits, error = R.costs(x, mode, factors)
        for i in range(40):
            assert (bits[i], error[i]) == R.cost(x[i], mode, int(factors[i]))
