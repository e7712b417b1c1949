"""Pricing of residual bands: what a mode and a scale factor cost in bits and leave as error.

A mode's symbols are the lines times the quantizer's scale, rounded to even, in as many low bits as the mode has; symbols
that the codebook lacks are coded as zero. Errors are summed in double precision, line after line."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sonoframe.plans.codebooks import codebook
from sonoframe.plans.dimensions import BAND_EDGES, LEVELS, SCALES

#: Images of the quantizers' scales before their exponent is taken off, one for each third of an octave.
SCALE_IMAGES = [
    1106372516, 1108894712, 1111490560, 1112118878, 1115552754, 1117782016, 1116544117, 1118947831, 1121976320, 1119186363,
    1122276852, 1125122048, 1125593286, 1128168694, 1131413504, 1134312175, 1136973430, 1140326400, 1142865923, 1145570101, 1148977152,
]
#: Fixed value: the image that stands below the first of them.
ZERO_IMAGE = 0x0005F800
SYMBOL_BITS = [0, 2, 3, 3, 4, 4, 5, 6]
MODES = range(1, 8)


def checked(band: int, mode: int, scale_factor: int) -> None:
    if not (0 <= band < len(BAND_EDGES) - 1 and mode in MODES and 0 <= scale_factor < len(SCALES)):
        raise ValueError(f"no residual of band {band}, mode {mode}, scale factor {scale_factor}")


def quantizer_scale(mode: int, scale_factor: int) -> np.float32:
    grown = scale_factor * 43  # a third of it in steps of 128
    third = 3 * ((grown >> 7) + mode) - scale_factor
    image = ZERO_IMAGE if third <= 0 else SCALE_IMAGES[min(third, len(SCALE_IMAGES)) - 1]
    return np.array([(image - ((grown << 16) & 0x7F800000)) & 0xFFFFFFFF], np.uint32).view(np.float32)[0]


def symbols(lines: np.ndarray, mode: int, scale_factor: int, bits: int | None = None) -> np.ndarray:
    """Low bits of the rounded lines."""
    biased = lines.astype(np.float32).astype(np.float64) * float(quantizer_scale(mode, scale_factor)) + 12582912.0
    return biased.astype(np.float32).view(np.uint32).astype(np.int64) & (1 << (bits or SYMBOL_BITS[mode])) - 1


@lru_cache(8)
def tables(mode: int) -> tuple[np.ndarray, np.ndarray]:
    """Code length and reconstruction of every symbol; mode 1 by pairs of two bits, with two reconstructions."""
    book, n = codebook(0, mode), SYMBOL_BITS[mode]
    step = np.float64(LEVELS[mode] + 0.5)
    size = 1 << (2 * n if mode == 1 else n)
    zero = book[(0, 0) if mode == 1 else (0,)][1]
    length, value = np.full(size, zero), np.zeros((size, 2 if mode == 1 else 1), np.float32)
    for values, (_, bits) in book.items():
        at = 0
        for v in values:
            at = at << n | v & (1 << n) - 1
        length[at], value[at] = bits, (np.array(values) / step).astype(np.float32)
    return length, value


def cost(lines: np.ndarray, mode: int, scale_factor: int) -> tuple[int, float]:
    """Bits, with the scale factor's six, and squared error of a band's lines."""
    x = lines.astype(np.float32).astype(np.float64)
    if mode == 0:
        return 0, float(np.cumsum(x * x)[-1])
    s = symbols(lines, mode, scale_factor)
    if mode == 1:
        s = s[0::2] * 4 + s[1::2]
    length, value = tables(mode)
    back = (value[s] * SCALES[scale_factor]).ravel().astype(np.float64)
    return 6 + int(length[s].sum()), float(np.cumsum((x - back) ** 2)[-1])


def costs(x: np.ndarray, mode: int, scale_factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and squared errors, as ``cost``, of one band of many spectra (rows x lines), each under its own scale factor."""
    x = x.astype(np.float64)
    if mode == 0:
        return np.zeros(len(x), np.int64), np.cumsum(x * x, axis=1)[:, -1]
    scales = np.array([quantizer_scale(mode, s) for s in range(64)], np.float32).astype(np.float64)[scale_factors]
    s = (x * scales[:, None] + 12582912.0).astype(np.float32).view(np.uint32).astype(np.int64) & (1 << SYMBOL_BITS[mode]) - 1
    if mode == 1:
        s = s[:, 0::2] * 4 + s[:, 1::2]
    length, value = tables(mode)
    back = (value[s] * SCALES[scale_factors][:, None, None]).reshape(len(x), -1).astype(np.float64)
    return 6 + length[s].sum(1), np.cumsum((x - back) ** 2, axis=1)[:, -1]


def neighbours(lines: np.ndarray, mode: int, scale_factor: int) -> dict[str, tuple[int, float] | None]:
    """Costs of a mode or a scale factor one lower or higher, none outside their ranges."""
    out: dict[str, tuple[int, float] | None] = {}
    for d, name in ((-1, "lower"), (1, "higher")):
        out[f"{name}_mode"] = cost(lines, mode + d, scale_factor) if mode + d in MODES else None
        out[f"{name}_scale"] = cost(lines, mode, scale_factor + d) if mode and 0 <= scale_factor + d <= 63 else None
    return out


def band_costs(spectra: DataFrame, keys: list[str], lines: str, factors: str) -> DataFrame:
    """bits and error for each band and mode of spectra with an array of scale factors."""
    rows = spectra.select(*keys, lines, factors)
    n = len(keys)
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("band", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, factors = (b.column(i).to_pylist() for i in (n, n + 1))
            at, columns = [], []
            for band in range(max((len(s or []) for s in factors), default=0)):
                rows = np.array([i for i, s in enumerate(factors) if s and len(s) > band], np.int64)
                x = np.array([found[i][BAND_EDGES[band] : BAND_EDGES[band + 1]] for i in rows], np.float32)
                scale = np.array([factors[i][band] for i in rows], np.int64)
                for mode in (0, *MODES):
                    bits, error = costs(x, mode, scale)
                    at.append(rows)
                    columns.append((np.full(len(rows), band), np.full(len(rows), mode), bits, error))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            parts = [np.concatenate([c[k] for c in columns]) if columns else np.zeros(0) for k in range(4)]
            taken = [c.take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(parts, kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema)
