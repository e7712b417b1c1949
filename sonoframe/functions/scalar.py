"""Scalar arithmetic of the frame coder as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.plans.dimensions import BAND_EDGES, DEAD_ZONE_DIVISORS, DEAD_ZONE_NUMERATORS, LEVELS, MODE_STEPS, PAIR_BITS, SCALES

FULL_SCALE = 32768
#: The root of two in single precision.
ROOT_TWO = float(np.float32(2**0.5))


def f32(x: Column) -> Column:
    return x.cast("float")


def scale_pcm(samples: Column) -> Column:
    """Normalised samples to the codec's range."""
    return F.transform(samples, lambda x: f32(x * F.lit(float(FULL_SCALE))))


def normalize_pcm(samples: Column) -> Column:
    return F.transform(samples, lambda x: f32(x / F.lit(float(FULL_SCALE))))


def float_to_pcm16(x: Column) -> Column:
    """16-bit sample: ties to even, at most 32767; what is not a number or too small becomes -32767."""
    scaled = f32(x * F.lit(float(FULL_SCALE))).cast("double")
    low = F.isnan(scaled) | (scaled <= -32767)
    return F.when(low, -32767).when(scaled > 32767, 32767).otherwise(F.bround(scaled).cast("int")).cast("int")


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), x))


def unordered_less(a: Column, b: Column) -> Column:
    """a < b, and true if either is not a number."""
    return F.isnan(a) | F.isnan(b) | (a < b)


def unordered_less_equal(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b) | (a <= b)


def truncate_to_int32(x: Column) -> Column:
    """Towards zero; what is not a number or out of range becomes the lowest value."""
    inside = (x > -2147483649.0) & (x < 2147483648.0) & ~F.isnan(x)
    return F.when(inside, F.when(inside, x).otherwise(F.lit(0.0)).cast("int")).otherwise(F.lit(-2147483648))


def clamp_int16(x: Column) -> Column:
    return clamp(x, -32768, 32767)


def clamp_symbol(x: Column, word_length: Column) -> Column:
    levels = F.get(F.array(*[F.lit(v) for v in LEVELS]), word_length)
    return clamp(x, -levels, levels)


def band_width(band: Column) -> Column:
    return F.get(F.array(*[F.lit(z - a) for a, z in zip(BAND_EDGES, BAND_EDGES[1:], strict=False)]), band)


def step_of_mode(mode: Column) -> Column:
    """Scale-factor steps of a residual mode, none for an uncoded band."""
    return F.when(mode <= 0, F.lit(0)).otherwise(F.get(F.array(*[F.lit(v) for v in MODE_STEPS]), clamp(mode, 1, len(MODE_STEPS)) - 1))


def least_band_bits(mode: Column, width: Column) -> Column:
    """Bits that a coded residual band takes at least: its scale factor and the shortest code of each pair of lines."""
    return 6 + F.shiftright(width, 1) * F.get(F.array(*[F.lit(v) for v in PAIR_BITS]), mode - 1)


def log2_exponent(x: Column) -> Column:
    """Floor of the logarithm to base 2 of a positive number."""
    guess = F.floor(F.log2(x)).cast("int")
    # A logarithm may be off by a rounding at powers of two.
    return guess + F.when(F.pow(F.lit(2.0), guess + 1) <= x, 1).otherwise(0) - F.when(F.pow(F.lit(2.0), guess) > x, 1).otherwise(0)


def gain_steps_for_ratio(ratio: Column) -> Column:
    """Whole gain steps of a single-precision ratio: the exponent of the ratio times the root of two."""
    return log2_exponent(f32(f32(ratio) * f32(F.lit(ROOT_TWO))).cast("double"))


def bounded_gain_step(step: Column, used: Column, limit: Column | int) -> Column:
    top = limit if isinstance(limit, Column) else F.lit(limit)
    return F.least(F.greatest(F.lit(0), step), top - used)


def float32_to_bits(x: Column) -> Column:
    """The image of a single-precision number as a whole number, from its sign, exponent and fraction."""
    v = f32(x).cast("double")
    size = F.abs(v)
    exponent = F.greatest(log2_exponent(F.when(size > 0, size).otherwise(F.lit(1.0))), F.lit(-126))
    fraction = size / F.pow(F.lit(2.0), exponent)
    normal = (exponent + 127).cast("long") * 8388608 + ((fraction - 1) * 8388608).cast("long")
    # Below the least normal number the exponent's field is zero.
    small = (size * F.pow(F.lit(2.0), F.lit(149))).cast("long")
    finite = F.when(size < 2.0**-126, small).otherwise(normal)
    image = F.when(F.isnan(v), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).otherwise(F.when(F.isnan(v) | (size == float("inf")), F.lit(0)).otherwise(finite))
    return image + F.when(v < 0, F.lit(2147483648)).otherwise(F.lit(0))


def float32_from_bits(image: Column) -> Column:
    """The single-precision number of an image."""
    exponent, fraction = F.shiftright(image, 23).bitwiseAND(255), image.bitwiseAND(0x7FFFFF)
    size = F.when(exponent == 0, fraction * 2.0**-149).otherwise((1 + fraction / 8388608.0) * F.pow(F.lit(2.0), exponent - 127))
    size = F.when(exponent < 255, size).when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return f32(F.when(image.bitwiseAND(1 << 31) != 0, -size).otherwise(size))


def reconstruction_error(lines: Column, symbols: Column, scale: Column, word_length: Column) -> Column:
    """Squared error of a band's lines against what its symbols stand for."""
    levels = F.get(F.array(*[F.lit(v) for v in LEVELS]), word_length)
    back = lambda q: q * scale.cast("double") / (levels + F.lit(0.5))
    errors = F.zip_with(lines, symbols, lambda x, q: (x.cast("double") - back(q)) * (x.cast("double") - back(q)))
    return F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)


def frame_error(left: Column, right: Column, size: int) -> Column:
    """What is wrong with a frame's two channels, if anything."""
    n, m = F.coalesce(F.size(left), F.lit(-1)), F.coalesce(F.size(right), F.lit(-1))
    return F.when((n < 0) | (m < 0), "missing channel").when(n != m, "unequal channels").when(n != size, "incomplete")


def coded_frame_error(data: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(data.isNull() | (F.length(data) != size), F.concat(F.lit("a frame takes "), size.cast("string"), F.lit(" bytes")))


def normalized_error(error: Column, energy: Column) -> Column:
    return F.when(energy > 0, error / energy).otherwise(F.lit(0.0))


def gain_log2_round(x: Column) -> Column:
    """Whole power of two nearest to x, towards zero after adding a half."""
    return (F.log10(F.greatest(x, F.lit(1e-20))) / F.log10(F.lit(2.0)) + 0.5).cast("int")


def scale_at(index: Column) -> Column:
    """Spectral scale of an index, infinite outside 0 to 63."""
    table = F.array(*[F.lit(float(s)) for s in SCALES])
    return F.when(index.between(0, 63), F.get(table, index)).otherwise(F.lit(float("inf")))


def scale_index(magnitude: Column) -> Column:
    """First index whose scale is above the magnitude, at most 63."""
    table = F.array(*[F.lit(float(s)) for s in SCALES[:63]])
    return F.size(F.filter(table, lambda s: s <= magnitude.cast("double")))


def dead_zone(time_factor: Column, word_length: Column) -> Column:
    """Magnitude up to which a normalised value is coded as zero."""
    top = F.array(*[F.lit(float(x)) for x in DEAD_ZONE_NUMERATORS])
    low = F.array(*[F.lit(float(x)) for x in DEAD_ZONE_DIVISORS])
    return F.when(time_factor == 0, F.lit(0.0)).otherwise(f32(F.get(top, clamp(time_factor, 1, 12)) / F.get(low, word_length)).cast("double"))


def quantize(x: Column, word_length: Column, zero_to: Column) -> Column:
    """Symbol of a normalised value: dead zone, then rounding to 2L + 1 levels.

    A value beyond the 32-bit range saturates before 31 is taken off, which wraps the lowest value to the top level."""
    levels = F.get(F.array(*[F.lit(v) for v in LEVELS]), word_length)
    biased = x.cast("double") * (levels + F.lit(0.5)) + F.lit(31.5)
    whole = F.when(F.isnan(biased) | (biased <= -2147483648.0), F.lit(-2147483648)).when(biased >= 2147483647.0, F.lit(2147483647)).otherwise(F.least(F.greatest(biased, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("long"))
    off = whole.cast("long") - 31
    wrapped = F.when(off < -2147483648, off + 4294967296).otherwise(off)
    return F.when(F.abs(x) <= zero_to, F.lit(0)).otherwise(clamp(wrapped, -levels.cast("long"), levels.cast("long"))).cast("int")


def tonality(energy: Column, peak: Column, width: Column) -> Column:
    """0 for a flat band to 1 for a single line."""
    share = F.log(F.greatest(F.lit(1.0), peak * width / energy)) / F.log(width.cast("double"))
    return F.when((energy <= 0) | (width <= 1), F.lit(0.0)).otherwise(clamp(share, 0.0, 1.0))


def gain_record_valid(levels: Column, locations: Column) -> Column:
    """At most 7 points, levels 0 to 15, locations 0 to 31 and ascending, neighbours at different levels."""
    n = F.size(levels)
    pairs = F.when(n < 2, F.lit(True)).otherwise(
        F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get(locations, i - 1) < F.get(locations, i)) & (F.get(levels, i - 1) != F.get(levels, i)))
    )
    return (n <= 7) & (n == F.size(locations)) & F.forall(levels, lambda x: x.between(0, 15)) & F.forall(locations, lambda x: x.between(0, 31)) & pairs


def gain_record_bits(levels: Column) -> Column:
    """A 3-bit count, then 4 bits for the level and 5 for the location of each point."""
    return F.lit(3) + 9 * F.size(levels)


def spectrum_header_bits(word_lengths: Column) -> Column:
    """5 bits for the count, 1 for the table, 3 a band, and 6 for the scale of each coded band."""
    return F.lit(6) + 3 * F.size(word_lengths) + 6 * F.size(F.filter(word_lengths, lambda w: w > 0))


def is_attack(levels: Column) -> Column:
    """Whether a record's levels, seen from level 4, spread over 3 steps or more."""
    seen = F.concat(F.array(F.lit(4)), levels)
    return F.array_max(seen) - F.array_min(seen) >= 3


def active_bands(word_lengths: Column) -> Column:
    """Bands up to the last one with a word length."""
    return F.coalesce(F.array_max(F.transform(word_lengths, lambda v, i: F.when(v > 0, i + 1).otherwise(0))), F.lit(0))


def budgets_around(seed: Column, most: int, steps: tuple[int, ...] = (0, -64, -128, -256, -512, -1024)) -> Column:
    """Budgets to try around a seed, within bounds, each once."""
    return F.array_distinct(F.transform(F.array(*[F.lit(d) for d in steps]), lambda d: clamp(seed + d, 0, most).cast("long")))


def frame_bytes(frame_no: Column, bytes_per_frame: Column | int, header: int = 80) -> tuple[Column, Column]:
    """First byte of a frame in a coded file, and the one behind it."""
    size = bytes_per_frame if isinstance(bytes_per_frame, Column) else F.lit(bytes_per_frame)
    return header + size * frame_no, header + size * (frame_no + 1)


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def float_bits(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.float32).view(np.uint32)
