"""Small fixed tables of the format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SAMPLE_RATE = 44100
CHANNELS = 2
FRAME = 1024
#: Samples that the coder delays a stream by.
DELAY = 69
DRAIN_FRAMES = 3

#: Bit rate, bytes a frame, syntax mode, mode flag of each profile.
PROFILES = [(66, 192, 2, 1), (105, 304, 1, 0), (132, 384, 1, 0)]
#: Line at which each quantization band begins, and the last one's end.
BAND_EDGES = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 288, 320, 352, 384, 416, 448, 480, 512, 576, 640, 704, 768, 896, 1024]
#: Largest level of each word length.
LEVELS = [0, 1, 2, 3, 4, 7, 15, 31]
#: Dead-zone ratio by time factor, and its divisor by word length.
DEAD_ZONE_NUMERATORS = [1, 1.0592537, 1.1220185, 1.1885022, 1.2589254, 1.3335215, 1.4125376, 1.4962356, 1.5848932, 1.678804, 1.7782794, 1.8836491, 1.9952623]
DEAD_ZONE_DIVISORS = [1, 3, 5, 7, 9, 15, 31, 63]
#: Activity thresholds of the residual bands.
ACTIVITY = [7, 5, 5, 4, 4, 4, 4, 3, 3, 3, 3, 4, 5, 5, 5, 6, 6, 7, 7, 8, 10, 13, 17, 22, 28, 35, 49, 74, 109, 155, 250, 441]
#: Scale-factor steps of the residual modes, and the least bits of a pair of lines.
MODE_STEPS, PAIR_BITS = [3, 5, 7, 9, 12, 15, 18], [1, 2, 2, 2, 4, 6, 6]
#: Spectral scales: thirds of an octave, one at index 15.
SCALES = (2.0 ** ((np.arange(64) - 15) / 3)).astype(np.float32)
#: How a band's level spreads to the bands above and below (as 64-bit images).
SPREAD_UP = np.array([0x3FF0000000000000, 0x3FA030DC4EA03A72, 0x3F50624DD2F1A9FC, 0x3F009456549BE1BD], np.uint64).view(np.float64)
SPREAD_DOWN = np.array([0x3FF0000000000000, 0x3F69E7C6E43390B7, 0x3EE4F8B588E368F1], np.uint64).view(np.float64)
#: Smallest positive double, so that no masking floor is zero.
TINY = 2.2250738585072014e-308


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(b, n, s, f, CHANNELS, FRAME, SAMPLE_RATE) for b, n, s, f in PROFILES]
    return spark.createDataFrame(rows, "bitrate_kbps int, bytes_per_frame int, syntax_mode int, mode_flag int, channels int, frame_samples int, sample_rate int")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False))], "band int, first int, last int")
