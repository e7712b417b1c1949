"""Filter bank and block transform over tables of frames.

Both look back one frame only, so a frame's predecessor comes to it by ``lag`` and the kernel then runs over batches of
rows that need nothing else. Long streams are cut into chunks with their last frame repeated at the head of the next, so
no window partition grows with a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.operators import encoding, kernels, synthesis

#: Frames of a stream that are looked at together.
CHUNK = 4096


def with_previous(frames: DataFrame, keys: list[str], value: str, frame: str = "frame_no") -> DataFrame:
    """``before``: the value of the frame before, null for a stream's first."""
    own = F.struct(F.floor(F.col(frame) / CHUNK).alias("chunk"), F.lit(True).alias("mine"))
    ahead = F.struct(F.floor((F.col(frame) + 1) / CHUNK).alias("chunk"), F.lit(False).alias("mine"))
    copies = F.when(F.pmod(F.col(frame) + 1, F.lit(CHUNK)) == 0, F.array(own, ahead)).otherwise(F.array(own))
    rows = frames.withColumn("_c", F.explode(copies))
    w = W.partitionBy(*keys, F.col("_c.chunk")).orderBy(frame)
    return rows.withColumn("before", F.lag(value).over(w)).where("_c.mine").drop("_c")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, zeros for null rows."""
    out = np.zeros((len(column), width), np.float32)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def subbands(frames: DataFrame, keys: list[str], value: str = "samples", frame: str = "frame_no") -> DataFrame:
    """Four bands (arrays b0 to b3) of each 1024-sample frame of each stream."""
    rows = with_previous(frames.select(*keys, frame, value), keys, value, frame).select(*keys, frame, value, "before")
    n = len(keys) + 1
    schema = T.StructType([*rows.schema.fields[:n], *[T.StructField(f"b{i}", T.ArrayType(T.FloatType())) for i in range(4)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = kernels.four_bands(_rows(b.column(n + 1), 1024), _rows(b.column(n), 1024))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[_lists(bands[:, i]) for i in range(4)]], schema.names)

    return rows.mapInArrow(run, schema)


def layered_subbands(frames: DataFrame, keys: list[str], value: str = "samples", frame: str = "frame_no") -> DataFrame:
    """``lines``: interleaved bands (band = place mod 4) of the lower bit rates' filter bank, of each 1024-sample frame."""
    rows = with_previous(frames.select(*keys, frame, value), keys, value, frame).select(*keys, frame, value, "before")
    n = len(keys) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("lines", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _lists(kernels.layered_bands(_rows(b.column(n), 1024), _rows(b.column(n + 1), 1024)))], schema.names)

    return rows.mapInArrow(run, schema)


GAINS = "array<array<struct<location:int,level:int>>>"


def _scales(now: list | None, before: list | None) -> np.ndarray:
    """Envelopes (4 x 512) of a frame's gain records and those of the frame before; ones without points."""
    out = np.ones((4, 512), np.float32)
    for band in range(4):
        pair = [[(p["location"], p["level"]) for p in (r[band] if r and band < len(r) else [])] for r in (before, now)]
        if pair[0] or pair[1]:
            scale = kernels.gain_scale(*pair)
            if scale is None:
                raise ValueError("a gain level is above 15")
            out[band] = scale
    return out


def gained_spectra(bands: DataFrame, keys: list[str], gains: str = "gains", frame: str = "frame_no") -> DataFrame:
    """As spectra, with each band's window divided by its gain envelope; ``gains`` holds a record for each band (GAINS)."""
    both = F.struct(F.concat("b0", "b1", "b2", "b3").alias("x"), F.col(gains).alias("g"))
    rows = with_previous(bands.select(*keys, frame, both.alias("now")), keys, "now", frame)
    rows = rows.select(*keys, frame, "now.x", "now.g", F.col("before.x").alias("x1"), F.col("before.g").alias("g1"))
    n = len(keys) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("lines", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = (_rows(b.column(i), 1024).reshape(-1, 4, 256) for i in (n, n + 2))
            pairs = zip(b.column(n + 1).to_pylist(), b.column(n + 3).to_pylist(), strict=True)
            scales = np.array([_scales(g, g1) for g, g1 in pairs], np.float32).reshape(-1, 4, 512)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _lists(kernels.spectrum(np.concatenate([before, now], 2), scales))], schema.names)

    return rows.mapInArrow(run, schema)


def spectra(bands: DataFrame, keys: list[str], frame: str = "frame_no") -> DataFrame:
    """1024 lines of each frame, from its bands and those of the frame before, without gain control."""
    rows = with_previous(bands.select(*keys, frame, F.concat("b0", "b1", "b2", "b3").alias("now")), keys, "now", frame).select(*keys, frame, "now", "before")
    n = len(keys) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("lines", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = (_rows(b.column(i), 1024).reshape(-1, 4, 256) for i in (n, n + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _lists(kernels.spectrum(np.concatenate([before, now], 2)))], schema.names)

    return rows.mapInArrow(run, schema)


def restored(frames: DataFrame, keys: list[str], value: str = "samples", frame: str = "frame_no", near: float = 2e-3) -> DataFrame:
    """Whether each stream's frames, taken apart by filter bank and transform and put together again, come back within
    ``near`` of their peak: (keys, frames, restored)."""
    rows = frames.select(*keys, F.col(frame).alias("frame_no"), F.col(value).alias("samples"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("frames", T.LongType()), T.StructField("restored", T.BooleanType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("frame_no")["samples"].tolist()).astype(np.float32)
        x = np.concatenate([x, np.zeros((2, x.shape[1]), np.float32)])  # what comes late
        lines = (encoding.spectra_of(x[:, None])[:, 0] * np.float32(synthesis.FULL / 2)).reshape(len(x), 4, 256)
        earlier = lambda a: np.concatenate([np.zeros_like(a[:1]), a[:-1]])
        old, one = earlier(lines), np.ones(len(x), np.float32)
        bands = np.stack([synthesis.overlapped(lines[:, u], old[:, u], one, u % 2 == 1) for u in range(4)], 1)
        back = synthesis.synthesized(bands, earlier(bands)).ravel()[synthesis.LATE :]
        n = len(back)
        return pd.DataFrame([(*key, len(x) - 2, bool(np.abs(back - x.ravel()[:n]).max() <= near * max(1.0, np.abs(x).max())))], columns=schema.names)

    return rows.groupBy(*keys).applyInPandas(run, schema)
