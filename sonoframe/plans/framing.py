"""Framing and timeline of sample streams: which frame and place a sample falls into, padding, drain and trimming.

Samples carry their number in the stream, so a frame is arithmetic on it and one aggregation; nothing is collected per
stream. Alignment puts the first ``delay`` samples at the end of frame 0, later ones into frames of ``size`` from frame 1 on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.plans.dimensions import DELAY, DRAIN_FRAMES, FRAME


def number_samples(rows: DataFrame, stream: str, order: list) -> DataFrame:
    """Numbers the samples of each stream from 0, for sources whose rows carry no sample number."""
    return rows.withColumn("sample_no", (F.row_number().over(W.partitionBy(stream).orderBy(*order)) - 1).cast("long"))


def frame_of(n: Column, size: int = FRAME, delay: int = DELAY) -> Column:
    return F.when(n < delay, F.lit(0)).otherwise(1 + F.floor((n - delay) / size)).cast("long")


def place_of(n: Column, size: int = FRAME, delay: int = DELAY) -> Column:
    return F.when(n < delay, size - delay + n).otherwise(F.pmod(n - delay, F.lit(size))).cast("int")


def frames(samples: DataFrame, stream: str, values: list[str], size: int = FRAME, delay: int = DELAY) -> DataFrame:
    """One row per frame with an array per value, zero where no sample falls."""
    placed = samples.withColumn("frame_no", frame_of(F.col("sample_no"), size, delay)).withColumn("_place", place_of(F.col("sample_no"), size, delay))
    gathered = placed.groupBy(stream, "frame_no").agg(F.array_sort(F.collect_list(F.struct("_place", *values))).alias("_x"))
    # The places of a frame are consecutive, so padding is zeros before and behind.
    before = F.get("_x", F.lit(0))["_place"]

    def padded(v: str) -> Column:
        zero = F.lit(0).cast(dict(samples.dtypes)[v])
        return F.concat(F.array_repeat(zero, before), F.transform("_x", lambda s: s[v]), F.array_repeat(zero, size - before - F.size("_x"))).alias(v)

    return gathered.select(stream, "frame_no", F.size("_x").alias("n_samples"), *[padded(v) for v in values])


def with_drain(framed: DataFrame, stream: str, values: list[str], size: int = FRAME, drain: int = DRAIN_FRAMES) -> DataFrame:
    """Each stream's frames and its silent frames after them. Number 1 is a block of samples, so a stream that ends in its
    alignment frame has none."""
    kinds = dict(framed.dtypes)
    last = framed.groupBy(stream).agg(F.max("frame_no").alias("_last"))
    first = F.greatest(F.col("_last") + 1, F.lit(2).cast("long"))
    silent = last.select(
        stream,
        F.explode(F.sequence(first, first + drain - 1)).alias("frame_no"),
        F.lit(0).alias("n_samples"),
        *[F.array_repeat(F.lit(0), size).cast(kinds[v]).alias(v) for v in values],
    )
    return framed.unionByName(silent)


def emitted(framed: DataFrame) -> DataFrame:
    """The frames that come out: the first block behind the alignment frame is coded but not written."""
    return framed.where("frame_no <> 1").withColumn("out_no", F.when(F.col("frame_no") > 1, F.col("frame_no") - 1).otherwise(F.col("frame_no")))


def frame_count(n: Column, size: int = FRAME, delay: int = DELAY, drain: int = DRAIN_FRAMES) -> Column:
    """Frames written for a stream of n samples."""
    more = F.greatest(F.lit(0), F.ceil((n - delay) / F.lit(size)) - 1)
    return F.when(n > 0, 1 + drain + more).otherwise(0).cast("long")


def trims(decoded: DataFrame, stream: str, frame: str = "frame_no", samples: str = "sample_count", size: int = FRAME, align: int = FRAME, delay: int = DELAY) -> DataFrame:
    """``skip`` and ``take`` of each decoded frame: where its visible samples begin and how many there are. Stateless: the
    frame's number says how many samples came before it."""
    begin = F.col(frame) * size
    skip = F.least(F.lit(size), F.greatest(F.lit(0), F.lit(align + delay) - begin))
    done = F.greatest(F.lit(0), begin - (align + delay))
    return decoded.withColumn("skip", skip.cast("int")).withColumn("take", F.greatest(F.lit(0), F.least(size - skip, F.col(samples) - done)).cast("int"))


def incomplete(trimmed: DataFrame, stream: str, samples: str = "sample_count") -> DataFrame:
    """Each stream's visible samples against those it should have."""
    return trimmed.groupBy(stream).agg(F.max(samples).cast("long").alias("expected"), F.sum("take").cast("long").alias("visible")).withColumn("complete", F.col("expected") == F.col("visible"))


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: F.array(p["l"], p["r"])))


def deinterleave(values: Column, channel: int) -> Column:
    return F.filter(values, lambda _, i: F.pmod(i, F.lit(2)) == channel)
