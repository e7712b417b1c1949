"""Spectral analysis over arrays of lines. A band is a slice of its row's array, so no line is exploded or shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.scalar import scale_at, scale_index, tonality
from sonoframe.plans.dimensions import BAND_EDGES, SPREAD_DOWN, SPREAD_UP, TINY


def in_bands(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """One row per band that the spectrum covers: ``xs``, the band's lines, and ``width``."""
    all_bands = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(a).alias("first"), F.lit(z - a).alias("width")) for i, (a, z) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False))])
    there = F.filter(all_bands, lambda b: b["first"] + b["width"] <= F.size(lines))
    return spectra.select(*keep, lines, F.explode(there).alias("b")).select(*keep, "b.band", "b.width", F.slice(lines, F.col("b.first") + 1, F.col("b.width")).alias("xs"))


def peak(xs: Column) -> Column:
    return F.array_max(F.transform(xs, lambda x: F.abs(x)))


def total(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def band_scale_factors(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    return in_bands(spectra, lines, keep).select(*keep, "band", peak(F.col("xs")).alias("peak"), scale_index(peak(F.col("xs"))).alias("scale_factor"))


def group_scale_profile(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """Scale index of every four lines, and by band the largest; the mean over all groups."""
    starts = F.sequence(F.lit(1), F.size(lines) - 3, F.lit(4))
    each = spectra.withColumn("groups", F.transform(starts, lambda s: scale_index(peak(F.slice(lines, s, 4)))))
    mean = F.aggregate("groups", F.lit(0), lambda a, x: a + x) / F.size("groups")
    by_band = in_bands(each.withColumn("mean_scale", mean), lines, [*keep, "groups", "mean_scale"])
    first = F.get(F.array(*[F.lit(e // 4) for e in BAND_EDGES[:-1]]), F.col("band"))
    return by_band.select(*keep, "band", F.array_max(F.slice("groups", first + 1, (F.col("width") / 4).cast("int"))).alias("scale_factor"), "mean_scale")


def band_measures(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    xs = F.col("xs")
    rows = in_bands(spectra, lines, keep)
    return rows.select(*keep, "band", "width", total(xs, lambda x: x * x).alias("energy"), F.array_max(F.transform(xs, lambda x: x.cast("double") * x.cast("double"))).alias("peak"))


def with_mask(measures: DataFrame, keep: list[str]) -> DataFrame:
    """Masking threshold of each band: the levels of the bands around it, spread, and a floor under all of them.

    The spread reaches three bands up and two down, so it is a bounded window over a spectrum's few bands."""
    shape = tonality(F.col("energy"), F.col("peak"), F.col("width"))
    offset = shape * (14.5 + F.col("band") * 0.5) + (1 - shape) * 5.5
    rows = measures.withColumn("level", F.col("energy") * F.pow(F.lit(10.0), -offset / 10))
    w = W.partitionBy(*keep).orderBy("band")
    parts = [F.coalesce(F.lag("level", d).over(w), F.lit(0.0)) * float(SPREAD_UP[d]) for d in range(len(SPREAD_UP) - 1, 0, -1)] + [F.col("level") * 1.0]
    parts += [F.coalesce(F.lead("level", d).over(w), F.lit(0.0)) * float(SPREAD_DOWN[d]) for d in range(1, len(SPREAD_DOWN))]
    spread = parts[0]
    for p in parts[1:]:
        spread = spread + p
    floor = F.avg("energy").over(W.partitionBy(*keep)) * 1e-6 + TINY
    return rows.withColumn("threshold", spread + floor).drop("level")


def normalized(xs: Column, scale_factor: Column) -> Column:
    """Lines over their scale, in single precision."""
    inverse = (F.lit(1.0) / scale_at(scale_factor)).cast("float")
    return F.transform(xs, lambda x: x.cast("float") * inverse)


def slot_energies(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """Sum of magnitudes of every fourth line, by place modulo 4."""
    slots = spectra.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.filter(lines, lambda _, i: F.pmod(i, F.lit(4)) == s))).alias("slot", "xs"))
    return slots.select(*keep, "slot", total(F.col("xs"), F.abs).alias("energy"))


def word_length_gate(factors: DataFrame, keep: list[str], source: Column) -> DataFrame:
    """Word length of each band: the rounded source within 1 to 7, but 0 for a band whose scale factor is low, or lies more
    than 30 below that of one of the eight bands before it."""
    w = W.partitionBy(*keep)
    most = F.coalesce(F.max(F.when(F.col("band") >= 1, F.col("scale_factor"))).over(w), F.lit(0))
    least = F.when(most <= 29, F.greatest(F.lit(1), F.floor(most / 6))).otherwise(6)
    before = F.max("scale_factor").over(w.orderBy("band").rowsBetween(-8, -1))
    wanted = F.greatest(F.lit(1), F.least(F.lit(7), (source + 0.5).cast("int")))
    low = (F.col("scale_factor") < least) | (F.col("scale_factor") < F.coalesce(before, F.lit(0)) - 30)
    return factors.withColumn("word_length", F.when(low, 0).otherwise(wanted).cast("int"))


def thresholds(factors: DataFrame, keep: list[str], attack: Column) -> DataFrame:
    """Allocation threshold of each band against the mean scale factor; floors in the lowest bands."""
    w = W.partitionBy(*keep)
    raw = (0.24 * (F.col("scale_factor") - F.avg("scale_factor").over(w)) - 0.3 * F.log2(F.col("width").cast("double"))).cast("float").cast("double")
    calm = F.when(F.col("band") == 0, F.greatest(raw, F.lit(6.0))).when(F.col("band") <= 3, F.greatest(raw, F.lit(3.0))).otherwise(raw)
    lifted = F.when(F.col("band") <= 7, raw + 0.7).when(F.col("band") <= 17, raw + 0.5).otherwise(raw)
    struck = F.when(F.col("band") == 0, F.greatest(lifted, F.lit(6.0))).otherwise(lifted)
    return factors.withColumn("threshold", F.when(attack, struck).otherwise(calm))


def chunk_peaks(samples: DataFrame, stream: str, value: str, size: int) -> DataFrame:
    """Largest magnitude of each ``size`` samples of a stream."""
    return samples.groupBy(stream, F.floor(F.col("sample_no") / size).cast("long").alias("chunk_no")).agg(F.max(F.abs(value)).alias("peak"))


#: Lines of a group, groups of a block, and groups that a block may give as tones; how far one must stand out.
TONE_GROUP, TONE_BLOCK, MOST_TONES, TONE_MARGIN = 4, 16, 7, 2


def tone_groups(spectra: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """Groups of lines whose scale factor stands out above the spectrum's mean, the first few of each block: group_no, factor."""
    starts = F.sequence(F.lit(1), F.size(lines) - (TONE_GROUP - 1), F.lit(TONE_GROUP))
    rows = spectra.select(*keep, F.transform(starts, lambda s: scale_index(peak(F.slice(lines, s, TONE_GROUP)))).alias("factors"))
    mean = F.aggregate("factors", F.lit(0), lambda a, x: a + x) / F.size("factors")
    rows = rows.select(*keep, F.size("factors").alias("n"), F.filter(F.transform("factors", lambda f, i: F.struct(i.alias("group_no"), f.alias("factor"))), lambda g: g["factor"] > mean + TONE_MARGIN).alias("out"))
    numbers = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TONE_BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(F.filter("out", lambda g: F.floor(g["group_no"] / TONE_BLOCK) == b), 1, MOST_TONES))
    return rows.where("n > 0").select(*keep, F.explode(F.flatten(blocks)).alias("g")).select(*keep, "g.group_no", "g.factor")


def near_attacks(attacks: DataFrame, stream: Column, order: str) -> DataFrame:
    """``near_attack``: whether a record or the one before it in its stream is an ``attack``."""
    before = F.lag("attack").over(W.partitionBy(stream).orderBy(order))
    return attacks.withColumn("near_attack", F.col("attack") | F.coalesce(before, F.lit(False)))


#: Chunks of a stream that one task looks at together, and those before them that a smoothed value still depends on: what
#: lies further back counts less than 0.7 ** 256 of itself.
BLOCK, WARM_UP = 4096, 256


def running_ceiling(peaks: DataFrame, stream: str) -> DataFrame:
    """Largest peak before each chunk (attacks) and after it (releases).

    In two levels, so that no task holds a long stream: the peaks of blocks of chunks give what lies before and after each
    block, and windows over one block give the rest."""
    rows = peaks.withColumn("block", F.floor(F.col("chunk_no") / BLOCK))
    blocks = rows.groupBy(stream, "block").agg(F.max("peak").alias("top"))
    w = W.partitionBy(stream)
    earlier, later = (F.max("top").over(w.orderBy(o).rowsBetween(W.unboundedPreceding, -1)) for o in (F.col("block"), F.desc("block")))
    blocks = blocks.select(F.col(stream).alias("of"), F.col("block").alias("at"), earlier.alias("earlier"), later.alias("later"))
    one = W.partitionBy(stream, "block")
    before, after = (F.max("peak").over(one.orderBy(o).rowsBetween(W.unboundedPreceding, -1)) for o in (F.col("chunk_no"), F.desc("chunk_no")))
    both = rows.withColumn("before", before).withColumn("after", after).join(blocks, (F.col(stream) == F.col("of")) & (F.col("block") == F.col("at")))
    # The greater of two that may be missing.
    return both.select(*peaks.columns, F.greatest("earlier", "before").alias("ceiling"), F.greatest("later", "after").alias("release_ceiling"))


#: log2(e) in single precision.
LOG2_E = 1.4426950216293335


def rise(value: Column, ceiling: Column) -> Column:
    """Octaves by which a value exceeds its ceiling."""
    return F.when((ceiling > 0) & (value > ceiling), F.greatest(F.lit(0.0), F.log(value / ceiling) * LOG2_E)).otherwise(F.lit(0.0))


def log_flux(peaks: DataFrame, stream: str) -> DataFrame:
    """Chunks whose rise exceeds the smoothed rise before them by 0.7: a recursion over blocks of a stream's chunks, each
    begun WARM_UP chunks earlier."""
    rows = running_ceiling(peaks, stream).withColumn("rise", rise(F.col("peak"), F.coalesce("ceiling", F.lit(0.0))))
    block = lambda n: F.floor(n / BLOCK)
    blocks = F.array_distinct(F.array(block(F.col("chunk_no")), block(F.col("chunk_no") + WARM_UP)))
    rows = rows.select(stream, "chunk_no", "rise", F.explode(blocks).alias("block"))
    schema = T.StructType([rows.schema[stream], T.StructField("chunk_no", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in ("rise", "smoothed")], T.StructField("detected", T.BooleanType())])

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_no", ignore_index=True)
        smoothed, now = [], 0.0
        for r in pdf["rise"].tolist():
            smoothed.append(now)
            now = 0.3 * r + 0.7 * now
        pdf["smoothed"] = smoothed
        pdf["detected"] = pdf["rise"] > pdf["smoothed"] + 0.7
        return pdf[pdf["chunk_no"] // BLOCK == key[1]][schema.names]

    return rows.groupBy(stream, "block").applyInPandas(walk, schema)
