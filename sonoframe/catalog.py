"""Queries over the engine's operators on the given tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.functions import bits as B
from sonoframe.functions import scalar as S
from sonoframe import codec
from sonoframe.operators import encoding, gains, layers, residual, spectral, synthesis, syntax
from sonoframe.operators.kernels import HALF_FILTER, filter_taps
from sonoframe.plans import analysis as A
from sonoframe.plans import framing as FR
from sonoframe.plans.codebooks import code_bits, codebook
from sonoframe.sources import wave
from sonoframe.plans.dimensions import BAND_EDGES, DEAD_ZONE_DIVISORS, DEAD_ZONE_NUMERATORS, PROFILES, SCALES, SPREAD_DOWN, SPREAD_UP, TINY, profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIZE = 64  # frame size that suits streams of some hundred samples
SHORT_DELAY = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- Signals -------------------------------------------------------------------------------------------------------

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """One stream per supplier: stream_id, sample_no, x."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", *ORDER)
    return FR.number_samples(rows, "l_suppkey", ORDER).select(F.col("l_suppkey").alias("stream_id"), "sample_no", F.col("l_extendedprice").alias("x"))


def stereo(spark: SparkSession, sf: str) -> DataFrame:
    """One two-channel stream per user: stream_id, sample_no, l, r in -1 to 1."""
    number = F.coalesce(F.nullif(F.regexp_extract("props", "([0-9]+)", 1), F.lit("")).cast("double"), F.lit(0.0))
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"), number.alias("number"))
    rows = FR.number_samples(rows, "user_id", ["ts", "event_id"])
    return rows.select(F.col("user_id").alias("stream_id"), "sample_no", (F.col("value") / 256.0).cast("float").alias("l"), (F.col("number") / 128.0).cast("float").alias("r"))


SIGNAL = """signal AS (
  SELECT l_suppkey AS stream_id, l_extendedprice AS x,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_no
  FROM lineitem)"""
STEREO = """stereo AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_no,
         CAST(coalesce(value, 0) / 256.0::DOUBLE AS FLOAT) AS l,
         CAST(coalesce(TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE), 0) / 128.0::DOUBLE AS FLOAT) AS r
  FROM events)"""
BANDS = "bands(band, s, e) AS (VALUES " + ", ".join(f"({i}, {a}, {z})" for i, (a, z) in enumerate(zip(BAND_EDGES, BAND_EDGES[1:], strict=False))) + ")"
IN_BANDS = f"{BANDS}, x AS (SELECT vec_id, band, e - s AS width, list_slice(embedding, s + 1, e) AS xs FROM embeddings JOIN bands ON e <= len(embedding))"
SCALE_LIST = "[" + ", ".join(f"{float(s)!r}::DOUBLE" for s in SCALES) + "]"
PEAK = "list_max(list_transform(xs, lambda v: abs(v)))"


def scale_sql(magnitude: str) -> str:
    return f"CAST(len(list_filter(list_slice({SCALE_LIST}, 1, 63), lambda q: q <= {magnitude}::DOUBLE)) AS INTEGER)"


FACTORS = f"{IN_BANDS}, factors AS (SELECT vec_id, band, width, xs, {scale_sql(PEAK)} AS scale_factor FROM x)"


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


# --- Profiles ------------------------------------------------------------------------------------------------------

PROFILE_VALUES = "profiles(bitrate_kbps, bytes_per_frame, syntax_mode, mode_flag) AS (VALUES " + ", ".join(map(str, PROFILES)) + ")"


@query(f"""WITH {PROFILE_VALUES}, asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 66 WHEN 1 THEN 105 WHEN 2 THEN 132 ELSE 96 END AS kbps FROM customer)
SELECT c_custkey, kbps, bytes_per_frame, syntax_mode FROM asked LEFT JOIN profiles ON kbps = bitrate_kbps""")
def profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of a bit rate, none if it isn't supported."""
    k = F.col("c_custkey") % 4
    asked = table(spark, sf, "customer").select("c_custkey", F.when(k == 0, 66).when(k == 1, 105).when(k == 2, 132).otherwise(96).alias("kbps"))
    found = asked.join(F.broadcast(profiles(spark)), F.col("kbps") == F.col("bitrate_kbps"), "left")  # three rows
    return found.select("c_custkey", "kbps", "bytes_per_frame", "syntax_mode")


@query(f"""WITH {PROFILE_VALUES}, asked AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 192 WHEN 1 THEN 304 ELSE 384 END AS block_align, CAST(p_size % 2 AS INTEGER) AS flag,
         CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS channels FROM part)
SELECT p_partkey, block_align, flag, channels, CASE WHEN channels = 2 THEN bitrate_kbps END AS bitrate_kbps
FROM asked LEFT JOIN profiles ON block_align = bytes_per_frame AND CASE WHEN flag = 1 THEN 2 ELSE 1 END = syntax_mode""")
def wave_profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of a file's block size and mode flag, for two channels only."""
    k = F.col("p_partkey") % 3
    asked = table(spark, sf, "part").select(
        "p_partkey", F.when(k == 0, 192).when(k == 1, 304).otherwise(384).alias("block_align"), (F.col("p_size") % 2).cast("int").alias("flag"), F.when(F.col("p_size") % 5 == 0, 1).otherwise(2).alias("channels")
    )
    p = F.broadcast(profiles(spark).select("bitrate_kbps", "bytes_per_frame", "syntax_mode"))
    found = asked.join(p, (F.col("block_align") == F.col("bytes_per_frame")) & (F.when(F.col("flag") == 1, 2).otherwise(1) == F.col("syntax_mode")), "left")
    return found.select("p_partkey", "block_align", "flag", "channels", F.when(F.col("channels") == 2, F.col("bitrate_kbps")).alias("bitrate_kbps"))


# --- Framing and timeline ------------------------------------------------------------------------------------------

PLACED = f"""{SIGNAL}, placed AS (
  SELECT *, CASE WHEN sample_no < {SHORT_DELAY} THEN 0 ELSE 1 + (sample_no - {SHORT_DELAY}) // {SIZE} END AS frame_no,
         CASE WHEN sample_no < {SHORT_DELAY} THEN {SIZE - SHORT_DELAY} + sample_no ELSE (sample_no - {SHORT_DELAY}) % {SIZE} END AS place FROM signal)"""


def framed_signal(spark: SparkSession, sf: str) -> DataFrame:
    return FR.frames(signal(spark, sf), "stream_id", ["x"], SIZE, SHORT_DELAY)


@query(f"""WITH {PLACED} SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(count(*) AS INTEGER) AS n_samples, min(place)::INTEGER AS first_place,
  arg_min(x, place) AS first_x, arg_max(x, place) AS last_x, max(abs(x)) AS peak FROM placed GROUP BY ALL""")
def frame_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each stream: alignment frame, then blocks."""
    f = framed_signal(spark, sf)
    first = F.when(F.col("frame_no") == 0, SIZE - SHORT_DELAY).otherwise(0)
    return f.select("stream_id", "frame_no", "n_samples", first.alias("first_place"), F.get("x", first).alias("first_x"), F.get("x", first + F.col("n_samples") - 1).alias("last_x"), A.peak(F.col("x")).alias("peak"))


@query(f"""WITH {PLACED}, f AS (SELECT stream_id, frame_no, count(*) AS n FROM placed GROUP BY ALL)
SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, CAST({SIZE} AS INTEGER) AS size, CAST({SIZE} - n AS INTEGER) AS padded FROM f""")
def frame_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame is full, with zeros where no sample falls."""
    return framed_signal(spark, sf).select("stream_id", "frame_no", F.size("x").alias("size"), (SIZE - F.col("n_samples")).alias("padded"))


@query(f"""WITH {PLACED}, f AS (SELECT stream_id, max(frame_no) AS last FROM placed GROUP BY ALL)
SELECT stream_id, CAST(last + 1 + 3 AS BIGINT) AS frames_in, CAST(last + 3 + CASE WHEN last >= 1 THEN 0 ELSE 1 END AS BIGINT) AS frames_out FROM f""")
def frame_drain(spark: SparkSession, sf: str) -> DataFrame:
    """With the silent frames at the end, and without the first block, which is coded but not written."""
    f = FR.with_drain(framed_signal(spark, sf), "stream_id", ["x"], SIZE)
    return f.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames_in"), F.sum(F.when(F.col("frame_no") != 1, 1).otherwise(0)).alias("frames_out"))


@query("""WITH n AS (SELECT l_suppkey AS stream_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT stream_id, n, CAST(4 + greatest(0, ceil((n - 69) / 1024.0) - 1) AS BIGINT) AS frames, CAST(4 + greatest(0, ceil((n - 5) / 64.0) - 1) AS BIGINT) AS short_frames FROM n""")
def frame_count_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written for a stream, from its number of samples alone."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stream_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("stream_id", "n", FR.frame_count(F.col("n")).alias("frames"), FR.frame_count(F.col("n"), SIZE, SHORT_DELAY).alias("short_frames"))


def decoded_frames(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stream_id")).agg(F.count(F.lit(1)).alias("sample_count"))
    whole = F.ceil((F.col("sample_count") + SIZE + SHORT_DELAY) / F.lit(SIZE)).cast("long")
    return n.select("stream_id", "sample_count", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("frame_no"))


TRIMS = f"""n AS (SELECT l_suppkey AS stream_id, count(*) AS sample_count FROM lineitem GROUP BY 1),
d AS (SELECT stream_id, sample_count, unnest(range(CAST(ceil((sample_count + {SIZE + SHORT_DELAY}) / {SIZE}.0) AS BIGINT))) AS frame_no FROM n),
t AS (SELECT *, least({SIZE}, greatest(0, {SIZE + SHORT_DELAY} - frame_no * {SIZE})) AS skip, greatest(0, frame_no * {SIZE} - {SIZE + SHORT_DELAY}) AS done FROM d)"""


@query(f"""WITH {TRIMS} SELECT stream_id, frame_no, CAST(skip AS INTEGER) AS skip, CAST(greatest(0, least({SIZE} - skip, sample_count - done)) AS INTEGER) AS take FROM t""")
def timeline_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Visible samples of each decoded frame."""
    return FR.trims(decoded_frames(spark, sf), "stream_id", size=SIZE, align=SIZE, delay=SHORT_DELAY).select("stream_id", "frame_no", "skip", "take")


@query(f"""WITH {TRIMS} SELECT stream_id, max(sample_count) AS expected, CAST(sum(greatest(0, least({SIZE} - skip, sample_count - done))) AS BIGINT) AS visible,
max(sample_count) = sum(greatest(0, least({SIZE} - skip, sample_count - done))) AS complete FROM t WHERE frame_no < 8 GROUP BY 1""")
def timeline_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Streams cut after eight frames: which of them are complete."""
    t = FR.trims(decoded_frames(spark, sf), "stream_id", size=SIZE, align=SIZE, delay=SHORT_DELAY).where("frame_no < 8")
    return FR.incomplete(t, "stream_id")


# --- Samples -------------------------------------------------------------------------------------------------------


@query(f"""WITH {STEREO}, f AS (SELECT stream_id, sample_no // {SIZE} AS frame_no, list(l ORDER BY sample_no) AS l, list(r ORDER BY sample_no) AS r FROM stereo GROUP BY ALL)
SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, list_aggregate(list_transform(range(len(l)), lambda i: l[i + 1]::DECIMAL(18,6)::VARCHAR || ' ' || r[i + 1]::DECIMAL(18,6)::VARCHAR), 'string_agg', ' ') AS samples FROM f""")
def interleave_planar(spark: SparkSession, sf: str) -> DataFrame:
    """Planar chunks to interleaved samples."""
    rows = stereo(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no")).agg(F.array_sort(F.collect_list(F.struct("sample_no", "l", "r"))).alias("x"))
    both = FR.interleave(F.transform("x", lambda s: s["l"]), F.transform("x", lambda s: s["r"]))
    return rows.select("stream_id", "frame_no", F.array_join(F.transform(both, lambda v: v.cast("decimal(18,6)").cast("string")), " ").alias("samples"))


@query(f"""WITH {STEREO}, s AS (SELECT stream_id, sample_no // 2 AS place, CAST(sample_no % 2 AS INTEGER) AS channel, l AS x FROM stereo)
SELECT stream_id, channel, CAST(count(*) AS INTEGER) AS n, arg_min(x, place) AS first_x, arg_max(x, place) AS last_x, max(x) AS top FROM s GROUP BY ALL""")
def deinterleave_mono(spark: SparkSession, sf: str) -> DataFrame:
    """One channel's samples read as interleaved, back to planar."""
    rows = stereo(spark, sf).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", "l"))).alias("x")).select("stream_id", F.transform("x", lambda p: p["l"]).alias("x"))
    both = rows.select("stream_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), FR.deinterleave(F.col("x"), c).alias("x")) for c in (0, 1)])).alias("c")).where("size(c.x) > 0")
    n = F.size("c.x")
    return both.select("stream_id", "c.channel", n.alias("n"), F.get("c.x", F.lit(0)).alias("first_x"), F.get("c.x", n - 1).alias("last_x"), F.array_max("c.x").alias("top"))


@query(f"""WITH {STEREO}, s AS (SELECT *, CAST(l * 32768::FLOAT AS DOUBLE) AS a, CAST(r * 32768::FLOAT AS DOUBLE) AS b FROM stereo)
SELECT stream_id, sample_no, CASE WHEN a <= -32767 THEN -32767 WHEN a > 32767 THEN 32767 ELSE CAST(round_even(a, 0) AS INTEGER) END AS left16,
CASE WHEN b <= -32767 THEN -32767 WHEN b > 32767 THEN 32767 ELSE CAST(round_even(b, 0) AS INTEGER) END AS right16 FROM s""")
def float_to_pcm16(spark: SparkSession, sf: str) -> DataFrame:
    return stereo(spark, sf).select("stream_id", "sample_no", S.float_to_pcm16(F.col("l")).alias("left16"), S.float_to_pcm16(F.col("r")).alias("right16"))


@query(f"WITH {STEREO} SELECT stream_id, sample_no, CAST((l + r) * 0.5::FLOAT AS FLOAT) AS mid, CAST((l - r) * 0.5::FLOAT AS FLOAT) AS side FROM stereo")
def mid_side(spark: SparkSession, sf: str) -> DataFrame:
    """Mid and side of two channels, in single precision."""
    half = F.lit(0.5).cast("float")
    return stereo(spark, sf).select("stream_id", "sample_no", ((F.col("l") + F.col("r")) * half).alias("mid"), ((F.col("l") - F.col("r")) * half).alias("side"))


# --- Bits ----------------------------------------------------------------------------------------------------------

TEXT_BITS = """h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part),
b AS (SELECT p_partkey, list_aggregate(list_transform(range(1, len(h) + 1), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][1 + instr('0123456789ABCDEF', h[i]) - 1]), 'string_agg', '') AS bits FROM h)"""


def number_sql(bits: str) -> str:
    return f"list_sum(list_transform(range(1, len({bits}) + 1), lambda i: CASE WHEN ({bits})[i] = '1' THEN CAST(1 AS BIGINT) << (len({bits}) - i) ELSE 0 END))"


def text_bits(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of each part's name as bits."""
    return table(spark, sf, "part").select("p_partkey", B.bit_string(F.encode("p_name", "utf-8")).alias("bits"))


@query(f"WITH {TEXT_BITS} SELECT p_partkey, CAST({number_sql('substr(bits, 4, 11)')} AS BIGINT) AS field_a, CAST({number_sql('substr(bits, 17, 7)')} AS BIGINT) AS field_b FROM b")
def bit_unpack(spark: SparkSession, sf: str) -> DataFrame:
    return text_bits(spark, sf).select("p_partkey", B.unpack_bits(F.col("bits"), F.lit(3), F.lit(11)).alias("field_a"), B.unpack_bits(F.col("bits"), F.lit(16), F.lit(7)).alias("field_b"))


@query(f"WITH {TEXT_BITS}, n AS (SELECT p_partkey, CAST({number_sql('substr(bits, 10, 5)')} AS BIGINT) AS v FROM b) SELECT p_partkey, CASE WHEN v >= 16 THEN v - 32 ELSE v END AS field FROM n")
def bit_signed(spark: SparkSession, sf: str) -> DataFrame:
    return text_bits(spark, sf).select("p_partkey", B.unpack_signed_bits(F.col("bits"), F.lit(9), F.lit(5)).alias("field"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, " + "CAST(" + " + ".join(f"((l_partkey >> {i}) & 1) * {1 << (9 - i)}" for i in range(10)) + " AS BIGINT) AS reversed FROM lineitem")
def bit_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.reverse_low_bits(F.col("l_partkey"), 10).alias("reversed"))


@query(f"WITH {TEXT_BITS}, n AS (SELECT p_partkey, CAST({number_sql('substr(bits, 1, 6)')} AS BIGINT) AS sync, CAST({number_sql('substr(bits, 7, 2)')} AS BIGINT) + 1 AS unit_count FROM b) SELECT *, sync = 40 AS header_ok FROM n")
def header_decode(spark: SparkSession, sf: str) -> DataFrame:
    b = text_bits(spark, sf)
    return b.select("p_partkey", *[c.alias(k) for k, c in B.channel_header(F.col("bits")).items()])


@query(
    f"WITH {TEXT_BITS} SELECT p_partkey, CAST({number_sql('substr(bits, 1, 4)')} AS BIGINT) AS selector, "
    + " || ',' || ".join(f"CAST(CAST({number_sql(f'substr(bits, {a}, 2)')} AS BIGINT) AS VARCHAR)" for a in (5, 7, 9, 11))
    + f" AS hints, CAST({number_sql('substr(bits, 13, 2)')} AS BIGINT) = 3 AS marker_ok, CAST({number_sql('substr(bits, 15, 2)')} AS BIGINT) + 1 AS unit_count FROM b WHERE len(bits) >= 16"
)
def joint_header_decode(spark: SparkSession, sf: str) -> DataFrame:
    b = text_bits(spark, sf).where("length(bits) >= 16")
    h = B.joint_header(F.col("bits"))
    return b.select("p_partkey", h["selector"].alias("selector"), F.array_join(h["hints"].cast("array<string>"), ",").alias("hints"), h["marker_ok"].alias("marker_ok"), h["unit_count"].alias("unit_count"))


# --- Gain records --------------------------------------------------------------------------------------------------

POINTS = """points AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) % 17 ORDER BY l_linenumber, l_partkey, l_quantity) AS levels,
list(CAST(l_linenumber * 4 + l_partkey % 5 AS INTEGER) ORDER BY l_linenumber, l_partkey, l_quantity) AS locations FROM lineitem GROUP BY 1)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A gain record per order: its lines as points."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x")
    )
    return rows.select("l_orderkey", F.transform("x", lambda p: (p["l_quantity"].cast("int") % 17)).alias("levels"), F.transform("x", lambda p: (p["l_linenumber"] * 4 + p["l_partkey"] % 5).cast("int")).alias("locations"))


@query(f"""WITH {POINTS} SELECT l_orderkey, len(levels) <= 7 AND len(list_filter(levels, lambda v: v > 15)) = 0 AND len(list_filter(locations, lambda v: v > 31)) = 0
AND len(list_filter(range(2, len(levels) + 1), lambda i: locations[i - 1] >= locations[i] OR levels[i - 1] = levels[i])) = 0 AS valid FROM points""")
def gain_record_valid(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("l_orderkey", S.gain_record_valid(F.col("levels"), F.col("locations")).alias("valid"))


@query(f"WITH {POINTS} SELECT l_orderkey, CAST(3 + 9 * len(levels) AS INTEGER) AS bits, greatest(list_max(levels), 4) - least(list_min(levels), 4) >= 3 AS attack FROM points")
def gain_record_bits(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("l_orderkey", S.gain_record_bits(F.col("levels")).alias("bits"), S.is_attack(F.col("levels")).alias("attack"))


@query(f"WITH {POINTS} SELECT l_orderkey, CAST(6 + 3 * len(levels) + 6 * len(list_filter(levels, lambda v: v % 8 > 0)) AS INTEGER) AS bits FROM points")
def spectrum_alloc_bits(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("l_orderkey", S.spectrum_header_bits(F.transform("levels", lambda v: v % 8)).alias("bits"))


# --- Signal analysis -----------------------------------------------------------------------------------------------

PEAKS = f"{SIGNAL}, peaks AS (SELECT stream_id, CAST(sample_no // 8 AS BIGINT) AS chunk_no, max(abs(x)) AS peak FROM signal GROUP BY ALL)"
CEILINGS = f"""{PEAKS}, ceilings AS (SELECT *, max(peak) OVER (PARTITION BY stream_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ceiling,
max(peak) OVER (PARTITION BY stream_id ORDER BY chunk_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS release_ceiling FROM peaks)"""
RISE = "CASE WHEN ceiling > 0 AND peak > ceiling THEN greatest(0, ln(peak / ceiling) * 1.4426950216293335::DOUBLE) ELSE 0 END"


@query(f"WITH {PEAKS} SELECT * FROM peaks")
def abs_peak_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return A.chunk_peaks(signal(spark, sf), "stream_id", "x", 8)


@query(f"WITH {CEILINGS} SELECT * FROM ceilings")
def running_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return A.running_ceiling(A.chunk_peaks(signal(spark, sf), "stream_id", "x", 8), "stream_id")


@query(f"WITH {CEILINGS} SELECT stream_id, chunk_no, round({RISE}, 9) AS rise FROM ceilings")
def log_flux_rise(spark: SparkSession, sf: str) -> DataFrame:
    c = A.running_ceiling(A.chunk_peaks(signal(spark, sf), "stream_id", "x", 8), "stream_id")
    return c.select("stream_id", "chunk_no", F.round(A.rise(F.col("peak"), F.coalesce("ceiling", F.lit(0.0))), 9).alias("rise"))


@query(f"""WITH RECURSIVE {CEILINGS}, r AS (SELECT stream_id, chunk_no, CAST({RISE} AS DOUBLE) AS rise FROM ceilings),
walk AS (SELECT stream_id, chunk_no, rise, CAST(0 AS DOUBLE) AS smoothed FROM r WHERE chunk_no = 0
UNION ALL SELECT r.stream_id, r.chunk_no, r.rise, 0.3::DOUBLE * w.rise + 0.7::DOUBLE * w.smoothed FROM walk w JOIN r ON r.stream_id = w.stream_id AND r.chunk_no = w.chunk_no + 1)
SELECT stream_id, chunk_no, round(rise, 9) AS rise, round(smoothed, 9) AS smoothed, rise > smoothed + 0.7::DOUBLE AS detected FROM walk""")
def ema_recursion(spark: SparkSession, sf: str) -> DataFrame:
    """Detections against an exponentially smoothed rise."""
    f = A.log_flux(A.chunk_peaks(signal(spark, sf), "stream_id", "x", 8), "stream_id")
    return f.select("stream_id", "chunk_no", F.round("rise", 9).alias("rise"), F.round("smoothed", 9).alias("smoothed"), "detected")


@query(f"WITH {PEAKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY peak DESC, chunk_no) AS place FROM peaks) SELECT stream_id, chunk_no, peak, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 7")
def top7_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The seven largest candidates of each stream, earlier ones first among equals."""
    p = A.chunk_peaks(signal(spark, sf), "stream_id", "x", 8)
    return p.withColumn("place", F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc("peak"), "chunk_no"))).where("place <= 7")


@query(f"""WITH {SIGNAL}, f AS (SELECT stream_id, CAST(sample_no // {SIZE} AS BIGINT) AS frame_no, count(*) AS n, sum(x) AS total FROM signal GROUP BY ALL)
SELECT stream_id, frame_no, n, round(total, 4) AS total, round(lag(total, 1) OVER w, 4) AS total_1, round(lag(total, 2) OVER w, 4) AS total_2 FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)""")
def lag_history(spark: SparkSession, sf: str) -> DataFrame:
    """What a frame sees of the two frames before it."""
    f = signal(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    w = W.partitionBy("stream_id").orderBy("frame_no")
    return f.select("stream_id", "frame_no", "n", F.round("total", 4).alias("total"), F.round(F.lag("total", 1).over(w), 4).alias("total_1"), F.round(F.lag("total", 2).over(w), 4).alias("total_2"))


@query(f"""WITH {SIGNAL}, f AS (SELECT stream_id, sample_no // {SIZE} AS frame_no, list(x ORDER BY sample_no) AS xs FROM signal GROUP BY ALL),
o AS (SELECT stream_id, frame_no, list_concat(coalesce(lag(xs) OVER (PARTITION BY stream_id ORDER BY frame_no), []), xs) AS xs FROM f)
SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(len(xs) AS INTEGER) AS size, xs[1] AS first_x, list_max(xs) AS top FROM o""")
def overlap_window(spark: SparkSession, sf: str) -> DataFrame:
    """Transform windows: the frame before and this one."""
    f = signal(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no")).agg(F.array_sort(F.collect_list(F.struct("sample_no", "x"))).alias("s"))
    f = f.select("stream_id", "frame_no", F.transform("s", lambda p: p["x"]).alias("xs"))
    before = F.coalesce(F.lag("xs").over(W.partitionBy("stream_id").orderBy("frame_no")), F.array().cast("array<double>"))
    return f.withColumn("xs", F.concat(before, "xs")).select("stream_id", "frame_no", F.size("xs").alias("size"), F.get("xs", F.lit(0)).alias("first_x"), F.array_max("xs").alias("top"))


# --- Spectra -------------------------------------------------------------------------------------------------------


@query(f"WITH {FACTORS} SELECT vec_id, band, {PEAK} AS peak, scale_factor FROM factors")
def band_scale_factor(spark: SparkSession, sf: str) -> DataFrame:
    return A.band_scale_factors(embedded(spark, sf), "embedding", ["vec_id"])


@query(f"""WITH {BANDS}, g AS (SELECT vec_id, list_transform(range(0, len(embedding), 4), lambda s: {scale_sql('list_max(list_transform(list_slice(embedding, s + 1, s + 4), lambda v: abs(v)))')}) AS gs, embedding FROM embeddings)
SELECT vec_id, band, list_max(list_slice(gs, s // 4 + 1, e // 4)) AS scale_factor, round(list_sum(gs) / len(gs)::DOUBLE, 9) AS mean_scale FROM g JOIN bands ON e <= len(embedding)""")
def group4_scale_profile(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_scale_profile(embedded(spark, sf), "embedding", ["vec_id"]).withColumn("mean_scale", F.round("mean_scale", 9))


MEASURES = f"{IN_BANDS}, m AS (SELECT vec_id, band, width, list_sum(list_transform(xs, lambda v: v::DOUBLE * v::DOUBLE)) AS energy, list_max(list_transform(xs, lambda v: v::DOUBLE * v::DOUBLE)) AS peak FROM x)"
TONAL = "CASE WHEN energy <= 0 OR width <= 1 THEN 0 ELSE greatest(0, least(1, ln(greatest(1, peak * width / energy)) / ln(width::DOUBLE))) END"


@query(f"WITH {MEASURES} SELECT vec_id, band, CAST(width AS INTEGER) AS width, round(energy, 9) AS energy, round(peak, 9) AS peak FROM m")
def band_measures(spark: SparkSession, sf: str) -> DataFrame:
    m = A.band_measures(embedded(spark, sf), "embedding", ["vec_id"])
    return m.select("vec_id", "band", "width", F.round("energy", 9).alias("energy"), F.round("peak", 9).alias("peak"))


@query(f"WITH {MEASURES} SELECT vec_id, band, round({TONAL}, 9) AS tonality FROM m")
def tonality(spark: SparkSession, sf: str) -> DataFrame:
    m = A.band_measures(embedded(spark, sf), "embedding", ["vec_id"])
    return m.select("vec_id", "band", F.round(S.tonality(F.col("energy"), F.col("peak"), F.col("width")), 9).alias("tonality"))


UP = ", ".join(f"({d}, {float(v)!r}::DOUBLE)" for d, v in enumerate(SPREAD_UP)) + ", " + ", ".join(f"({-d}, {float(v)!r}::DOUBLE)" for d, v in enumerate(SPREAD_DOWN) if d)
MASK = f"""{MEASURES}, spread(d, s) AS (VALUES {UP}), l AS (SELECT *, energy * pow(10, -({TONAL} * (14.5 + band * 0.5) + (1 - {TONAL}) * 5.5) / 10) AS level FROM m),
k AS (SELECT t.vec_id, t.band, t.energy, sum(f.level * s.s) AS spread FROM l t JOIN l f ON t.vec_id = f.vec_id JOIN spread s ON t.band - f.band = s.d GROUP BY ALL),
mask AS (SELECT *, spread + avg(energy) OVER (PARTITION BY vec_id) * 1e-6::DOUBLE + {TINY}::DOUBLE AS threshold FROM k)"""


@query(f"WITH {MASK} SELECT vec_id, band, round(threshold, 9) AS threshold FROM mask")
def spread_mask(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_mask(A.band_measures(embedded(spark, sf), "embedding", ["vec_id"]), ["vec_id"]).select("vec_id", "band", F.round("threshold", 9).alias("threshold"))


SYMBOL = "CASE WHEN abs(n) <= {zero}::DOUBLE THEN 0 ELSE greatest(-7, least(7, CAST(trunc(n * 7.5::DOUBLE + 31.5::DOUBLE) AS BIGINT) - 31)) END"
NORMAL = f"""{FACTORS}, normal AS (SELECT vec_id, band, scale_factor, unnest(xs) AS v, unnest(range(len(xs))) AS place FROM factors),
lines AS (SELECT *, CAST(CAST(v AS FLOAT) * CAST(1::DOUBLE / {SCALE_LIST}[scale_factor + 1] AS FLOAT) AS DOUBLE) AS n FROM normal)"""
ZERO = float(__import__("numpy").float32(DEAD_ZONE_NUMERATORS[3] / DEAD_ZONE_DIVISORS[5]))


def normal_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.in_bands(embedded(spark, sf), "embedding", ["vec_id"]).withColumn("scale_factor", S.scale_index(A.peak(F.col("xs"))))
    return rows.withColumn("ns", A.normalized(F.col("xs"), F.col("scale_factor")))


@query(f"WITH {NORMAL} SELECT vec_id, band, string_agg(CAST({SYMBOL.format(zero=0.0)} AS VARCHAR), ',' ORDER BY place) AS symbols FROM lines GROUP BY ALL")
def quantize_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols at word length 5."""
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(5), F.lit(0.0)))
    return normal_bands(spark, sf).select("vec_id", "band", F.array_join(q.cast("array<string>"), ",").alias("symbols"))


@query(f"WITH {NORMAL} SELECT vec_id, band, CAST(count(*) FILTER (WHERE {SYMBOL.format(zero=ZERO)} = 0) AS INTEGER) AS zeros FROM lines GROUP BY ALL")
def dead_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fall into the dead zone of time factor 3 at word length 5."""
    zero = S.dead_zone(F.lit(3), F.lit(5))
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(5), zero))
    return normal_bands(spark, sf).select("vec_id", "band", F.size(F.filter(q, lambda s: s == 0)).alias("zeros"))


@query(f"""WITH {NORMAL}, e AS (SELECT vec_id, band, (n - ({SYMBOL.format(zero=0.0)}) * (1::DOUBLE / 7.5)) * {SCALE_LIST}[scale_factor + 1] AS e FROM lines)
SELECT vec_id, band, round(sum(e * e), 9) AS noise FROM e GROUP BY ALL""")
def masked_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Energy of the quantization error at word length 5."""
    scale = S.scale_at(F.col("scale_factor"))

    def squared(n):
        e = (n.cast("double") - S.quantize(n.cast("double"), F.lit(5), F.lit(0.0)) * F.lit(1 / 7.5)) * scale
        return e * e

    return normal_bands(spark, sf).select("vec_id", "band", F.round(A.total(F.col("ns"), squared), 9).alias("noise"))


@query(f"""WITH {FACTORS}, g AS (SELECT *, coalesce(max(scale_factor) FILTER (WHERE band >= 1) OVER (PARTITION BY vec_id), 0) AS most,
max(scale_factor) OVER (PARTITION BY vec_id ORDER BY band ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before FROM factors)
SELECT vec_id, band, scale_factor, CAST(CASE WHEN scale_factor < CASE WHEN most <= 29 THEN greatest(1, most // 6) ELSE 6 END OR scale_factor < coalesce(before, 0) - 30 THEN 0
ELSE greatest(1, least(7, CAST(trunc(scale_factor / 3.0::DOUBLE + 0.5) AS INTEGER))) END AS INTEGER) AS word_length FROM g""")
def word_length_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = A.band_scale_factors(embedded(spark, sf), "embedding", ["vec_id"]).drop("peak")
    return A.word_length_gate(f, ["vec_id"], F.col("scale_factor") / F.lit(3.0))


@query(f"""WITH {FACTORS}, r AS (SELECT vec_id, band, CAST(CAST(0.24::DOUBLE * (scale_factor - avg(scale_factor) OVER (PARTITION BY vec_id)) - 0.3::DOUBLE * log2(width::DOUBLE) AS FLOAT) AS DOUBLE) AS raw FROM factors)
SELECT vec_id, band, round(CASE WHEN band = 0 THEN greatest(raw, 6) WHEN band <= 3 THEN greatest(raw, 3) ELSE raw END, 6) AS calm,
round(CASE WHEN band = 0 THEN greatest(raw + 0.7::DOUBLE, 6) WHEN band <= 7 THEN raw + 0.7::DOUBLE WHEN band <= 17 THEN raw + 0.5 ELSE raw END, 6) AS struck FROM r""")
def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Allocation thresholds without and with an attack."""
    rows = A.in_bands(embedded(spark, sf), "embedding", ["vec_id"]).withColumn("scale_factor", S.scale_index(A.peak(F.col("xs")))).drop("xs")
    calm = A.thresholds(rows, ["vec_id"], F.lit(False)).withColumnRenamed("threshold", "calm")
    both = A.thresholds(calm, ["vec_id"], F.lit(True))
    return both.select("vec_id", "band", F.round("calm", 6).alias("calm"), F.round("threshold", 6).alias("struck"))


@query("""WITH s AS (SELECT vec_id, slot, list_sum(list_transform(range(slot, len(embedding), 4), lambda i: abs(embedding[i + 1])::DOUBLE)) AS energy FROM embeddings, (VALUES (0), (1), (2), (3)) v(slot))
SELECT vec_id, slot, round(energy, 6) AS energy FROM s""")
def slot_energies(spark: SparkSession, sf: str) -> DataFrame:
    return A.slot_energies(embedded(spark, sf), "embedding", ["vec_id"]).select("vec_id", "slot", F.round("energy", 6).alias("energy"))


@query(f"""WITH {FACTORS} SELECT vec_id, band, scale_factor, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY scale_factor DESC, band) AS INTEGER) AS place FROM factors""")
def stable_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Bands by scale factor, lower bands first among equals."""
    f = A.band_scale_factors(embedded(spark, sf), "embedding", ["vec_id"]).drop("peak")
    return f.withColumn("place", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("scale_factor"), "band")))


@query("""WITH b AS (SELECT s_suppkey, CAST(s_acctbal AS BIGINT) AS seed FROM supplier),
c AS (SELECT DISTINCT s_suppkey, seed, greatest(0, least(1133, seed + d)) AS budget FROM b, (VALUES (0), (-64), (-128), (-256), (-512), (-1024)) v(d))
SELECT s_suppkey, budget FROM c""")
def budget_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets to try around a seed, each once."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.bround("s_acctbal").cast("long").alias("seed"))
    return rows.select("s_suppkey", F.explode(S.budgets_around(F.col("seed"), 1133)).alias("budget"))


@query(f"""WITH {MEASURES}, p AS (SELECT d.vec_id, d.band AS donor, r.band AS receiver, round(r.energy - d.energy, 9) AS gain FROM m d JOIN m r ON d.vec_id = r.vec_id AND d.band <> r.band)
SELECT vec_id, donor, receiver, gain FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gain DESC, donor, receiver) = 1""")
def mode_exchange_best(spark: SparkSession, sf: str) -> DataFrame:
    """The pair of bands between which an exchange gains most: the pairs of one spectrum's few bands stay in its row."""
    m = A.band_measures(embedded(spark, sf), "embedding", ["vec_id"]).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("band", "energy"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda d: F.transform(F.filter("x", lambda r: r["band"] != d["band"]), lambda r: F.struct((-F.round(r["energy"] - d["energy"], 9)).alias("g"), d["band"].alias("donor"), r["band"].alias("receiver")))))
    best = m.select("vec_id", F.array_min(pairs).alias("b"))
    return best.select("vec_id", "b.donor", "b.receiver", (-F.col("b.g")).alias("gain"))


# --- Containers, code lengths, gain, stereo ------------------------------------------------------------------------


def little(value: str, size: int) -> str:
    """SQL for a number's bytes, lowest first, as hexadecimal text."""
    return " || ".join(f"printf('%02X', CAST(({value} >> {8 * i}) & 255 AS INTEGER))" for i in range(size))


@query(
    f"WITH n AS (SELECT l_suppkey AS stream_id, count(*) AS samples, 4 + CAST(greatest(0, ceil((count(*) - 69) / 1024.0) - 1) AS BIGINT) AS frames FROM lineitem GROUP BY 1), s AS (SELECT *, frames * 304 AS data FROM n) "
    f"SELECT stream_id, 'RIFF' || {little('(72 + data)', 4)} || 'WAVEfmt ' || {little('32', 4)} || {little('624', 2)} || {little('2', 2)} || {little('44100', 4)} || {little('13092', 4)} || {little('304', 2)} || "
    f"{little('0', 2)} || {little('14', 2)} || {little('1', 2)} || {little('4096', 4)} || {little('0', 2)} || {little('0', 2)} || {little('1', 2)} || {little('0', 2)} || 'fact' || {little('12', 4)} || {little('samples', 4)} || "
    f"{little('1024', 4)} || {little('1024', 4)} || 'data' || {little('data', 4)} AS header FROM s"
)
def wave_header_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The coded file's header for each stream, from its number of samples: chunk names as text, numbers as bytes."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stream_id")).agg(F.count(F.lit(1)).alias("samples"))
    n = n.withColumn("data", FR.frame_count(F.col("samples")) * 304)

    def num(value, size: int):
        v = value if not isinstance(value, int) else F.lit(value)
        return F.concat(*[F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])

    fields = ["RIFF", (72 + F.col("data"), 4), "WAVEfmt ", (32, 4), (624, 2), (2, 2), (44100, 4), (13092, 4), (304, 2), (0, 2), (14, 2), (1, 2), (4096, 4), (0, 2), (0, 2), (1, 2), (0, 2), "fact", (12, 4), (F.col("samples"), 4), (1024, 4), (1024, 4), "data", (F.col("data"), 4)]
    return n.select("stream_id", F.concat(*[F.lit(x) if isinstance(x, str) else num(*x) for x in fields]).alias("header"))


LENGTH_CASE = "[" + ", ".join(str(codebook(0, 5)[(v,)][1]) for v in range(-7, 8)) + "]"


@query(f"WITH {NORMAL}, q AS (SELECT vec_id, band, {SYMBOL.format(zero=ZERO)} AS q FROM lines) SELECT vec_id, band, CAST(6 + sum({LENGTH_CASE}[q + 8]) AS INTEGER) AS bits, CAST(6 + 4 * count(*) AS INTEGER) AS fixed_bits FROM q GROUP BY ALL")
def huffman_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each band's symbols at word length 5 in both code families, with the scale factor's six."""
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(5), S.dead_zone(F.lit(3), F.lit(5))))
    return normal_bands(spark, sf).select("vec_id", "band", q.alias("q")).select("vec_id", "band", (6 + code_bits(F.col("q"), 0, 5)).alias("bits"), (6 + code_bits(F.col("q"), 1, 5)).alias("fixed_bits"))


@query(f"WITH {NORMAL}, q AS (SELECT vec_id, band, place // 2 AS pair, place, greatest(-1, least(1, CAST(trunc(n * 1.5::DOUBLE + 31.5) AS BIGINT) - 31)) AS q FROM lines), p AS (SELECT vec_id, band, pair, arg_min(q, place) AS a, arg_max(q, place) AS b FROM q GROUP BY ALL) SELECT vec_id, band, CAST(6 + sum(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 THEN 3 WHEN b = 0 THEN 4 ELSE 5 END) AS INTEGER) AS bits FROM p GROUP BY ALL")
def huffman_pair_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits at word length 1, which codes pairs."""
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(1), F.lit(-1.0)))
    return normal_bands(spark, sf).select("vec_id", "band", q.alias("q")).select("vec_id", "band", (6 + code_bits(F.col("q"), 0, 1)).alias("bits"))


@query(f"""WITH {POINTS}, g AS (SELECT l_orderkey, levels, list_transform(locations, lambda v: v % 32) AS locations FROM points WHERE len(levels) <= 7),
s AS (SELECT l_orderkey, step, list_filter(range(1, len(levels) + 1), lambda i: locations[i] + 32 >= step AND i = list_min(list_filter(range(1, len(levels) + 1), lambda k: locations[k] + 32 >= step)))[1] AS i, levels FROM g, range(64) r(step))
SELECT l_orderkey, CAST(step AS INTEGER) AS step, CAST(coalesce(4 - levels[i], 0) AS INTEGER) AS gain FROM s""")
def gain_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Exponent of the gain envelope in each of a frame's 64 steps, for a record that begins a stream: the level of the
    first point at or behind the step."""
    p = points(spark, sf).where(F.size("levels") <= 7).select("l_orderkey", "levels", F.transform("locations", lambda v: v % 32).alias("locations"))
    first = lambda s: F.get(F.filter(F.arrays_zip(F.col("locations").alias("at"), F.col("levels").alias("level")), lambda x: x["at"] + 32 >= s), F.lit(0))["level"]
    steps = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.struct(s.alias("step"), F.coalesce(4 - first(s), F.lit(0)).alias("gain")))
    return p.select("l_orderkey", F.explode(steps).alias("x")).select("l_orderkey", "x.step", "x.gain")


@query(f"""WITH {STEREO}, f AS (SELECT stream_id, CAST(sample_no // {SIZE} AS BIGINT) AS frame_no, CAST(sample_no % 4 AS INTEGER) AS slot, sum(abs(l)::DOUBLE) AS le, sum(abs(r)::DOUBLE) AS re FROM stereo GROUP BY ALL)
SELECT stream_id, frame_no, slot, round(le, 6) AS left_energy, round(re, 6) AS right_energy,
CASE WHEN 19.697716::FLOAT::DOUBLE * le >= re THEN CASE WHEN 19.697716::FLOAT::DOUBLE * re >= le THEN CASE WHEN le + re < 4791991795712::DOUBLE THEN -3 ELSE 3 END ELSE 1 END ELSE 0 END AS mode FROM f""")
def stereo_dominance(spark: SparkSession, sf: str) -> DataFrame:
    """Stereo mode of each frame's slots from the channels' magnitudes: left or right dominant, balanced, or silent."""
    from numpy import float32

    k = float(float32(19.697716))
    f = stereo(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no"), (F.col("sample_no") % 4).cast("int").alias("slot"))
    f = f.agg(F.sum(F.abs("l").cast("double")).alias("le"), F.sum(F.abs("r").cast("double")).alias("re"))
    balanced = F.when(F.isnan(F.col("le") + F.col("re")) | (F.col("le") + F.col("re") < 4791991795712.0), -3).otherwise(3)
    mode = F.when(k * F.col("le") >= F.col("re"), F.when(k * F.col("re") >= F.col("le"), balanced).otherwise(1)).otherwise(0)
    return f.select("stream_id", "frame_no", "slot", F.round("le", 6).alias("left_energy"), F.round("re", 6).alias("right_energy"), mode.alias("mode"))


TAP_ROWS = ", ".join(f"({i}, {float(v)!r}::DOUBLE)" for i, v in enumerate(filter_taps()))


@query(f"""WITH {SIGNAL}, taps(t, c) AS (VALUES {TAP_ROWS}), o AS (SELECT stream_id, sample_no // 2 AS n FROM signal WHERE sample_no % 2 = 1),
p AS (SELECT o.stream_id, o.n, sum(CASE WHEN t % 2 = 1 THEN s.x * c ELSE 0 END) AS even, sum(CASE WHEN t % 2 = 0 THEN s.x * c ELSE 0 END) AS odd
FROM o JOIN taps ON TRUE JOIN signal s ON s.stream_id = o.stream_id AND s.sample_no = 2 * o.n - 46 + t GROUP BY ALL)
SELECT stream_id, CAST(n AS BIGINT) AS n, round(even + odd, 4) AS low, round(even - odd, 4) AS high FROM p""")
def qmf_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Low and high half-band of each stream. An output reads the 48 samples up to it, so a bounded window gives them."""
    w = W.partitionBy("stream_id").orderBy("sample_no").rowsBetween(-47, 0)
    rows = signal(spark, sf).withColumn("xs", F.collect_list("x").over(w)).where("sample_no % 2 = 1")
    taps = F.array(*[F.lit(float(v)) for v in filter_taps()])
    # The first outputs lack earlier samples, which count as zeros.
    mine = F.slice(taps, 49 - F.size("xs"), F.size("xs"))
    part = lambda r: F.aggregate(F.filter(F.zip_with("xs", mine, lambda x, c: x * c), lambda _, i: F.pmod(i + 48 - F.size("xs"), F.lit(2)) == r), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("stream_id", F.floor(F.col("sample_no") / 2).cast("long").alias("n"), part(1).alias("even"), part(0).alias("odd"))
    return rows.select("stream_id", "n", F.round(F.col("even") + F.col("odd"), 4).alias("low"), F.round(F.col("even") - F.col("odd"), 4).alias("high"))


# --- Transforms over whole frames (beyond SQL; held against known checksums by the tests) --------------------------


def long_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers' signals of each nation one after another, in frames of 1024."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("stream_id"), (F.col("l_extendedprice") / 4 - 8192).cast("float").alias("x"), *ORDER, "l_suppkey")
    rows = FR.number_samples(rows, "stream_id", ["l_suppkey", *ORDER])
    return FR.frames(rows.select("stream_id", "sample_no", "x"), "stream_id", ["x"]).select("stream_id", "frame_no", F.col("x").alias("samples"))


@query()
def subband_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Energy of the four bands of each frame."""
    b = spectral.subbands(long_frames(spark, sf), ["stream_id"])
    return b.select("stream_id", "frame_no", *[F.round(A.total(F.col(f"b{i}"), lambda x: x * x), 3).alias(f"energy_{i}") for i in range(4)])


@query()
def mdct_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Scale factor of each band of each frame's spectrum."""
    s = spectral.spectra(spectral.subbands(long_frames(spark, sf), ["stream_id"]), ["stream_id"])
    return A.band_scale_factors(s, "lines", ["stream_id", "frame_no"])


# --- Coding of layers and frames -----------------------------------------------------------------------------------


def spectra_with_factors(spark: SparkSession, sf: str) -> DataFrame:
    bands = F.array(*[F.lit(e) for e in BAND_EDGES[:8]])
    return embedded(spark, sf).select("vec_id", "embedding", F.transform(bands, lambda s: S.scale_index(A.peak(F.slice("embedding", s + 1, 8)))).alias("factors"))


def numbers(values) -> str:
    """SQL list of numbers."""
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


RESIDUAL_SCALES = "[" + ", ".join(numbers(residual.quantizer_scale(m, f) for f in range(64)) for m in residual.MODES) + "]"
RESIDUAL_LENGTHS = "[" + ", ".join(str([int(n) for n in residual.tables(m)[0]]) for m in residual.MODES) + "]"
RESIDUAL_VALUES = "[" + ", ".join("[" + ", ".join(numbers(v) for v in residual.tables(m)[1]) + "]" for m in residual.MODES) + "]"


@query(f"""WITH {FACTORS}, modes(mode, n) AS (VALUES (0, 1), {", ".join(f"({m}, {1 << residual.SYMBOL_BITS[m]})" for m in residual.MODES)}),
s AS (SELECT vec_id, band, mode, xs, {SCALE_LIST}[scale_factor + 1] AS scale,
  CASE WHEN mode = 0 THEN [] ELSE list_transform(xs, lambda x: ((CAST(round_even(x::DOUBLE * {RESIDUAL_SCALES}[mode][scale_factor + 1], 0) AS BIGINT) % n) + n) % n) END AS s FROM factors, modes),
c AS (SELECT *, CASE WHEN mode = 1 THEN list_transform(range(1, len(s), 2), lambda i: s[i] * 4 + s[i + 1]) ELSE s END AS codes FROM s),
v AS (SELECT *, CASE WHEN mode = 0 THEN list_transform(xs, lambda x: 0.0::DOUBLE) ELSE flatten(list_transform(codes, lambda k: {RESIDUAL_VALUES}[mode][k + 1])) END AS parts FROM c)
SELECT vec_id, CAST(band AS INTEGER) AS band, CAST(mode AS INTEGER) AS mode, CAST(CASE WHEN mode = 0 THEN 0 ELSE 6 + list_sum(list_transform(codes, lambda k: {RESIDUAL_LENGTHS}[mode][k + 1])) END AS INTEGER) AS bits,
  round(list_sum(list_transform(range(1, len(xs) + 1), lambda i: pow(xs[i]::DOUBLE - CAST(CAST(parts[i] AS FLOAT) * CAST(scale AS FLOAT) AS FLOAT)::DOUBLE, 2))), 6) AS error FROM v""")
def residual_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Bits and error of each band and mode at the band's own scale factor."""
    return residual.band_costs(spectra_with_factors(spark, sf), ["vec_id"], "embedding", "factors").withColumn("error", F.round("error", 6))


@query()
def stereo_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Stereo modes, hints, ratios and selectors of each stream's frames."""
    rows = stereo(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no"))
    sums = [F.sum(F.when(F.col("sample_no") % 4 == i, F.abs(c).cast("double")).otherwise(0.0)) for c in ("l", "r") for i in range(4)]
    return layers.stereo_plan(rows.agg(F.array(*sums[:4]).alias("left"), F.array(*sums[4:]).alias("right")), 1)


@query(f"WITH {NORMAL}, q AS (SELECT vec_id, {SYMBOL.format(zero=ZERO)} AS q FROM lines) SELECT vec_id, CAST(channel AS INTEGER) AS channel, CAST(8 + 3 + 5 + 6 + 8 * 3 + 8 * 6 + sum({LENGTH_CASE}[q + 8]) AS INTEGER) AS bits FROM q, (VALUES (0), (1)) c(channel) GROUP BY ALL")
def coded_frame_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of two channels written from quantized bands, read back: bits of each channel, which the tables of code
    lengths foretell."""
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(5), S.dead_zone(F.lit(3), F.lit(5))))
    rows = normal_bands(spark, sf).select("vec_id", F.struct("band", "scale_factor", q.alias("q")).alias("x")).groupBy("vec_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = rows.select("vec_id", F.transform("x", lambda b: b["scale_factor"]).alias("factors"), F.flatten(F.transform("x", lambda b: b["q"])).alias("symbols"))
    return syntax.parsed_frames(syntax.written_frames(rows, ["vec_id"], 5, 384), ["vec_id"], 384, False).select("vec_id", "channel", "bits")


# --- Checks, offsets and small functions ---------------------------------------------------------------------------


@query(f"""WITH {STEREO}, f AS (SELECT stream_id, CAST(sample_no // {SIZE} AS BIGINT) AS frame_no, count(l) AS nl, count(CASE WHEN r > 0 THEN r END) AS nr FROM stereo GROUP BY ALL)
SELECT stream_id, frame_no, CASE WHEN nl <> nr THEN 'unequal channels' WHEN nl <> {SIZE} THEN 'incomplete' END AS error FROM f""")
def frame_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a chunk before any state moves: channels of unequal length, or too few samples."""
    f = stereo(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("frame_no"))
    f = f.agg(F.collect_list("l").alias("left"), F.collect_list(F.when(F.col("r") > 0, F.col("r"))).alias("right"))
    return f.select("stream_id", "frame_no", S.frame_error(F.col("left"), F.col("right"), SIZE).alias("error"))


@query("""WITH n AS (SELECT l_suppkey AS stream_id, [192, 304, 384][1 + l_suppkey % 3] AS size, 4 + CAST(greatest(0, ceil((count(*) - 69) / 1024.0) - 1) AS BIGINT) AS frames FROM lineitem GROUP BY 1, 2),
f AS (SELECT stream_id, size, unnest(range(frames)) AS frame_no FROM n) SELECT stream_id, frame_no, 80 + size * frame_no AS first_byte, 80 + size * (frame_no + 1) AS end_byte FROM f""")
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each frame of a coded file of each profile lies."""
    k = F.col("stream_id") % 3
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stream_id")).agg(FR.frame_count(F.count(F.lit(1))).alias("frames"))
    f = n.select("stream_id", F.when(k == 0, 192).when(k == 1, 304).otherwise(384).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame_no"))
    first, end = S.frame_bytes(F.col("frame_no"), F.col("size"))
    return f.select("stream_id", "frame_no", first.alias("first_byte"), end.alias("end_byte"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(-100, least(100, CAST(l_quantity AS BIGINT) * 5 - 120)) AS clamped,
round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END, 9) AS error_share,
CAST(trunc(log10(greatest(l_extendedprice, 1e-20)) / log10(2.0::DOUBLE) + 0.5) AS INTEGER) AS log2_price, l_discount < l_tax AS less FROM lineitem""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded arithmetic, error shares, rounded logarithms and comparisons that count what is not a number as less."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.clamp(F.col("l_quantity").cast("long") * 5 - 120, -100, 100).alias("clamped"),
        F.round(S.normalized_error(F.col("l_tax"), F.col("l_discount")), 9).alias("error_share"),
        S.gain_log2_round(F.col("l_extendedprice")).alias("log2_price"),
        S.unordered_less(F.col("l_discount"), F.col("l_tax")).alias("less"),
    )


@query(f"SELECT p_partkey, p_size, round({SCALE_LIST}[p_size + 1], 9) AS scale FROM part")
def scale_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral scale of an index."""
    return table(spark, sf, "part").select("p_partkey", "p_size", F.round(S.scale_at(F.col("p_size")), 9).alias("scale"))


@query(f"""WITH {POINTS} SELECT l_orderkey, CAST(coalesce(list_max(list_transform(range(1, len(levels) + 1), lambda i: CASE WHEN levels[i] % 8 > 2 THEN i ELSE 0 END)), 0) AS INTEGER) AS bands FROM points""")
def active_band_count(spark: SparkSession, sf: str) -> DataFrame:
    """Bands up to the last one with a word length."""
    w = F.transform("levels", lambda v: F.when(v % 8 > 2, v % 8).otherwise(0))
    return points(spark, sf).select("l_orderkey", S.active_bands(w).alias("bands"))


@query(f"""WITH g AS (SELECT vec_id, unnest(range(0, len(embedding), 4)) AS s, embedding FROM embeddings),
f AS (SELECT vec_id, CAST(s // 4 AS INTEGER) AS group_no, {scale_sql('list_max(list_transform(list_slice(embedding, s + 1, s + 4), lambda v: abs(v)))')} AS factor FROM g),
m AS (SELECT *, avg(factor) OVER (PARTITION BY vec_id) AS mean FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, group_no // 16 ORDER BY group_no) AS place FROM m WHERE factor > mean + 2)
SELECT vec_id, group_no, factor FROM r WHERE place <= 7""")
def tone_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of four lines that stand out above the mean scale factor, seven at most in each block of 64 lines."""
    return A.tone_groups(embedded(spark, sf), "embedding", ["vec_id"])



@query(f"""WITH {POINTS}, a AS (SELECT l_orderkey, greatest(list_max(levels), 4) - least(list_min(levels), 4) >= 3 AS attack FROM points)
SELECT l_orderkey, attack, attack OR coalesce(lag(attack) OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey), FALSE) AS near_attack FROM a""")
def attack_history(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record or the one before it in its stream is an attack."""
    a = points(spark, sf).select("l_orderkey", S.is_attack(F.col("levels")).alias("attack"))
    return A.near_attacks(a, F.col("l_orderkey") % 50, "l_orderkey")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS FLOAT)::DOUBLE AS x FROM lineitem), e AS (SELECT *, CAST(floor(log2(x)) AS INTEGER) AS e FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CAST((e + 127) * 8388608 + (x / pow(2.0::DOUBLE, e) - 1) * 8388608 AS BIGINT) AS image, CAST(x AS FLOAT) AS back FROM e""")
def float_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of single-precision numbers, and the numbers of these."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.float32_to_bits(F.col("l_extendedprice")).alias("image"))
    return rows.withColumn("back", S.float32_from_bits(F.col("image")))


@query("""SELECT p_partkey, printf('%04X', CAST((p_size % 64) * 1024 + (p_partkey % 32) * 32 + (p_partkey % 2) * 16 AS INTEGER)) AS packed FROM part""")
def bit_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of 6, 5 and 1 bits in bytes."""
    fields = [(F.col("p_size") % 64, 6), (F.col("p_partkey") % 32, 5), (F.col("p_partkey") % 2, 1)]
    return table(spark, sf, "part").select("p_partkey", F.hex(B.pack_bits(fields)).alias("packed"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 8 AS INTEGER) AS mode, CAST(p_size % 32 AS INTEGER) AS band, CAST(p_partkey * 97 % 100000 - 50000 AS INTEGER) AS v, (p_retailprice - 1200) * 3000000 AS x FROM part)
SELECT p_partkey, greatest(-32768, least(32767, v)) AS int16, greatest(-[0, 1, 2, 3, 4, 7, 15, 31][mode + 1], least([0, 1, 2, 3, 4, 7, 15, 31][mode + 1], v)) AS symbol,
CAST(CASE WHEN x > -2147483649 AND x < 2147483648 THEN trunc(x) ELSE -2147483648 END AS INTEGER) AS whole, x <= 0 AS less_equal,
[0, 3, 5, 7, 9, 12, 15, 18][mode + 1] AS step, CASE WHEN mode > 0 THEN 6 + (((""" + "[" + ", ".join(str(z - a) for a, z in zip(BAND_EDGES, BAND_EDGES[1:], strict=False)) + """])[band + 1] >> 1) * [0, 1, 2, 2, 2, 4, 6, 6][mode + 1]) END AS least_bits FROM p""")
def bounded_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of samples, symbols and whole numbers, and steps and least bits of residual modes."""
    rows = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 8).cast("int").alias("mode"), (F.col("p_size") % 32).cast("int").alias("band"), (F.col("p_partkey") * 97 % 100000 - 50000).cast("int").alias("v"), ((F.col("p_retailprice") - 1200) * 3000000).alias("x")
    )
    mode = F.col("mode")
    return rows.select(
        "p_partkey", S.clamp_int16(F.col("v")).alias("int16"), S.clamp_symbol(F.col("v"), mode).alias("symbol"), S.truncate_to_int32(F.col("x")).alias("whole"), S.unordered_less_equal(F.col("x"), F.lit(0.0)).alias("less_equal"),
        S.step_of_mode(mode).alias("step"), F.when(mode > 0, S.least_band_bits(mode, S.band_width(F.col("band")))).alias("least_bits"),
    )


@query("""WITH r AS (SELECT p_partkey, p_size, CAST(p_retailprice / 1000 AS FLOAT) AS ratio FROM part)
SELECT p_partkey, CAST(floor(log2(CAST(ratio * CAST(1.4142135381698608 AS FLOAT) AS DOUBLE))) AS INTEGER) AS steps, CAST(least(greatest(0, p_size - 10), 10 - p_size % 8) AS INTEGER) AS bounded FROM r""")
def gain_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Whole gain steps of a ratio, and steps within what is left of a limit."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 1000).alias("ratio"))
    return rows.select("p_partkey", S.gain_steps_for_ratio(F.col("ratio")).cast("int").alias("steps"), S.bounded_gain_step(F.col("p_size") - 10, F.col("p_size") % 8, 10).cast("int").alias("bounded"))


# --- Whole streams -------------------------------------------------------------------------------------------------


COUNTED = "n AS (SELECT user_id AS stream_id, count(*) AS n FROM events GROUP BY 1), f AS (SELECT stream_id, n, 4 + CAST(greatest(0, ceil((n - 69) / 1024.0) - 1) AS BIGINT) AS frames FROM n)"


def coded_streams(spark: SparkSession, sf: str, bitrate: int) -> DataFrame:
    rows = stereo(spark, sf)
    coded = codec.encoded_streams(rows.select("stream_id", "sample_no", F.col("l").alias("left"), F.col("r").alias("right")), "stream_id", bitrate)
    return coded.join(rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("sample_count")), "stream_id")


@query(f"WITH {COUNTED} SELECT stream_id, frames, frames * 384 AS n_bytes, 0 AS first_no, frames - 1 AS last_no FROM f")
def encoded_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Two-channel streams coded at 132 kbps: frames and bytes of each."""
    return coded_streams(spark, sf, 132).groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("bytes")).alias("n_bytes"), F.min("frame_no").cast("int").alias("first_no"), F.max("frame_no").alias("last_no"))


@query(f"WITH {COUNTED} SELECT stream_id, n AS expected, n AS samples, CAST(0 AS BIGINT) AS first_no, CAST(0 AS BIGINT) AS errors FROM n")
def decoded_streams(spark: SparkSession, sf: str) -> DataFrame:
    """The same streams at 105 kbps and back: the timeline shows every sample once."""
    coded = coded_streams(spark, sf, 105).withColumn("align", F.lit(1024))
    shown = codec.decoded_streams(coded, "stream_id", 105).groupBy("stream_id").agg(F.sum(F.size("left")).alias("samples"), F.min("sample_no").alias("first_no"), F.count("error").alias("errors"))
    expected = stereo(spark, sf).groupBy("stream_id").agg(F.count(F.lit(1)).alias("expected"))
    return expected.join(shown, "stream_id").select("stream_id", "expected", "samples", "first_no", "errors")


@query(f"WITH {COUNTED} SELECT stream_id, 66 AS bitrate_kbps, frames AS frame_count, n AS sample_count, CAST(1024 AS BIGINT) AS alignment, CAST(80 + 192 * frames AS INTEGER) AS n_bytes FROM f")
def coded_images(spark: SparkSession, sf: str) -> DataFrame:
    """Each stream as a joint coded image at 66 kbps, and what its header says."""
    images = wave.coded_images(coded_streams(spark, sf, 66), "stream_id", 66, "sample_count")
    m = wave.wave_metadata(images, "content", ("stream_id", "content"))
    return m.select("stream_id", "bitrate_kbps", "frame_count", "sample_count", F.col("alignment_sample_count").alias("alignment"), F.length("content").alias("n_bytes"))


@query(f"""WITH {STEREO}, s AS (SELECT stream_id, sample_no, greatest(-32767, least(32767, CAST(round_even(CAST(l * 32768::FLOAT AS DOUBLE), 0) AS BIGINT))) AS a FROM stereo)
SELECT stream_id, CAST(44 + 4 * count(*) AS INTEGER) AS n_bytes, 'RIFF' || printf('%08X', CAST(36 + 4 * count(*) AS INTEGER)) AS head, printf('%04X', CAST(arg_min(a, sample_no) & 65535 AS INTEGER)) AS first_left FROM s GROUP BY 1""")
def pcm_images(spark: SparkSession, sf: str) -> DataFrame:
    """Each stream as a 16-bit image: its size, the size that its header names, and its first sample."""
    rows = stereo(spark, sf).select("stream_id", "sample_no", F.array("l").alias("left"), F.array("r").alias("right"))
    images = wave.pcm_images(rows, "stream_id")
    turned = lambda at, n: F.concat(*[F.hex(F.expr(f"substring(content, {at + n - i}, 1)")) for i in range(n)])
    return images.select("stream_id", F.length("content").alias("n_bytes"), F.concat(F.expr("CAST(substring(content, 1, 4) AS STRING)"), turned(4, 4)).alias("head"), turned(44, 2).alias("first_left"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size % 32 AS INTEGER) AS location, CAST(p_partkey % 16 AS INTEGER) AS level FROM part), q AS (SELECT *, 8 * level + (4 - level) * 4 AS place, 8 * level + (4 - level) * CASE WHEN location = 31 THEN 7 ELSE 8 END AS rear FROM p)
SELECT p_partkey, location, level, round(pow(2.0::DOUBLE, 4 - level), 6) AS first_factor, round(pow(2.0::DOUBLE, -(place % 8) / 8.0::DOUBLE) * pow(2.0::DOUBLE, 4 - place // 8), 6) AS half_way,
round(pow(2.0::DOUBLE, -(rear % 8) / 8.0::DOUBLE) * pow(2.0::DOUBLE, 4 - rear // 8), 6) AS last_factor FROM q""")
def inverse_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """What a gain point makes of a band of ones: its level at the front, the ramp half-way, and the band's end."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 32).cast("int").alias("location"), (F.col("p_partkey") % 16).cast("int").alias("level"))
    rows = rows.withColumn("points", F.array(F.struct("location", "level"))).withColumn("band", F.array_repeat(F.lit(1.0).cast("float"), 256))
    out = synthesis.enveloped_bands(rows, ["p_partkey", "location", "level"], "points", "band")
    at = lambda i: F.round(F.get("band", i).cast("double"), 6)
    return out.select("p_partkey", "location", "level", at(F.lit(0)).alias("first_factor"), at(8 * F.col("location") + 4).alias("half_way"), at(F.lit(255)).alias("last_factor"))


@query(f"""WITH {STEREO}, c AS (SELECT *, sample_no % {SIZE} AS place, sample_no // {SIZE} AS chunk FROM stereo),
w AS (SELECT *, CASE WHEN place < 8 THEN CAST(CAST(CAST((place - 8) AS FLOAT) * 0.5::FLOAT AS FLOAT) * 0.125::FLOAT AS FLOAT) + 1::FLOAT ELSE 1::FLOAT END AS g FROM c),
b AS (SELECT *, CAST(CAST(g * l AS FLOAT) + CAST(g * r AS FLOAT) AS FLOAT) AS blend FROM w)
SELECT stream_id, sample_no, CAST(2::FLOAT * blend AS FLOAT) AS "left", CAST(CAST(l - blend AS FLOAT) * 2::FLOAT AS FLOAT) AS "right" FROM b""")
def joint_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Both channels out of the coded two, as the weights move from a half to one over a frame's first eight samples."""
    rows = stereo(spark, sf).groupBy("stream_id", F.floor(F.col("sample_no") / SIZE).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("sample_no", "l", "r"))).alias("x"))
    full = lambda c: F.concat(F.transform("x", lambda s: s[c]), F.array_repeat(F.lit(0.0).cast("float"), SIZE - F.size("x")))
    rows = rows.select("stream_id", "chunk", F.size("x").alias("n"), full("l").alias("first"), full("r").alias("second"))
    out = synthesis.mixed_bands(rows, ["stream_id", "chunk", "n"], synthesis.Mix((1, 3, 3, 3)), synthesis.Mix(), 0)
    out = out.select("stream_id", "chunk", "n", F.posexplode(F.arrays_zip("left", "right")).alias("i", "s")).where("i < n")
    return out.select("stream_id", (F.col("chunk") * SIZE + F.col("i")).alias("sample_no"), F.col("s.left").alias("left"), F.col("s.right").alias("right"))


@query(f"WITH {COUNTED} SELECT stream_id, CAST(ceil(n / 1024.0) AS BIGINT) AS frames, TRUE AS restored FROM n")
def restored_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Filter bank and block transform forwards and back: each stream's samples return, late by a frame and the filters' length."""
    rows = stereo(spark, sf).select("stream_id", "sample_no", "l")
    framed = FR.frames(rows, "stream_id", ["l"], 1024, 0).select("stream_id", (F.col("frame_no") - 1).alias("frame_no"), F.transform("l", lambda x: x * F.lit(1024.0).cast("float")).alias("samples"))
    return spectral.restored(framed, ["stream_id"])


@query(f"WITH {COUNTED} SELECT stream_id, CAST(ceil(n / 1024.0) AS BIGINT) AS frames, TRUE AS agree FROM n")
def layered_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The lower bit rates' filter bank against the other one: bands have the same energies, up to the first tap's square."""
    rows = stereo(spark, sf).select("stream_id", "sample_no", "l")
    framed = FR.frames(rows, "stream_id", ["l"], 1024, 0).select("stream_id", "frame_no", F.transform("l", lambda x: x * F.lit(1024.0).cast("float")).alias("samples"))
    energy = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    one = spectral.subbands(framed, ["stream_id"]).select("stream_id", "frame_no", *[energy(F.col(f"b{i}")).alias(f"e{i}") for i in range(4)])
    other = spectral.layered_subbands(framed, ["stream_id"])
    of_band = lambda b: F.filter("lines", lambda _, i: i % 4 == b)
    parts = [energy(of_band(b)).alias(f"o{b}") for b in range(4)]
    both = one.join(other.select("stream_id", "frame_no", *parts), ["stream_id", "frame_no"])
    tap = HALF_FILTER[0] ** 4
    near = S.all_of([F.abs(F.col(f"o{b}") * tap - F.col(f"e{b}")) <= 1e-3 * (F.col(f"e{b}") + 1e-3 * (F.col("e0") + F.col("e1") + F.col("e2") + F.col("e3"))) for b in range(4)])
    return both.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.bool_and(near).alias("agree"))


@query()
def gain_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Gain records of each supplier's prices read as bands of 768 samples."""
    x = signal(spark, sf).where("sample_no < 768").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", "x"))).alias("x"))
    one = F.concat(F.transform("x", lambda p: (p["x"] / 10).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), 768 - F.size("x")))
    rows = x.select(F.lit(0).alias("all"), F.col("stream_id").alias("frame_no"), F.array(one, F.reverse(one)).alias("windows"))
    found = gains.planned_records(rows, ["all"])
    return found.select(F.col("frame_no").alias("stream_id"), F.size(F.flatten(F.transform("records", lambda r: r["points"]))).alias("points"), F.transform("records", lambda r: r["peak"]).alias("peaks"))


@query(f"""WITH {NORMAL}, q AS (SELECT vec_id, band, n, scale_factor, {SYMBOL.format(zero=ZERO)} AS q FROM lines)
SELECT vec_id, band, round(sum((n - q / 7.5::DOUBLE) * (n - q / 7.5::DOUBLE)), 6) AS error FROM q GROUP BY ALL""")
def band_error(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of each band's normalised lines at word length 5."""
    q = F.transform("ns", lambda n: S.quantize(n.cast("double"), F.lit(5), S.dead_zone(F.lit(3), F.lit(5))))
    return normal_bands(spark, sf).select("vec_id", "band", F.round(S.reconstruction_error(F.col("ns"), q, F.lit(1.0), F.lit(5)), 6).alias("error"))


@query("""SELECT vec_id, CAST(40 + vec_id % 7 * 300 AS INTEGER) AS budget, TRUE AS fits, CAST(32 AS INTEGER) AS bands, TRUE AS any_coded FROM embeddings""")
def rate_control(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths of spectra within budgets from very small to ample: none takes more than it may."""
    rows = embedded(spark, sf).select("vec_id", F.flatten(F.array_repeat(F.transform("embedding", lambda v: v * F.lit(100.0).cast("float")), 16)).alias("lines"), (40 + F.col("vec_id") % 7 * 300).cast("int").alias("budget"))
    out = encoding.allocations(rows, ["vec_id", "budget"], "lines", "budget")
    coded = F.exists("word_lengths", lambda w: w > 0) | (F.col("budget") < 300)
    return out.select("vec_id", "budget", (F.col("bits") <= F.col("budget")).alias("fits"), F.size("word_lengths").alias("bands"), coded.alias("any_coded"))
