"""WAVE containers: PCM and coded, as Python data sources, parsers and writers.

Partitions are ranges of bytes of files in any file system that Arrow knows, so large files are read by many tasks, each of
which walks the chunk headers of its file. Columns that a query doesn't need are not decoded when only metadata is asked for
(``wave_metadata``). Writers put one file per stream: data first, then the header, when the totals are known."""

from __future__ import annotations

import fnmatch
import itertools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sonoframe.plans.dimensions import CHANNELS, DRAIN_FRAMES, FRAME, PROFILES, SAMPLE_RATE

#: Format tags.
PCM_TAG, EXTENSIBLE_TAG, CODED_TAG = 1, 0xFFFE, 0x0270
CODED_HEADER, PCM_HEADER = 80, 44
#: Blocks or frames of one read partition.
RANGE = 1 << 16


class WaveError(ValueError):
    """A file that isn't what its reader reads."""


@dataclass
class WaveInfo:
    tag: int
    channels: int
    sample_rate: int
    block: int
    bits: int
    mode_flag: int
    data_at: int
    data_bytes: int
    sample_count: int | None
    align: int | None

    @property
    def bitrate(self) -> int | None:
        if self.tag != CODED_TAG or self.channels != CHANNELS or self.sample_rate != SAMPLE_RATE:
            return None
        return next((b for b, n, s, _ in PROFILES if n == self.block and s == (2 if self.mode_flag else 1)), None)

    @property
    def frames(self) -> int:
        return self.data_bytes // self.block


def walk(read, size: int, coded: bool, need_fact: bool = False) -> WaveInfo:
    """Chunk headers of a file; ``read(at, n)`` gives its bytes. Odd chunks are padded to even length."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise WaveError("no RIFF/WAVE header")
    at, fmt, fact, data = 12, None, None, None
    while at + 8 <= size and not (fmt and data and not coded):
        kind, n = struct.unpack("<4sI", read(at, 8))
        body = at + 8
        if kind == b"fmt ":
            if n < 16:
                raise WaveError("short fmt chunk")
            fmt = read(body, min(n, 40))
        elif kind == b"fact" and n >= 12:
            fact = struct.unpack("<III", read(body, 12))
        elif kind == b"data":
            if data:
                raise WaveError("two data chunks")
            data = (body, size - body if n == 0 and not coded else n)
            if data[0] + data[1] > size:
                raise WaveError("data runs past the end")
        at = body + n + (n & 1)
    if not fmt or not data:
        raise WaveError("no fmt or data chunk")
    tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", fmt[:16])
    flag = 0
    if coded:
        if tag != CODED_TAG or len(fmt) < 32:
            raise WaveError("not a coded file")
        one, _, flag, again, last, zero = struct.unpack("<HIHHHH", fmt[18:32])
        if (one, again, last, zero) != (1, flag, 1, 0):
            raise WaveError("unknown extension")
        if need_fact and fact is None:
            raise WaveError("no fact chunk")
        if not block or data[1] % block:
            raise WaveError("data is not whole frames")
    else:
        if tag not in (PCM_TAG, EXTENSIBLE_TAG) or bits != 16 or channels not in (1, 2) or rate != SAMPLE_RATE or block != 2 * channels:
            raise WaveError("not 44.1 kHz PCM of 16 bits with one or two channels")
        if data[1] % block:
            raise WaveError("data is not whole samples")
    return WaveInfo(tag, channels, rate, block, bits, flag, *data, fact[0] if fact else None, fact[1] if fact else None)


def parse(image: bytes, coded: bool = True) -> WaveInfo:
    return walk(lambda at, n: image[at : at + n], len(image), coded)


def frames_of(image: bytes) -> Iterator[bytes]:
    info = parse(image)
    for i in range(info.frames):
        yield image[info.data_at + i * info.block : info.data_at + (i + 1) * info.block]


def coded_header(bitrate: int, data_bytes: int, align: int = FRAME, sample_count: int = 0) -> bytes:
    _, block, _, flag = next(p for p in PROFILES if p[0] == bitrate)
    per_second = (block * SAMPLE_RATE + FRAME // 2) // FRAME
    fmt = struct.pack("<HHIIHHHHIHHHH", CODED_TAG, CHANNELS, SAMPLE_RATE, per_second, block, 0, 14, 1, CHANNELS << 11, flag, flag, 1, 0)
    return struct.pack("<4sI4s4sI", b"RIFF", CODED_HEADER - 8 + data_bytes, b"WAVE", b"fmt ", len(fmt)) + fmt + struct.pack("<4sIIII4sI", b"fact", 12, sample_count, align, align, b"data", data_bytes)


def coded_wave(bitrate: int, frames: list[bytes], align: int = FRAME, sample_count: int | None = None) -> bytes:
    block = next(n for b, n, _, _ in PROFILES if b == bitrate)
    if any(len(f) != block for f in frames):
        raise WaveError(f"every frame takes {block} bytes")
    n = max(0, len(frames) - DRAIN_FRAMES) * FRAME if sample_count is None else sample_count
    return coded_header(bitrate, block * len(frames), align, n) + b"".join(frames)


def pcm_header(data_bytes: int, channels: int = CHANNELS) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", PCM_HEADER - 8 + data_bytes, b"WAVE", b"fmt ", 16, PCM_TAG, channels, SAMPLE_RATE, SAMPLE_RATE * channels * 2, channels * 2, 16, b"data", data_bytes)


def pcm16(x: np.ndarray) -> np.ndarray:
    """Samples of 16 bits: ties to even, within -32767 to 32767, -32767 for what is not a number."""
    scaled = x.astype(np.float32) * np.float32(32768)
    return np.nan_to_num(np.clip(np.rint(scaled), -32767, 32767), nan=-32767).astype("<i2")


def pcm_wave(left: np.ndarray, right: np.ndarray) -> bytes:
    data = np.stack([pcm16(left), pcm16(right)], 1).tobytes()
    return pcm_header(len(data)) + data


def planar(data: bytes, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right in -1 to 1; one channel serves as both."""
    x = (np.frombuffer(data, "<i2").astype(np.float32) / np.float32(32768)).reshape(-1, channels)
    return x[:, 0], x[:, -1]


@dataclass
class Range(InputPartition):
    """The blocks of a file whose first byte lies in a range of bytes."""

    path: str
    first: int
    last: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path there, of a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def files_in(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the .wav files of a folder, or of those that a pattern names in its folder."""
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    folder, _, name = path.rpartition("/")
    store, at = opened(folder if any(c in name for c in "*?[") else path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        pattern = name if any(c in name for c in "*?[") else "*.wav"
        found = [f for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(".")]
    else:
        found = []
    local = not scheme or scheme == "file://"
    host = "" if local else path[len(scheme) :].split("/")[0] if not isinstance(store, fs.LocalFileSystem) and path[len(scheme) :].split("/")[0] not in at else ""
    return sorted((f.path if local else f"{scheme}{host}{f.path}", f.size) for f in found)


def file_info(path: str, coded: bool, need_fact: bool = False) -> WaveInfo:
    store, at = opened(path)
    with store.open_input_file(at) as f:
        return walk(lambda a, n: f.read_at(min(n, max(0, f.size() - a)), a), f.size(), coded, need_fact)


class _Reader(DataSourceReader):
    """The driver lists files and their sizes only; each task reads the header of its own file."""

    coded = False
    #: Blocks that stay together.
    unit = FRAME

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range", RANGE)) * 4
        self.need_fact = options.get("needFact", "true") == "true"

    def partitions(self) -> list[Range]:
        return [Range(path, a, a + self.step if a + self.step < size else 1 << 62) for path, size in files_in(self.path) for a in range(0, max(size, 1), self.step)]

    def _blocks(self, p: Range) -> tuple[WaveInfo, int, bytes]:
        """Number of the range's first block, and the blocks' bytes."""
        info = file_info(p.path, self.coded, self.need_fact)
        number = lambda byte: min(info.frames, max(0, -(-(byte - info.data_at) // (info.block * self.unit))) * self.unit)
        first, last = number(p.first), number(p.last)
        store, at = opened(p.path)
        with store.open_input_file(at) as f:
            data = f.read_at((last - first) * info.block, info.data_at + first * info.block) if last > first else b""
        if len(data) != (last - first) * info.block:
            raise WaveError(f"{p.path} is cut short")
        return info, first, data


class PcmReader(_Reader):
    def read(self, p: Range):
        info, first, data = self._blocks(p)
        left, right = planar(data, info.channels)
        for i in range(0, len(left), FRAME):
            yield (p.path, first + i, left[i : i + FRAME].tolist(), right[i : i + FRAME].tolist())


class CodedReader(_Reader):
    coded, unit = True, 1

    def read(self, p: Range):
        info, first, data = self._blocks(p)
        for i in range(len(data) // info.block):
            yield (p.path, first + i, info.bitrate, info.sample_count, info.align, data[i * info.block : (i + 1) * info.block])


class _Message(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class _Writer(DataSourceWriter):
    """One file per stream. A task writes its rows to a part and then, when sizes are known, a file for each of its streams
    under a name of its attempt. The commit puts the files in place; it copies data only where a stream came from several
    tasks, one after another. ``by_stream`` brings each stream into one task."""

    order = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.options = dict(options)
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        if not overwrite and files_in(self.path):
            raise WaveError(f"{self.path} has files")

    def data(self, row) -> bytes:
        raise NotImplementedError

    def header(self, n_bytes: int, n_rows: int) -> bytes:
        raise NotImplementedError

    def write(self, rows: Iterator) -> _Message:
        attempt = TaskContext.get().taskAttemptId()
        store, at = opened(self.path)
        part, index, end = f"{at}/.{attempt}.part", {}, 0
        with store.open_output_stream(part, compression=None) as out:
            for r in rows:
                data = self.data(r)
                out.write(data)
                index.setdefault(str(r["stream_id"]), []).append((int(r[self.order]), end, len(data)))
                end += len(data)
        files = []
        with store.open_input_file(part) as old:
            for stream, mine in index.items():
                mine.sort()
                whole = f"{at}/.{stream}-{attempt}.new"
                n = sum(size for _, _, size in mine)
                with store.open_output_stream(whole, compression=None) as out:
                    out.write(self.header(n, len(mine)))
                    for _, where, size in mine:
                        out.write(old.read_at(size, where))
                files.append((mine[0][0], mine[-1][0], stream, whole, n, len(mine)))
        store.delete_file(part)
        return _Message(files)

    def commit(self, messages: list) -> None:
        store, at = opened(self.path)
        streams: dict[str, list] = {}
        for f in sorted(f for m in messages if m for f in m.files):
            streams.setdefault(f[2], []).append(f)
        if any(a[1] >= b[0] for mine in streams.values() for a, b in itertools.pairwise(mine)):
            self.abort(messages)
            raise WaveError("rows of a stream are mixed over tasks")
        for stream, mine in streams.items():
            whole = mine[0][3]
            if len(mine) > 1:
                whole = f"{at}/.{stream}.joined"
                with store.open_output_stream(whole, compression=None) as out:
                    out.write(self.header(sum(f[4] for f in mine), sum(f[5] for f in mine)))
                    for _, _, _, piece, n, rows in mine:
                        with store.open_input_stream(piece, compression=None) as old:
                            old.read(len(self.header(n, rows)))
                            while block := old.read(1 << 22):
                                out.write(block)
                        store.delete_file(piece)
            store.move(whole, f"{at}/{stream}.wav")

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                if store.get_file_info(f[3]).type == fs.FileType.File:
                    store.delete_file(f[3])


class CodedWriter(_Writer):
    """Frames (stream_id, frame_no, bytes) of one bit rate; ``sampleCount`` may name the samples of each file."""

    order = "frame_no"

    def data(self, row) -> bytes:
        if len(row["bytes"]) != (block := next(n for b, n, _, _ in PROFILES if b == int(self.options["bitrate"]))):
            raise WaveError(f"every frame takes {block} bytes")
        return bytes(row["bytes"])

    def header(self, n_bytes: int, n_rows: int) -> bytes:
        n = int(self.options["sampleCount"]) if self.options.get("sampleCount") else max(0, n_rows - DRAIN_FRAMES) * FRAME
        return coded_header(int(self.options["bitrate"]), n_bytes, FRAME, n)


class PcmWriter(_Writer):
    """Samples (stream_id, sample_no, left, right), arrays in -1 to 1, as 16-bit files."""

    order = "sample_no"

    def data(self, row) -> bytes:
        left, right = (np.array(row[c], np.float32) for c in ("left", "right"))
        return np.stack([pcm16(left), pcm16(right)], 1).tobytes()

    def header(self, n_bytes: int, n_rows: int) -> bytes:
        return pcm_header(n_bytes)


def by_stream(rows: DataFrame, order: str) -> DataFrame:
    """Rows as the writers need them."""
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", order)


def write_coded(frames: DataFrame, path: str, bitrate: int, overwrite: bool = False, sample_count: int | None = None) -> None:
    out = by_stream(frames, "frame_no").write.format("coded_wav").mode("overwrite" if overwrite else "append").option("bitrate", bitrate)
    (out if sample_count is None else out.option("sampleCount", sample_count)).save(path)


def write_pcm(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    by_stream(samples, "sample_no").write.format("wav_pcm").mode("overwrite" if overwrite else "append").save(path)


class PcmSource(DataSource):
    """format("wav_pcm"): one row for each 1024 samples of each file."""

    @classmethod
    def name(cls) -> str:
        return "wav_pcm"

    def schema(self) -> str:
        return "path string, sample_no long, left array<float>, right array<float>"

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)

    def writer(self, schema, overwrite: bool) -> PcmWriter:
        return PcmWriter(self.options, overwrite)


class CodedSource(DataSource):
    """format("coded_wav"): one row for each frame of each file; writes streams of frames."""

    @classmethod
    def name(cls) -> str:
        return "coded_wav"

    def schema(self) -> str:
        return "path string, frame_no long, bitrate_kbps int, sample_count long, align long, bytes binary"

    def reader(self, schema) -> CodedReader:
        return CodedReader(self.options)

    def writer(self, schema, overwrite: bool) -> CodedWriter:
        return CodedWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(PcmSource)
    spark.dataSource.register(CodedSource)


METADATA = "bitrate_kbps int, channels int, sample_rate int, bytes_per_frame int, frame_count long, sample_count long, alignment_sample_count long, error string"


def wave_metadata(images: DataFrame, content: str = "content", keep: tuple = ("path",)) -> DataFrame:
    """Metadata of coded images held in a binary column; a bad image gives its error."""

    @F.udf(METADATA)
    def read(image):
        try:
            i = parse(bytes(image))
        except (WaveError, struct.error) as e:
            return (None, None, None, None, None, None, None, str(e))
        return (i.bitrate, i.channels, i.sample_rate, i.block, i.frames, i.sample_count, i.align if i.align is not None else FRAME, None)

    return images.select(*keep, read(content).alias("m")).select(*keep, "m.*")


def wave_frames(images: DataFrame, content: str = "content", keep: tuple = ("path",)) -> DataFrame:
    """Frames of coded images by slicing their bytes: the header is walked once per image, the payload stays in the JVM."""

    @F.udf("data_at long, block int, n long")
    def where(image):
        i = parse(bytes(image))
        return (i.data_at, i.block, i.frames)

    rows = images.select(*keep, content, where(content).alias("w")).where("w.n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w.n") - 1)).alias("frame_no"))
    return rows.select(*keep, "frame_no", F.expr(f"substring({content}, int(w.data_at + frame_no * w.block + 1), w.block)").alias("bytes"))


def coded_images(frames: DataFrame, stream: str, bitrate: int, sample_count: str | None = None) -> DataFrame:
    """(stream, content): each stream's frames (frame_no, bytes) as one coded image, for streams that fit a row."""
    rows = frames.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("frame_no", "bytes"))).alias("frames"), (F.max(sample_count) if sample_count else F.lit(None).cast("long")).alias("n"))

    @F.udf("binary")
    def image(found, n):
        return coded_wave(bitrate, [bytes(f["bytes"]) for f in found], sample_count=n)

    return rows.select(stream, image("frames", "n").alias("content"))


def pcm_images(samples: DataFrame, stream: str) -> DataFrame:
    """(stream, content): each stream's samples (sample_no, left, right arrays) as one 16-bit image, for streams that fit a row."""
    rows = samples.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("sample_no", "left", "right"))).alias("x"))

    @F.udf("binary")
    def image(found):
        left, right = (np.concatenate([np.array(x[c], np.float32) for x in found]) for c in ("left", "right"))
        return pcm_wave(left, right)

    return rows.select(stream, image("x").alias("content"))


class WaveReader:
    """A coded image in memory: its metadata, and its frames by iteration, plain or asynchronous."""

    def __init__(self, image: bytes | bytearray | memoryview):
        self.image = bytes(image)
        self.info = parse(self.image)
        self.metadata = {
            "bitrate_kbps": self.info.bitrate, "channels": self.info.channels, "sample_rate": self.info.sample_rate, "bytes_per_frame": self.info.block,
            "frame_count": self.info.frames, "sample_count": self.info.sample_count, "alignment_sample_count": FRAME if self.info.align is None else self.info.align,
        }

    def __iter__(self) -> Iterator[bytes]:
        return frames_of(self.image)

    async def __aiter__(self):
        for frame in frames_of(self.image):
            yield frame
