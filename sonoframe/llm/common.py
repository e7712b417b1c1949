"""What the corpus operators share: the shared folder, written tables, joins that survive hot keys, word caches."""

from __future__ import annotations

import ctypes
import gc
import json
import math
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of ASCII white space, as Java's regex engine writes it; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Groups holding this share of all rows or more are hot; there are at most 1 / HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 0.001
#: Keys that may be broadcast, after they were counted.
FEW_KEYS = 200_000
#: Rows of a narrow table in one written file, about.
FILE_ROWS = 200_000
#: Rows in one Arrow batch sent to Python: texts may be long, so batches stay short.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where all run in one process,
    as in tests, it may be unset; a folder of our own is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sonoframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: its lineage ends there, and a lost executor costs no recomputation.

    ``rows``, if known, is about the number of rows; a narrow table of few rows then makes few files."""
    path = fresh_path(df.sparkSession, label)
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, since texts can be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def full_text(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows with all their columns in one struct ``row``, and ``columns`` beside it, so that no name can clash."""
    return docs.select(F.struct("*").alias("row"), *[x.alias(name) for name, x in columns.items()])


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, str], label: str, n: int) -> DataFrame:
    """``rows`` (about ``n``) with running sums over their global order, each row's own value included: ``sums`` maps long
    columns (no nulls, none below zero) to the names of their running sums.

    Rows are range-sorted, each partition sums its own part, and what the partitions before it sum to, one line for each
    partition, is added. ``order`` should tell rows apart, for rows that are equal in it share a partition."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(min(partitions(spark), n // FILE_ROWS + 1), *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(x, T.LongType()) for x in sums.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(sums, 0)
        for b in batches:
            upto = []
            for c in sums:
                upto.append(so_far[c] + np.cumsum(b.column(c).to_numpy(), dtype=np.int64))
                so_far[c] = int(upto[-1][-1]) if b.num_rows else so_far[c]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, upto)], schema.names)

    placed = keep(dealt.mapInArrow(lean(run), schema), label)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one line per partition
    parts = placed.groupBy("part").agg(*[F.max(x).alias(x) for x in sums.values()])
    parts = parts.select("part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x} before") for x in sums.values()])
    both = placed.join(F.broadcast(parts), "part")
    return both.select(*rows.columns, *[(F.col(x) + F.col(f"{x} before")).alias(x) for x in sums.values()])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one line per key, in which ``size`` counts the rows of that key.

    The hot groups, at most 1 / HOT_SHARE of them by their own share, are broadcast, so their rows need no shuffle;
    all the others meet in a shuffled join in which no key holds more than that share."""
    limit = max(1, math.ceil(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= limit)
    cold = groups.where(F.col(size) < limit)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("shuffle_merge"), key)
    return near.unionByName(far)


def without_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The rows whose key has no line in ``groups``; safe with hot keys as join_groups is."""
    limit = max(1, math.ceil(total * HOT_SHARE))
    hot, cold = groups.where(F.col(size) >= limit).select(key), groups.where(F.col(size) < limit).select(key)
    return rows.join(F.broadcast(hot), key, "left_anti").join(cold.hint("shuffle_merge"), key, "left_anti")


def without_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that equal no line of ``keys`` (null equals null) in its columns. Few keys are counted and then broadcast,
    so that rows with long texts stay where they are; more meet in a shuffled join."""
    few = keys.count() <= FEW_KEYS
    keys = keys.select([F.col(c).alias(f"_drop_{c}") for c in keys.columns])
    same = reduce(Column.__and__, [F.col(c.removeprefix("_drop_")).eqNullSafe(F.col(c)) for c in keys.columns])
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), same, "left_anti")


def sampled(rows: DataFrame, most: int, label: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes over all their columns, with that hash as ``key``; of rows that
    are equal one. Only hashes are sorted, so no task holds many texts."""
    rows = rows.withColumn("key", F.xxhash64(*rows.columns))
    last = rows.select("key").distinct().orderBy("key").limit(most).agg(F.max("key").alias("key")).first()["key"]
    some = rows.where(F.col("key") <= F.lit(last)) if last is not None else rows.where("false")
    return keep(some.groupBy("key").agg(F.first(F.struct(*rows.columns)).alias("row")).select("row.*"), label)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A line that names the arrays, their types and shapes, and then their bytes, with no copy of them in memory."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    arrays = {name: np.ascontiguousarray(x) for name, x in arrays.items()}
    with store.open_output_stream(at, compression=None) as out:
        head = json.dumps([(name, x.dtype.str, x.shape) for name, x in arrays.items()]).encode()
        out.write(head + b" " * (-(len(head) + 1) % 64) + b"\n")
        for x in arrays.values():
            data = x.reshape(-1).view(np.uint8) if x.size else np.zeros(0, np.uint8)
            out.write(data)
            out.write(bytes(-len(data) % 64))


def load_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, all views of one buffer."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as source:
        data = np.frombuffer(source.read_buffer(), np.uint8)
    end = int(np.flatnonzero(data[: 1 << 16] == 10)[0]) + 1
    out = {}
    for name, kind, shape in json.loads(data[:end].tobytes()):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[end : end + size].view(kind).reshape(shape)
        end += size + -size % 64
    return out


def built_file(rows: DataFrame, make: Callable[[pa.Table | None], dict[str, np.ndarray]], label: str) -> str:
    """Path of a file in the shared folder with the arrays that ``make`` makes of a whole table (None: no rows), whose size
    was checked; workers load it for a task and let it go. One task builds it, so neither the driver nor a broadcast holds it; a task that runs again writes its own."""
    path = fresh_path(rows.sparkSession, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        at = f"{path}-{TaskContext.get().taskAttemptId()}.arrays"
        save_arrays(at, make(pa.Table.from_batches(found) if found else None))
        yield pa.RecordBatch.from_pydict({"path": [at]})

    done = rows.coalesce(1).mapInArrow(lean(run), "path string").collect()
    if done:
        return done[0]["path"]
    save_arrays(f"{path}.arrays", make(None))
    return f"{path}.arrays"


def lean(run: Callable) -> Callable:
    """A function for mapInArrow after which the worker, which Spark keeps for other tasks, gives memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return task


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = found = len(self)
        self.new.append(key)
        return found


class WordTable:
    """Keeps one row of numbers for each distinct word seen by this worker, so that a word is worked out once.

    ``make`` turns a list of new words into their rows, one after another, and the length of each. Above ``limit``
    words the table starts afresh, which bounds its memory."""

    def __init__(self, make: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 150_000):
        self.make, self.dtype, self.limit = make, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.at = _Numbered()
        self.at.new = []
        self.size = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def places(self, words: list) -> np.ndarray:
        """Row numbers of the words; unknown ones are added."""
        if len(self.at) > self.limit:
            self.clear()
        found = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if self.at.new:
            values, size = self.make(self.at.new)
            self.at.new = []
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, values])
        return found

    def places_of(self, words: pa.Array) -> np.ndarray:
        """As places, but only the distinct words of the array become Python strings."""
        coded = words.dictionary_encode()
        return self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]

    def joined(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All the words' rows one after another, and the length of each."""
        size = self.size[places]
        return self.pool[ragged(self.begin[places], size)], size


def pieces_between(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray]:
    """What lies between the marks of each text, all in one array, and the number of pieces of each text."""
    cut = pc.split_pattern(texts, mark)
    return cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64)


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    ends = np.concatenate([[0], np.cumsum(values)])[np.cumsum(sizes)]
    return np.diff(ends, prepend=0)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i] + 1, ... for each i, size[i] of them, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
