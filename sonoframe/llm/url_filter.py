"""URL filters over a sorted digest array.

The entries, rules and blocked names alike, are strings of host and path. Their 64-bit xxhash keys lie in one sorted file
that every worker maps into memory, with the full strings beside it. A batch of urls is probed by vectorised binary
search, once for each label that a host may be cut at and each path length that entries have; every hit is confirmed
against the stored string, so a collision of keys judges nothing.

An entry ``host/path`` fits its host and all subdomains, if the url's path starts with the entry's. The longest entry that
fits gives the verdict. Without a rule, a url whose host or one of the host's parents is on the block list (an entry without
a path) is blocked; all else is allowed.

The array lies in files of MOST_ENTRIES entries at most, cut by key, in the shared folder; Spark sends each worker's machine
its copies. Short lists are built from Python, long ones from a table, whose rows are sorted by key over many tasks.

Defined cases: a null url, and one without ``://``, has an empty host and path, fits no rule and is allowed; an empty host
fits nothing; ports and user names stay part of the host; of rules of equal length that fit, the one with the longer host
wins; an entry that is both a rule and blocked is a rule, and one that is allowed and blocked is allowed; very long urls are
read whole; repeated rows each keep their row; an empty table gives an empty result, and without entries all urls are
allowed; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import fresh_path, keep

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Junk sites, each under three domains. The list holds those met in the pages at hand; bring a longer one for other pages.
JUNK = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(f"{name}.example.{top}" for name in JUNK for top in ("org", "com", "net"))
ALLOW, BLOCK, LISTED = 0, 1, 2
#: Entries of one file, which then takes about 1 GB.
MOST_ENTRIES = 20_000_000
#: Spark's xxhash64 has it too.
SEED = 42


def build(rules: dict[str, str], blocked: tuple[str, ...] = (), most: int | None = None) -> list[bytes]:
    """The files of the lists, in order of key."""
    kinds = {x.encode(): LISTED for x in blocked} | {x.encode(): (ALLOW if v == "allow" else BLOCK) for x, v in rules.items()}
    entries = sorted((xxhash.xxh64_intdigest(x, SEED), x, k) for x, k in kinds.items())
    most = most or MOST_ENTRIES
    cut = [entries[i : i + most] for i in range(0, len(entries), most)] or [[]]
    return [file_of(np.array([e[0] for e in part], np.uint64), [e[1] for e in part], np.array([e[2] for e in part], np.int64)) for part in cut]


def file_of(keys: np.ndarray, strings: list[bytes], kinds: np.ndarray) -> bytes:
    """Number of entries and of path lengths; sorted keys; ends of strings; kinds; path lengths of rules; strings."""
    lengths = np.array(sorted({len(_path(x)) for x, k in zip(strings, kinds.tolist(), strict=True) if k != LISTED}), "<i8")
    ends = np.cumsum([len(x) for x in strings], dtype="<i8")
    return np.array([len(keys), len(lengths)], "<i8").tobytes() + keys.astype("<u8").tobytes() + ends.astype("<i8").tobytes() + kinds.astype("<i8").tobytes() + lengths.tobytes() + b"".join(strings)


def stored(spark: SparkSession, files: list[bytes]) -> list[str]:
    """Paths of the files in the shared folder; the same files are stored once a session."""
    done = {x.rsplit("/", 1)[-1]: x for x in spark.sparkContext.listFiles}
    folder, paths = fresh_path(spark, "url-keys"), []
    for data in files:
        name = f"urls-{hashlib.sha256(data).hexdigest()[:24]}.keys"
        if name not in done:
            _write(f"{folder}/{name}", data)
        paths.append(done.get(name, f"{folder}/{name}"))
    return paths


def _write(path: str, data: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at, compression=None) as out:
        out.write(data)


def build_table(entries: DataFrame, files: int) -> list[str]:
    """Paths of about so many files in the shared folder, from a table of (entry, verdict): ``allow`` or ``block`` for rules,
    ``listed`` for blocked names. Rows are sorted by key over tasks, each of which writes a file."""
    spark = entries.sparkSession
    folder = fresh_path(spark, "url-keys")
    kind = F.when(F.col("verdict") == "allow", ALLOW).when(F.col("verdict") == "block", BLOCK).otherwise(LISTED)
    rows = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.min(kind).alias("kind"))
    rows = keep(rows.select(F.xxhash64("entry").alias("key"), "entry", "kind"), "url-entries")
    order = F.col("key").bitwiseXOR(F.lit(-(2**63)))  # as unsigned numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        data = file_of(t["key"].to_numpy().view(np.uint64), pc.cast(t["entry"], pa.binary()).to_pylist(), t["kind"].to_numpy())
        path = f"{folder}/urls-{hashlib.sha256(data).hexdigest()[:24]}-{TaskContext.get().taskAttemptId()}.keys"
        _write(path, data)
        yield pa.RecordBatch.from_pydict({"path": [path], "first": pa.array([t["key"][0].as_py() ^ -(2**63)], pa.int64())})

    made = rows.repartitionByRange(files, order).sortWithinPartitions(order, "entry").mapInArrow(run, "path string, first long")
    return [r["path"] for r in sorted(keep(made, "url-files").collect(), key=lambda r: r["first"])] or stored(spark, build({}))


def _path(entry: bytes) -> bytes:
    at = entry.find(b"/")
    return entry[at:] if at >= 0 else b""


class DigestArray:
    """The files in mapped memory, in order of key."""

    def __init__(self, *paths: str):
        self.files = [DigestFile(p) for p in paths]
        self.files = [f for f in self.files if len(f.keys)]
        self.firsts = np.array([f.keys[0] for f in self.files], np.uint64)
        self.starts = np.cumsum([0] + [len(f.keys) for f in self.files])
        self.kinds = np.concatenate([f.kinds for f in self.files]) if len(self.files) > 1 else self.files[0].kinds if self.files else np.zeros(0, np.int64)
        self.lengths = np.array(sorted({n for f in self.files for n in f.lengths.tolist()}), np.int64)

    def entry(self, i: int) -> bytes:
        f = int(np.searchsorted(self.starts, i, "right")) - 1
        return self.files[f].entry(i - int(self.starts[f]))

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Number of each string's entry, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not self.files or not strings:
            return out
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))
        # Equal keys may stand on both sides of a cut, so all files that can hold a key are looked at.
        low, high = np.searchsorted(self.firsts, h, "left") - 1, np.searchsorted(self.firsts, h, "right") - 1
        for f in range(len(self.files)):
            mine = np.flatnonzero((np.maximum(low, 0) <= f) & (f <= high) & (out < 0))
            if len(mine):
                found = self.files[f].find(h[mine], [strings[i] for i in mine.tolist()])
                out[mine] = np.where(found >= 0, found + self.starts[f], -1)
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> tuple[list[str | None], list[str]]:
        """The rule that fits best, and the verdict, of each url."""
        if not self.files:
            return [None] * len(hosts), ["allow"] * len(hosts)
        best = np.full(len(hosts), -1, np.int64)
        size = np.zeros(len(hosts), np.int64)
        listed = np.zeros(len(hosts), bool)
        rows = np.arange(len(hosts))
        tails = list(hosts)
        while len(rows):
            for length in self.lengths.tolist():
                # A path shorter than the entry's doesn't start with it.
                fit = [i for i, r in enumerate(rows.tolist()) if len(paths[r]) >= length]
                found = self.find([tails[i] + paths[rows[i]][:length] for i in fit])
                for i, k in zip(fit, found.tolist(), strict=True):
                    n = len(tails[i]) + length
                    if k >= 0 and self.kinds[k] != LISTED and n > size[rows[i]]:
                        best[rows[i]], size[rows[i]] = k, n
            found = self.find(tails)
            listed[rows[(found >= 0) & (self.kinds[found] == LISTED)]] = True
            cuts = [t.find(b".") for t in tails]
            rows = rows[[c >= 0 for c in cuts]]
            tails = [t[c + 1 :] for t, c in zip(tails, cuts, strict=True) if c >= 0]
        rules = [self.entry(k).decode() if k >= 0 else None for k in best.tolist()]
        kinds = np.where(best >= 0, self.kinds[best], np.where(listed, BLOCK, ALLOW))
        return rules, ["block" if k == BLOCK else "allow" for k in kinds.tolist()]


class DigestFile:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = raw[:16].view("<i8").tolist()
        at = np.cumsum([16, 8 * n, 8 * n, 8 * n, 8 * m])
        self.keys, self.ends, self.kinds, self.lengths = (raw[a:z].view(t) for a, z, t in zip(at[:-1], at[1:], ("<u8", "<i8", "<i8", "<i8"), strict=True))
        self.text = raw[at[-1] :]

    def entry(self, i: int) -> bytes:
        return self.text[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, h: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Number of each string's entry, or -1, by binary search for its key and a look at the string."""
        out = np.full(len(strings), -1, np.int64)
        at = np.searchsorted(self.keys, h)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == h[i]:  # equal keys stand side by side
                if self.entry(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


@lru_cache(4)
def mapped(names: tuple[str, ...]) -> DigestArray:
    return DigestArray(*map(SparkFiles.get, names))


def judge_urls(pages: DataFrame, rules: dict[str, str], blocked: tuple[str, ...] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per url: page_id, host, path, rule, verdict."""
    return judge_by_files(pages, stored(pages.sparkSession, build(rules, blocked)), id_col, url_col)


def judge_by_files(pages: DataFrame, files: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As judge_urls, by the files of stored or build_table."""
    context = pages.sparkSession.sparkContext
    for path in files:
        if not any(x.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1] for x in context.listFiles):
            context.addFile(path)  # each executor fetches its own copy
    names = tuple(path.rsplit("/", 1)[-1] for path in files)
    after = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), after.alias("after"))
    rows = rows.select("page_id", F.regexp_extract("after", "^[^/?#]*", 0).alias("host"), F.regexp_extract("after", "(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    rows = rows.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = mapped(names)
        for b in batches:
            hosts, paths = (pc.cast(b.column(i), pa.binary()).to_numpy(zero_copy_only=False).tolist() for i in (1, 2))
            rule, verdict = array.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES, BLOCKED)


OP3_SQL = (
    r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(after, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, host, path, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), blocked(name) AS (
  VALUES %s
), listed AS (
  SELECT page_id, host, path, EXISTS (SELECT 1 FROM blocked WHERE host = name OR ends_with(host, '.' || name)) AS listed FROM parts
), fits AS (
  SELECT l.page_id, l.host, l.path, l.listed, r.rule, r.host AS rule_host, r.verdict FROM listed l
  LEFT JOIN rules r ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rule_host) DESC) = 1
"""
    % ", ".join(f"('{name}')" for name in BLOCKED)
)
