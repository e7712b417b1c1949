"""Exact dedup with a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch of documents is reduced to one line per
digest, the known digests go in a sort-merge anti-join that needs no shuffle of the index, and the new ones are
appended. Digests alone are shuffled, never texts.

Adding a batch again, say after a crash, gives the same rows again: a document that the index records stays.

Defined cases: a null text counts as empty; equal texts keep the row with the largest id, or, once a text is in the
index, the document recorded there; of rows that repeat that id with the same text exactly one is kept; ids may be null
(they lose against any other); very long texts are hashed whole, and only their digests are shuffled; an empty table gives an
empty result; other columns are ignored, or carried along by drop_exact_duplicates, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import fresh_path, full_text, join_groups, keep, packed, partitions, without_rows


#: Files of a bucket from which on an index is written anew.
MOST_FILES = 16


class DigestIndex:
    """Digests at ``path`` in a fixed number of buckets. An index that exists there is opened with its own number.

    Every batch appends a file to each bucket; where there are MOST_FILES of a bucket, all are written anew as one, beside the
    old ones, which go when that is complete. One session at a time adds to an index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.root = spark, path.rstrip("/")
        self.buckets, self.version = self._recorded() or (buckets or partitions(spark), 0)
        if not self._exists(self.path):
            self._write(spark.createDataFrame([], "digest binary, keep_id long"))
        elif not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet OPTIONS (path '{self.path}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    @property
    def path(self) -> str:
        return f"{self.root}/b{self.buckets:06d}-{self.version:06d}"

    @property
    def name(self) -> str:
        return f"digest_index_{hashlib.md5(self.root.encode()).hexdigest()}_{self.version}"

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, _ = self._files()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _recorded(self) -> tuple[int, int] | None:
        """Buckets and version of the newest complete index."""
        fs, at = self._files()
        if not fs.exists(at):
            return None
        names = [re.fullmatch(r"b(\d+)-(\d+)", x.getPath().getName()) for x in fs.listStatus(at)]
        found = [(int(m[2]), int(m[1])) for m in names if m and self._exists(f"{self.root}/{m[0]}/_SUCCESS")]
        return max(found)[::-1] if found else None

    def _write(self, digests: DataFrame, mode: str = "append") -> None:
        (
            digests.select("digest", "keep_id").repartition(self.buckets, "digest")
            .write.mode(mode).format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> int:
        fs, _ = self._files()
        return sum(x.getPath().getName().startswith("part-") for x in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)))

    def add(self, groups: DataFrame) -> None:
        """Append those of the groups (digest, keep_id) that the index lacks. Adding the same again changes nothing."""
        self._write(groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        self.spark.catalog.refreshTable(self.name)
        if self.files() > MOST_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """One file for each bucket."""
        old, old_name = self.path, self.name
        # As plain files: the planner takes a table's buckets for the partitions asked for, and then reads it without them.
        digests = self.spark.read.schema("digest binary, keep_id long").parquet(old)
        self.version += 1
        self._write(digests, "overwrite")
        self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
        fs, _ = self._files()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256."""
    rows = keep(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(full_text(F.col(text_col)), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    total = rows.count()
    largest = F.max(F.struct("doc_id", "row_id"))
    # Written, since an anti-join would else be pushed below the aggregation, where the rows of a hot digest meet.
    groups = keep(rows.groupBy("digest").agg(largest.alias("last"), F.count(F.lit(1)).alias("group_size")), "digest-groups", total)
    index.add(groups.select("digest", F.col("last.doc_id").alias("keep_id")))
    settled = keep(groups.join(index.table().hint("merge"), "digest"), "settled-digests", total)
    out = join_groups(rows, settled, "digest", "group_size", total)
    stays = (F.col("row_id") == F.col("last.row_id")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text is new: one row for each text, with the columns it came with."""
    judged = keep(exact_duplicates(docs, index, id_col, text_col), "judged")
    pair = ["doc_id", "text_sha256"]
    counted = judged.groupBy(*pair).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = packed(docs, doc_id=F.col(id_col).cast("long"), text_sha256=F.sha2(full_text(F.col(text_col)), 256))
    found = without_rows(marked, counted.where("NOT kept").select(*pair))
    # Rows that repeat an id and its text, of which one stays: aggregated before they are shuffled; all others pass by.
    again = keep(counted.where("kept AND n > 1").select(*pair), "repeated-rows")
    if again.isEmpty():
        return found.select("row.*")
    once = without_rows(found, counted.where("n = 1").select(*pair)).dropDuplicates(pair)
    return without_rows(found, again).unionByName(once).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, DigestIndex(spark, fresh_path(spark, "digest-index")))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
