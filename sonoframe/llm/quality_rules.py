"""Quality rules: word and line statistics of a text, and lines that many documents of a host share. DataFrame functions only.

Lines are normalised (lower case, digits as 0, words joined by single spaces) and hashed. A line is boilerplate if more
than LINE_DOCS different documents of its host have it; rows that repeat an id and its text are one document. The limit is a
number of documents, so no verdict changes as unrelated documents join a host. Boilerplate lines are removed, which depletes
a document if less than LEFT of its words remain; depleted documents are rejected, and the others go on without those lines
(cleaned_documents).

Only hashes are shuffled, once per different line of a document. The lines found are joined back with hot lines (each a
thousandth of all lines or more) broadcast, and the others in a shuffled join.

Defined cases: a null text has no words or lines, and fails; a null host is a host of its own; null ids differ if their
texts do; repeated rows each keep their row and count as one document; a line with as many documents as the limit stays;
very long texts are read whole; an empty table gives an empty result; other columns are ignored, or carried by
cleaned_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import SPACE, full_text, join_groups, keep, packed

LINE_DOCS = 20
LEFT = 0.5
LEAST_WORDS = 50
SYMBOLS = "[#*$%&|<>]"


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and ``lines``, an array of (hash, words) of its
    different lines, and ``text_hash``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in others], full_text(F.col(text_col)).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = rows.withColumn("all_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # Hashes of the three-word windows. Most texts repeat none, which one look at the distinct ones shows.
    at = F.sequence(F.lit(1), F.col("n_words").cast("int") - 2)
    word = lambda i: F.element_at("words", i)
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= 4, F.transform(at, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))))
    each = F.transform(F.transform("all_lines", _normal), lambda x: F.struct(F.xxhash64(x).alias("hash"), F.size(F.split(x, " ")).alias("n")))
    return rows.select(
        "doc_id",
        *others,
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("all_lines") - F.size(F.array_distinct("all_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeated_words("windows")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        each.alias("lines"),
        F.xxhash64("text").alias("text_hash"),
    )


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def _repeated_words(windows: str) -> Column:
    """Number of words in windows whose hash stands in the text twice or more: in order of hash, equal ones are neighbours."""

    def count(p: Column) -> Column:
        twins = F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.get(p, k)["h"] == F.get(p, k - 1)["h"])
        words = F.transform(twins, lambda k: F.array(*[F.get(p, k - j)["i"] + n for j in (0, 1) for n in (0, 1, 2)]))
        return F.size(F.array_distinct(F.flatten(words)))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.get(F.transform(F.array(placed), count), F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(docs: DataFrame, carry: bool, id_col: str, text_col: str, host_col: str, line_docs: int, left: float) -> DataFrame:
    """doc_id, the measures, base_failed, words_removed, kept; with ``carry``, ``row`` and ``host``, and ``gone``, the keys of
    the lines removed."""
    rows = packed(docs, doc_id=F.col(id_col), text=F.col(text_col), host=F.col(host_col))
    measured = text_measures(rows, others=("host", "row") if carry else ("host",)).withColumn("row_id", F.monotonically_increasing_id())
    measured = keep(measured, "measures")
    total = measured.select(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    lines = measured.select("host", F.xxhash64("doc_id", "text_hash").alias("doc"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    shared = lines.groupBy("host", "hash", "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    common = keep(shared.where(F.col("docs") > line_docs).select(_key(F.col("hash")).alias("line"), "n"), "common-lines", total)
    mine = measured.select("row_id", F.explode(F.transform("lines", lambda x: F.struct(_key(x["hash"]).alias("line"), x["n"].alias("words")))).alias("x")).select("row_id", "x.line", "x.words")
    found = [F.sum("words").alias("words_removed"), *([F.collect_set("line").alias("gone")] if carry else [])]
    removed = join_groups(mine, common, "line", "n", total).groupBy("row_id").agg(*found)
    out = measured.drop("lines", "text_hash").join(removed, "row_id", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))
    depleted = F.col("n_words") - F.col("words_removed") < left * F.col("n_words")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted)


def _key(line_hash: Column) -> Column:
    """A line's key holds its host, so equal lines of different hosts are apart."""
    return F.xxhash64(F.col("host"), line_hash)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, left: float = LEFT) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, words_removed, kept."""
    return _judged(docs, False, id_col, text_col, host_col, line_docs, left)


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, left: float = LEFT) -> DataFrame:
    """The kept documents with the columns they came with, and texts without their boilerplate lines."""
    found = _judged(docs, True, id_col, text_col, host_col, line_docs, left).where("kept")
    text = F.col("row")[text_col]
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", _key(F.xxhash64(_normal(x)))))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(stays, "\n"))
    return found.select(*[(cleaned if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)
), again AS (
  SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, g) > 1
), repeats AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY row_id
), lines AS (
  SELECT row_id, doc_id, source, text, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM w, unnest(lines) AS u(x)
), common AS (
  SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT struct_pack(i := doc_id, t := text)) > 20
), removed AS (
  SELECT row_id, sum(len(string_split(l.line, ' '))) AS n
  FROM lines l JOIN common c ON l.line = c.line AND l.source IS NOT DISTINCT FROM c.source GROUP BY row_id
), measured AS (
  SELECT w.row_id, w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS words_removed
  FROM w LEFT JOIN repeats r ON w.row_id = r.row_id LEFT JOIN removed x ON w.row_id = x.row_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_removed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - words_removed < 0.5 * n_words) AS kept
FROM measured
"""
