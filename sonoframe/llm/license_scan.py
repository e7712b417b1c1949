"""License scans by ordered signature rules. DataFrame functions only.

Texts are read as words in lower case between single spaces. A look for a few gate words lets most texts pass by. In the
others, each rule whose keyword occurs is matched, which gives detections: spans with a label, a priority and a confidence.
A detection inside another one's span goes if that one has a higher priority, or the same priority and a longer span. All
of it happens inside the row, so nothing is shuffled; spans and containment come from block-wise prefixes, so a text with n
detections takes some 50 n steps (as long as n is below a million).

Defined cases: a null text counts as empty: no words, places or labels, score 0; very long texts are read whole; repeated
rows each keep their row; of equal spans with the same priority all stay; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import full_text
from sonoframe.llm.license_rules import BASE, GATE_CC, GATES, rules_json

#: Words of the contract after A-Z are lower-cased; before that, this matches the same places.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "array<struct<pattern:string,keyword:string,label:string,priority:int,confidence:double>>"
#: Rules have priorities from 1 to this.
PRIORITIES = 5
#: Confidence of a base phrase.
BASE_SURE = 0.8


def gate(text: Column) -> Column:
    """Whether any rule could match. Full lower-casing changes no ASCII letter that a keyword has, so it misses none."""
    low = F.lower(text)
    return reduce(Column.__or__, [low.contains(g) for g in GATES]) | low.rlike(GATE_CC)


def _words_before(text: Column) -> Column:
    """Number of words in a prefix that begins with a space and ends before a word."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) - 1


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for the value, worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def before(values: str, zero: str, merge: str, levels: int = 3) -> str:
    """SQL of an array with, for each place of an array of long, what ``merge`` (of a and y) makes of all values before it.

    Values are merged in blocks of 32, the blocks before each block likewise, and then the values before a place in its own
    block, so that no place looks back over all others."""
    v, s, e = f"v{levels}", f"s{levels}", f"e{levels}"
    if levels == 1:
        each = f"transform(sequence(0, size({v}) - 1), i -> aggregate(slice({v}, 1, i), {zero}, (a, y) -> {merge}))"
    else:
        blocks = f"transform(sequence(0, (size({v}) - 1) div 32), k -> aggregate(slice({v}, int(k * 32 + 1), 32), {zero}, (a, y) -> {merge}))"
        own = f"aggregate(slice({v}, int((i div 32) * 32 + 1), i % 32), get({e}, int(i div 32)), (a, y) -> {merge})"
        each = _let(blocks, s, _let(before(s, zero, merge, levels - 1), e, f"transform(sequence(0, size({v}) - 1), i -> {own})"))
    return _let(values, v, f"if(size({v}) = 0, array(), {each})")


def detections(norm: str, rules: str) -> Column:
    """Array of (start, end, label, priority, confidence, words) of every match, in characters of the column ``norm``."""
    # What lies before each match and after the match before it, and the match itself.
    steps = "transform(m, (x, j) -> bigint(char_length(get(s, j)) + char_length(x)))"
    spans = f"""transform({before(steps, "0L", "a + y")}, (p, j) -> struct(
        p + char_length(get(s, j)) AS start, p + char_length(get(s, j)) + char_length(get(m, j)) AS end,
        r.label AS label, r.priority AS priority, r.confidence AS confidence, get(m, j) AS words))"""
    found = _let(f"regexp_extract_all({norm}, r.pattern, 0)", "m", f"if(size(m) = 0, array(), {_let(f'split({norm}, r.pattern, -1)', 's', spans)})")
    return F.expr(f"flatten(transform(filter({rules}, r -> contains({norm}, r.keyword)), r -> {found}))")


def suppressed(found: str) -> Column:
    """The detections that stay: those that no detection of higher priority contains, nor a longer one of the same.

    In order of start, then of length, longest first, whatever contains a detection comes before it. So of each priority the
    furthest end before a place decides, and of equal ends the smallest start: both in one number."""
    far = "d.end * 2147483648 + (2147483647 - d.start)"
    ends = f"transform(sequence(1, {PRIORITIES}), p -> if(exists(f, d -> d.priority = p), {before(f'transform(f, d -> if(d.priority = p, {far}, -1L))', '-1L', 'greatest(a, y)')}, array()))"
    higher = f"exists(sequence(1, {PRIORITIES}), p -> p > d.priority AND get(get(e, p - 1), i) div 2147483648 >= d.end)"
    longer = f"get(get(e, d.priority - 1), i) > {far}"
    stays = f"transform(f, (d, i) -> if({higher} OR {longer}, NULL, d))"
    ordered = f"transform(sort_array(transform({found}, d -> struct(d.start AS start, -d.end AS shorter, -d.priority AS lower, d AS d))), x -> x.d)"
    return F.expr(_let(ordered, "f", f"if(size(f) = 0, f, filter({_let(ends, 'e', stays)}, d -> d IS NOT NULL))"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (the
    detections with the words they cover)."""
    text = full_text(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"), F.when(gate(F.col("text")), F.col("text")).alias("text"))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), BETWEEN, " ")), F.lit(" "))
    rows = rows.select("doc_id", "n_words", spaced.alias("norm"))
    places = []
    for i, (phrase, label) in enumerate(BASE):
        # A phrase is never both the end and the start of two places, as its first and last words differ.
        at = F.regexp_extract("norm", f"(?s)^(.*? ){phrase} ", 1)
        last = F.regexp_extract("norm", f"(?s)^(.* ){phrase} ", 1)
        n = F.regexp_count("norm", F.lit(f"(?<= ){phrase}(?= )"))
        some = F.col("norm").contains(f" {phrase} ")
        places.append(F.when(some, F.struct(F.lit(label).alias("label"), n.cast("long").alias("n"), _words_before(at).cast("long").alias("first"), _words_before(last).cast("long").alias("last"))).alias(f"base{i}"))
    rows = rows.select("doc_id", "n_words", "norm", *places)
    rows = rows.withColumn("base", F.filter(F.array(*[f"base{i}" for i in range(len(BASE))]), lambda b: b.isNotNull()))
    rows = rows.withColumn("rules", F.from_json(F.lit(rules_json()), RULE))
    rows = rows.select("doc_id", "n_words", "norm", "base", detections("norm", "rules").alias("all_found"))
    rows = rows.select("doc_id", "n_words", "norm", "base", F.coalesce(suppressed("all_found"), F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int,confidence:double,words:string>>")).alias("found"))
    base_labels = F.array_sort(F.transform("base", lambda b: b["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("found", lambda d: d["label"]))))
    sure = F.concat(F.transform("base", lambda b: F.lit(BASE_SURE)), F.transform("found", lambda d: d["confidence"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
        F.transform("found", lambda d: F.struct(d["label"].alias("label"), d["words"].alias("words"))).alias("found"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).drop("found")
