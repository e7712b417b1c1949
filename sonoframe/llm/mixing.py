"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, MOST_USES times over. Documents are served in packets of PACKET words
at most, and a packet's virtual finish time is the words that its source has queued up to its end, divided by the source's
target. All packets are range-sorted by finish time over all partitions, a prefix sum runs over that order, and the mix is
what comes before the total budget is used up; the packet there is cut. So a source misses its target by about a packet,
however long its documents are, and the last document that a source gives may give its first words only.

Positions in the queues come from a range sort too, by source and shuffled key, so a source with a third of all rows, equal
ids and repeated rows are all spread evenly. Only numbers and hashes are sorted; texts stay where they are: what a row gives
follows from its key and its source's last position.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never
taken and finish at 0; repeated rows count each for itself; equal shuffle keys (equal or null ids) are ordered by size and
text; very long texts are read whole and served in many packets; an empty table gives an empty mix; other columns are
carried along by mixed_documents and ignored by mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.llm.common import FEW_KEYS, WORD, full_text, in_order, join_groups, keep, packed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_USES = 2
#: Words that are served at once at most.
PACKET = 256


def words_in(text: Column) -> Column:
    return F.regexp_count(full_text(text), F.lit(WORD)).cast("long")


def queue_of(source: Column) -> Column:
    """A source's name without nulls, in the order of code points, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def turn_of(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_USES) -> DataFrame:
    """(source, source_size, place, target) for (source, source_size): ``share`` of all words by weight, none above ``most``
    times its size; ``place`` numbers the sources in order.

    Handing the excess on by weight until none is above ends at one level of words per weight: sources whose limit per
    weight lies below it stand at their limits. With the sources in order of limit per weight that level is the first
    (budget - limits so far) / (weights from here on) that lies below the limit per weight it has reached."""
    n = sources.count()
    s = sources.select("source", "source_size", F.lit(1).cast("long").alias("one"))
    s = in_order(s, [F.col("source").isNull().asc(), F.col("source").asc()], {"one": "place"}, "sources", n)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    limit = F.col("most").cast("double") / F.col("weight")
    s = in_order(s, [limit.asc(), F.col("place").asc()], {"most": "upto_most", "weight": "upto_weight"}, "source-limits", n)
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    weights_left = F.lit(whole["weight"]) - F.col("upto_weight") + F.col("weight")
    level = (F.lit((whole["size"] or 0) * float(share)) - (F.col("upto_most") - F.col("most"))) / weights_left
    water = s.select(level.alias("level"), "place", "upto_most", limit.alias("limit")).where("level < limit").orderBy("limit", "place").first()
    most_d = F.col("most").cast("double")
    flow = F.lit(water["level"]) * F.col("weight") if water else most_d
    return s.select("source", "source_size", "place", F.least(flow, most_d).alias("target"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The queued rows (doc_id, queue, size, turn, hash, start in the queue of the source), those of size 0 with no start;
    the sources (queue, n rows, source_size, target, served: the words that the mix takes from it); the number of rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(full_text(F.col(text_col))).alias("hash"))
    rows = keep(rows.select("*", queue_of(F.col("source")).alias("queue"), turn_of(F.col("doc_id")).alias("turn"), F.monotonically_increasing_id().alias("row_id")), "sizes")
    n = rows.count()
    sums = keep(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sizes", n)
    goals = keep(targets(sums.select("source", "source_size"), weights, share, most), "targets", n)
    goals = goals.withColumn("queue", queue_of(F.col("source"))).join(sums.select(queue_of(F.col("source")).alias("queue"), "n"), "queue")
    goals = in_order(goals.drop("source"), [F.col("place").asc()], {"source_size": "upto_size"}, "placed-sources", n)
    goals = goals.withColumn("before", F.col("upto_size") - F.col("source_size"))

    order = [F.col(x).asc() for x in ("place", "turn", "size", "hash", "row_id")]
    some = join_groups(rows.drop("source"), goals, "queue", "n", n).where("size > 0")
    queued = in_order(some.drop("n", "upto_size"), order, {"size": "upto"}, "queues", n)
    queued = queued.withColumn("start", F.col("upto") - F.col("size") - F.col("before")).drop("upto", "before", "row_id")

    # Packets of all uses, in the order of their finish.
    cut = queued.where("target > 0").select("place", "start", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("use"))
    last = F.floor((F.col("size") - 1) / PACKET).cast("int")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), last)).alias("packet"))
    end = F.least(F.col("size"), (F.col("packet") + 1) * F.lit(PACKET).cast("long"))
    cut = cut.select("place", (F.col("use") * F.col("source_size") + F.col("start") + end).alias("end"), (end - F.col("packet") * F.lit(PACKET).cast("long")).alias("words"), "target")
    cut = cut.withColumn("finish", F.col("end") / F.col("target")).drop("target")
    packets = in_order(cut, [F.col(x).asc() for x in ("finish", "place", "end")], {"words": "through"}, "packets", 2 * most * n)
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    budget = F.lit(min(int(share * total), most * total)).cast("long")
    inside = F.least(F.col("words"), budget - (F.col("through") - F.col("words")))  # what fits in the budget
    served = packets.where(F.col("through") - F.col("words") < budget).groupBy("place").agg(F.sum(inside).alias("served"))
    served = goals.join(served, "place", "left").select("queue", "n", "source_size", "target", F.coalesce("served", F.lit(0)).alias("served"))
    empty = join_groups(rows.where("size = 0").drop("source", "row_id"), goals.select("queue", "n"), "queue", "n", n).drop("n").withColumn("start", F.lit(None).cast("long"))
    columns = ["doc_id", "queue", "size", "turn", "hash", "start"]
    return queued.select(columns).unionByName(empty.select(columns)), keep(served, "served-sources", n), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST_USES) -> DataFrame:
    """One row per document in order of its first use's virtual finish time: doc_id, size, source_size, target, taken, finish."""
    queued, sources, n = _plan(docs, id_col, text_col, source_col, weights, share, most)
    rows = join_groups(queued, sources, "queue", "n", n)
    uses = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - F.col("source_size") * u - F.col("start"))) for u in range(most)]
    taken = F.when(F.col("size") > 0, sum(uses[1:], uses[0])).otherwise(F.lit(0)).cast("long")
    finish = F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("start") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish")).orderBy("finish", "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST_USES) -> DataFrame:
    """The documents of the mix with the columns they came with: one row for each use, and in the last use of a cut
    document only the words taken.

    A source's queue is cut at one key in its last round: rows before it are used once more than those after it. Few sources
    are counted and broadcast with their cuts, so texts stay where they are."""
    queued, sources, n = _plan(docs, id_col, text_col, source_col, weights, share, most)
    sources = sources.where("source_size > 0").withColumn("rounds", F.floor(F.col("served") / F.col("source_size"))).withColumn("rest", F.col("served") % F.col("source_size"))
    there = join_groups(queued, sources, "queue", "n", n).where("start <= rest AND rest < start + size")
    cuts = keep(there.select("queue", F.col("turn").alias("cut_turn"), F.col("size").alias("cut_size"), F.col("hash").alias("cut_hash"), "rounds", "rest", "n"), "cuts", n)
    # Repeated rows at the cut stand side by side; they are told apart below.
    same = (F.col("turn") == F.col("cut_turn")) & (F.col("size") == F.col("cut_size")) & (F.col("hash") == F.col("cut_hash"))
    equal = join_groups(queued, cuts, "queue", "n", n).where(same).groupBy("queue").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("equals"))
    cuts = cuts.join(equal, "queue").withColumn("into", F.col("rest") - F.col("first")).drop("rest", "first")
    cuts = keep(cuts, "cut-keys", n)

    text = full_text(F.col(text_col))
    rows = packed(docs, text=text, queue=queue_of(F.col(source_col).cast("string")), turn=turn_of(F.col(id_col)), size=words_in(F.col(text_col)), hash=F.xxhash64(text))
    rows = rows.where("size > 0")
    met = rows.join(F.broadcast(cuts), "queue") if cuts.count() <= FEW_KEYS else join_groups(rows, cuts, "queue", "n", n)
    before = F.struct("turn", "size", "hash") < F.struct(F.col("cut_turn").alias("turn"), F.col("cut_size").alias("size"), F.col("cut_hash").alias("hash"))
    last = F.when(before, F.col("size")).when(same, F.greatest(F.lit(0), F.least(F.col("size"), F.col("into") - F.col("nth") * F.col("size")))).otherwise(F.lit(0))
    many = same & (F.col("equals") > 1)
    out = met.where(~many).withColumn("nth", F.lit(0).cast("long")).withColumn("last", last.cast("long"))
    if not cuts.where("equals > 1").isEmpty():
        out = out.unionByName(_numbered(met.where(many)).withColumn("last", last.cast("long")))
    uses = F.concat(F.array_repeat(F.col("size"), F.col("rounds").cast("int")), F.when(F.col("last") > 0, F.array("last")).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("words", F.explode(uses))
    # Cut behind words, each piece is a word and the white space before it.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    given = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), ""))
    return out.select(*[(given if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``nth``, which numbers those of each queue from 0 on: inside partitions first, then partitions of a queue."""
    rows = keep(rows.withColumn("at", F.monotonically_increasing_id()), "equal-rows").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("queue", "part").agg(F.count(F.lit(1)).alias("n_part"))
    earlier = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("queue", "part", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("queue", "part").orderBy("at"))
    return rows.withColumn("inside", inside).join(counts, ["queue", "part"]).withColumn("nth", F.col("offset") + F.col("inside") - 1).drop("at", "part", "inside", "offset")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs)


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS turn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS most, row_number() OVER (ORDER BY source NULLS LAST) AS place,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), levels AS (
  SELECT *, CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
         CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights_left,
         CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget
  FROM weighed
), water AS (
  SELECT arg_min((budget - before) / weights_left, before) AS water
  FROM levels WHERE (budget - before) / weights_left < CAST(most AS DOUBLE) / weight
), goals AS (
  SELECT source, source_size, place, CAST(floor(budget) AS BIGINT) AS budget, least(coalesce(water * weight, most), CAST(most AS DOUBLE)) AS target
  FROM levels, water
), queued AS (
  SELECT s.doc_id, s.size, g.place, g.source_size, g.target, g.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), packets AS (
  SELECT place, budget, least(256, size - 256 * packet) AS words,
         use * source_size + upto - size + least(size, 256 * (packet + 1)) AS last,
         (use * source_size + upto - size + least(size, 256 * (packet + 1))) / target AS finish
  FROM queued, unnest([0, 1]) AS u(use), unnest(range(0, (size + 255) // 256)) AS p(packet)
  WHERE target > 0
), sorted AS (
  SELECT place, budget, words, CAST(sum(words) OVER (ORDER BY finish, place, last ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through
  FROM packets
), served AS (
  SELECT place, CAST(sum(greatest(0, least(words, budget - (through - words)))) AS BIGINT) AS served FROM sorted GROUP BY place
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, coalesce(served, 0) - (upto - size)))
          + greatest(0, least(size, coalesce(served, 0) - source_size - (upto - size))) AS BIGINT) AS taken,
       CASE WHEN target > 0 AND size > 0 THEN upto / target ELSE CAST(0 AS DOUBLE) END AS finish
FROM queued LEFT JOIN served ON queued.place = served.place
"""
