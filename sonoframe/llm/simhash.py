"""SimHash near-dedup with pivot distance tables.

Every document gets a fingerprint of ``words`` x 64 bits over its word shingles. Fingerprints within ``most`` differing
bits are linked, and documents joined by links form a component.

Links are sought between distinct fingerprints only or, where texts are compared too, between distinct sets of shingles. Fingerprints that may be near share a block: in the exact plan the
bits are cut into parts and near fingerprints agree on some of them (so no link is lost at any size); in the banded plan,
for similar texts, a block is a run of least hashes of the shingles, on which two texts agree with the probability that their
similarity gives, whatever the number of texts: as many blocks as a stated recall takes, and unlike texts hardly ever meet. Inside a block the pivot tables decide: Hamming
distances to fixed reference fingerprints are computed once per fingerprint, a pair whose largest coordinate difference is
above ``most`` cannot be near (triangle inequality) and is discarded, and the survivors are verified bit by bit. Blocks
above TILE rows are cut into tiles that meet pairwise in tasks of their own. A task emits no pairs but spanning links, at
most one per fingerprint.

Pivot tables alone would compare all pairs of a corpus (distances to random references say little about random
fingerprints), hence the blocks in front of them; README.md has figures.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows each keep their row; rows that share an id
are one document to the links; a null id names no component, but its fingerprint links like any other (a component of null
ids only is null); ids lie below NAMELESS; very long texts are read whole; where near copies are dropped, rows with null ids
stay; ties go to the smallest id; an empty table gives an empty result; other columns are carried or ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import FEW_KEYS, SPACE, full_text, join_groups, keep, lean, packed, partitions, ragged, short_batches, totals, without_groups, without_rows
from sonoframe.llm.components import connected_components

SEED = 42
PIVOTS = 24
#: The near-copy stage: similarity, wide fingerprints in words of 64 bits, and their radius. At a similarity of 0.8 a bit
#: differs with probability 0.152, so 38.8 of 256 on average, with a standard deviation of 5.7.
NEAR_SHARE = 0.8
NEAR_WORDS = 4
NEAR_BITS = 54
#: Least hashes of one block, and blocks of a text: pairs at NEAR_SHARE meet with a probability of 0.996.
BAND_ROWS, BANDS = 5, 14
#: Nodes from here on stand for fingerprints that only null ids have.
NAMELESS = 1 << 62
#: Rows of a block that are compared in one task; larger blocks are cut into tiles.
TILE = 4096
#: Shingles of a group of candidates whose texts are compared in one task; larger groups are cut into tiles.
TILE_GRAMS = 1 << 16
#: Pairs looked at at once, which bounds memory.
PAIRS = 1 << 20


def shingles(text: bytes, k: int) -> list[bytes]:
    """k-word shingles of a text with A-Z lower-cased, or the whole sequence if there are fewer words."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from each hash (the finaliser of splitmix64), for fingerprints wider than a hash."""
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(text, k)], np.uint64)


def fingerprint(text: bytes, k: int, words: int = 1, different: bool = False) -> bytes:
    """Big-endian fingerprint of 8 x words bytes: a bit is 1 if it is set in over half the hashes of the shingles, or of the
    different shingles."""
    hashes = shingle_hashes(text, k)
    return majority(np.unique(hashes) if different else hashes, words)


def majority(hashes: np.ndarray, words: int) -> bytes:
    if not len(hashes):
        return bytes(8 * words)
    out = b""
    for w in range(words):
        mine = (mixed(hashes, w) if w else hashes).astype(">u8")
        count = np.zeros(64, np.int64)
        for i in range(0, len(mine), 65536):  # whole texts, in pieces of bounded memory
            part = mine[i : i + 65536]
            count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * count > len(mine)).tobytes()
    return out


def fingerprints(docs: DataFrame, k: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", different: bool = False) -> DataFrame:
    """(doc_id, fp binary, same binary) of whole texts, and for fingerprints of different shingles the texts' block ``keys``.
    Rows with equal ``same`` are one to the links: that is the fingerprint, or a digest of the whole set of shingles."""
    short_batches(docs.sparkSession)

    def found_in(text: bytes) -> tuple[bytes, ...]:
        hashes = shingle_hashes(text, k)
        if not different:
            return (fp := majority(hashes, words)), fp
        hashes = np.unique(hashes)
        return majority(hashes, words), xxhash.xxh3_128_digest(hashes.tobytes()), least_hashes(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [found_in(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).cast(pa.binary())]
            columns = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
            if different:
                keys = band_keys(np.array([x[2] for x in found], np.uint64).reshape(len(found), -1))
                columns.append(pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "fp", "same", "keys"][: 1 + len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, fp binary, same binary" + ", keys array<bigint>" * different)


def exact_parts(n: int, bits: int, most: int) -> list[list[int]]:
    """Bit positions of each block key. Cut into most + c parts, near fingerprints agree on c of them at least; c grows
    with the number of fingerprints, so that blocks stay small. Every choice finds all links."""
    c = 1
    while c < 4 and n * math.comb(most + c, c) / 2 ** (bits * c / (most + c)) > 4096:
        c += 1
    cuts = [round(i * bits / (most + c)) for i in range(most + c + 1)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum((parts[i] for i in some), []) for some in combinations(range(most + c), c)]


def recall_of(bits: int, similar: float, most: int, rows: int = BAND_ROWS, bands: int = BANDS) -> float:
    """Probability that a pair of that similarity agrees on all least hashes of some band, and that its fingerprints lie within
    ``most`` bits: over all their distances, since their mean would promise too much."""
    p = bits_apart(similar)
    near = sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(most + 1))
    return near * (1 - (1 - similar**rows) ** bands)


@lru_cache(1)
def orders() -> np.ndarray:
    """Odd factors, each of which orders hashes anew."""
    return np.random.default_rng(SEED).integers(0, 2**63, (BAND_ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of a text's hashes under each order."""
    least = np.full(BAND_ROWS * BANDS, np.uint64(2**64 - 1))
    hashes = hashes ^ (hashes >> np.uint64(32))
    for i in range(0, len(hashes), 4096):  # whole texts, in pieces of bounded memory
        least = np.minimum(least, (orders() * hashes[i : i + 4096]).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """Block keys (texts x BANDS) of texts' least hashes (texts x orders): each from a band's number and its values."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for row in least.reshape(len(least), BANDS, BAND_ROWS).transpose(2, 0, 1):
        key = mixed(key ^ row, 1)
    return key.view(np.int64)


def pivot_table(fps: np.ndarray, words: int) -> np.ndarray:
    """Hamming distances (n x PIVOTS) to seeded reference fingerprints; fps: n x words of uint64."""
    pivots = np.random.default_rng(SEED).integers(0, 2**64, (PIVOTS, words), dtype=np.uint64)
    return np.stack([np.bitwise_count(fps ^ p).sum(1) for p in pivots], 1).astype(np.int16)


class Links:
    """Finds the spanning links among rows whose pairs are given by run: exact checks behind the pivot filter."""

    def __init__(self, fps: np.ndarray, most: int):
        self.fps, self.most, self.table = fps, most, pivot_table(fps, fps.shape[1]).T.copy()
        self.by_word = fps.T.copy()
        self.forest = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.seen = self.passed = 0

    def look(self, i: np.ndarray, j: np.ndarray) -> None:
        self.seen += len(i)
        for d in self.table:
            near = np.abs(d[i] - d[j]) <= self.most
            before = len(i)
            if not near.all():
                i, j = i[near], j[near]
            if len(i) > 0.95 * before:  # within wide radii the references tell nothing apart
                break
        self.passed += len(i)
        far = np.zeros(len(i), np.int16)
        for w in self.by_word:  # one word at a time, which bounds memory
            far += np.bitwise_count(w[i] ^ w[j])
        near = far <= self.most
        if near.any():
            self.grow(i[near], j[near], far[near].astype(np.int64))

    def grow(self, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        """Keep a spanning forest of the nearest links: links enter in order of distance, each between two trees."""
        i, j, far = (np.concatenate([x, y]) for x, y in zip(self.forest, (i, j, far), strict=True))
        lab, taken = np.arange(len(self.fps)), []
        for d in np.unique(far).tolist():
            open_ = np.flatnonzero(far == d)
            while len(open_):
                a, b = lab[i[open_]], lab[j[open_]]
                apart = a != b
                open_, a, b = open_[apart], a[apart], b[apart]
                # Each larger root takes one link to a smaller one, so no ring closes.
                high, first = np.unique(np.maximum(a, b), return_index=True)
                lab[high] = np.minimum(a, b)[first]
                taken.append(open_[first])
                while ((up := lab[lab]) != lab).any():
                    lab = up
        kept = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        self.forest = i[kept], j[kept], far[kept]

    def pairs_in_runs(self, begin: np.ndarray, size: np.ndarray) -> None:
        """All pairs inside runs of consecutive rows."""
        left = np.repeat(begin + size, size) - np.arange(size.sum()) - 1 if len(size) else np.zeros(0, np.int64)  # partners after each row
        cum = np.concatenate([[0], np.cumsum(left)])
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(cum, cum[at] + PAIRS, "right")) - 1)
            n = left[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(cum[at:to] - cum[at], n)
            self.look(i, j)
            at = to

    def pairs_across(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(b)))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            self.look(np.repeat(part, len(b)), np.tile(b, len(part)))


def as_words(fp, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(-1, words)


def block_links(spark: SparkSession, distinct: DataFrame, parts: list[list[int]] | None, words: int, most: int) -> DataFrame:
    """Spanning links (a, b) between the nodes of ``distinct`` (node, fp) that lie within ``most`` bits in some block. Blocks are
    the given bit positions or, without them, those of a column ``keys``."""
    short = [np.array(p) for p in parts or []]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = as_words(b.column(1).to_numpy(zero_copy_only=False), words)
            bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), 8 * words), axis=1)
            keys = []
            for no, p in enumerate(short):
                packed = np.packbits(bits[:, p], axis=1)
                wide = np.zeros((len(fps), 8), np.uint8)
                wide[:, : min(8, packed.shape[1])] = packed[:, :8]
                keys.append(mixed(wide.view(np.uint64)[:, 0], no + 1).view(np.int64))
            n, m = len(fps), len(short)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.tile(b.column(0).to_numpy(), m)), pa.concat_arrays([b.column(1)] * m)], ["block", "node", "fp"]
            )

    def linked(find: Links, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node[find.forest[0]]), pa.array(node[find.forest[1]])], ["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; many whole blocks are taken together."""
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= 8 * TILE:
                t = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                block = t.column(0).to_numpy()
                last = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if last:
                    yield solve(t.slice(0, last))
                waiting = [t.slice(last)]
        if waiting:
            yield solve(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    def solve(t: pa.RecordBatch) -> pa.RecordBatch:
        block, node = t.column(0).to_numpy(), t.column(1).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        find = Links(as_words(t.column(2).to_numpy(zero_copy_only=False), words), most)
        find.pairs_in_runs(begin, np.diff(np.append(begin, len(block))))
        return linked(find, node)

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        find = Links(as_words(pdf["fp"].tolist(), words), most)
        one = np.flatnonzero((pdf["tile"] == key[1]).to_numpy())
        if key[1] == key[2]:
            find.pairs_across(one, one)
        else:
            find.pairs_across(one, np.flatnonzero((pdf["tile"] == key[2]).to_numpy()))
        return linked(find, pdf["node"].to_numpy()).to_pandas()

    if parts is None:
        # Most texts are alone in most of their blocks; those need not be sorted with their fingerprints.
        keys = keep(distinct.select("node", F.explode("keys").alias("block")), "block-keys")
        shared = keys.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        shared = keep(shared, "shared-blocks")
        met = join_groups(keys, shared, "block", "rows", keys.count()).drop("rows")
        rows = met.join(distinct.select("node", "fp"), "node").select("block", "node", "fp")
    else:
        rows = distinct.select("node", "fp").mapInArrow(lean(keyed), "block long, node long, fp binary")
    rows = keep(rows, "blocks")
    large = keep(rows.groupBy("block").count().where(F.col("count") > TILE), "large-blocks")
    out = None
    if not large.isEmpty():
        tiles = F.ceil(F.col("count") / TILE).cast("int")
        cut = join_groups(rows, large, "block", "count", rows.count()).withColumn("tiles", tiles)
        cut = cut.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        cut = cut.select("block", "node", "fp", "tile", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))
        out = cut.groupBy("block", "t1", "t2").applyInPandas(across, "a long, b long")
        rows = without_groups(rows, large, "block", "count", rows.count())
    small = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "node").mapInArrow(lean(within), "a long, b long")
    return small if out is None else small.unionByName(out)


def near_duplicates(docs: DataFrame, k: int, most: int, words: int = 1, similar: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links lead to).

    Without ``similar``, all fingerprints within ``most`` bits are linked. With it, blocks are runs of least hashes in which texts of
    that similarity meet with the recall of recall_of, and a link counts only if the two texts share that much of their
    shingles; only texts with the same set of shingles are one without it, whatever their fingerprints."""
    spark = docs.sparkSession
    rows = keep(fingerprints(docs, k, words, id_col, text_col, different=similar is not None), "fingerprints")
    total, bits = rows.count(), 64 * words
    others = [F.first("keys").alias("keys")] if similar is not None else []
    distinct = rows.groupBy("same").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), *others)
    nameless = F.lit(NAMELESS) + F.xxhash64("same").bitwiseAND(NAMELESS - 1)
    distinct = keep(distinct.withColumn("node", F.coalesce("node", nameless)), "distinct-fingerprints", total)
    n = distinct.count()
    parts = exact_parts(n, bits, most) if similar is None else None
    links = block_links(spark, distinct if similar is None else distinct.where(F.col("node") < NAMELESS), parts, words, most)
    if similar is not None:
        links = similar_links(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), links, k, similar)
    found = connected_components(links)
    least = F.coalesce("component", "node")
    settled = distinct.join(found, "node", "left").select("same", "n", F.when(least < NAMELESS, least).alias("component_id"))
    return join_groups(rows.select("doc_id", "fp", "same"), keep(settled, "components", n), "same", "n", total).select("doc_id", "fp", "component_id")


def bits_apart(similar: float) -> float:
    """Expected share of differing bits between texts that share ``similar`` of their shingles."""
    return math.acos(min(1.0, 2 * similar / (1 + similar))) / math.pi


def similar_links(texts: DataFrame, links: DataFrame, k: int, similar: float) -> DataFrame:
    """Links (a, b) between texts that share at least ``similar`` of all their different shingles.

    The given links may be a forest of candidates. Texts that they join form a group, and the links lead to a text's whole
    component of similar texts in its group: links that hold join trees, and where a group keeps several trees, their texts
    are compared in full."""
    links = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "candidate-links")
    nodes = links.select(F.col("a").alias("doc_id")).union(links.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = keep(nodes, "candidate-texts")
    some = texts.where("doc_id IS NOT NULL").join(F.broadcast(nodes.select("doc_id")) if nodes.count() <= FEW_KEYS else nodes.select("doc_id"), "doc_id")
    word = F.filter(F.split(F.translate(full_text(F.col("text")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SPACE), lambda w: w != "")
    some = some.select("doc_id", word.alias("w")).withColumn("size", F.size("w"))
    at = F.sequence(F.lit(1), F.col("size") - (k - 1))
    grams = F.when(F.col("size") >= k, F.transform(at, lambda i: F.xxhash64(*[F.element_at("w", i + j) for j in range(k)]))).otherwise(F.array(F.xxhash64("w")))
    sets = some.select("doc_id", F.array_distinct(grams).alias("grams")).groupBy("doc_id").agg(F.first("grams").alias("grams"))
    sets = keep(sets.join(nodes, "doc_id"), "shingle-sets")
    total = 2 * links.count()
    one = join_groups(links.withColumnRenamed("a", "doc_id"), sets.withColumnRenamed("grams", "of_a"), "doc_id", "n", total).select(F.col("doc_id").alias("a"), "b", "of_a")
    both = join_groups(one.withColumnRenamed("b", "doc_id"), sets.withColumnRenamed("grams", "of_b"), "doc_id", "n", total)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    checked = both.where(shared >= similar * (F.size("of_a") + F.size("of_b") - shared)).select("a", F.col("doc_id").alias("b"))
    checked = keep(checked, "checked-links", total)
    return checked.unionByName(tree_links(sets, links, checked, similar))


def tree_links(sets: DataFrame, links: DataFrame, checked: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that hold between different trees of ``checked`` in one group of ``links``, enough to join all trees that
    similar texts join. A group of two has no pair left to check, and pairs inside a tree need no check; all others are
    compared, in tiles, and a task emits no pairs but links that join trees."""
    groups, trees = connected_components(links), connected_components(checked)
    member = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    member = member.join(trees.select(F.col("node").alias("doc_id"), F.col("component").alias("tree")), "doc_id", "left")
    member = member.withColumn("tree", F.coalesce("tree", "doc_id")).join(sets.select("doc_id", F.size("grams").cast("long").alias("size")), "doc_id")
    member = keep(member, "group-members")
    total = member.count()
    sizes = member.groupBy("group", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("trees"), F.sum("size").alias("size"), F.max_by(F.struct("tree", "size"), F.struct("n", "tree")).alias("main"))
    # The tiles of the largest tree come after the others, and meet only those.
    apart = F.ceil((F.col("size") - F.col("main.size")) / TILE_GRAMS).cast("int")
    largest = F.ceil(F.col("main.size") / TILE_GRAMS).cast("int")
    sizes = sizes.where("trees > 1 AND n > 2").select("group", "n", F.col("main.tree").alias("main"), apart.alias("apart"), largest.alias("largest"))
    sizes = keep(sizes, "open-groups", total)
    cut = join_groups(member.drop("size"), sizes, "group", "n", total).select("group", "doc_id", "tree", (F.col("tree") == F.col("main")).alias("in_main"), "apart", "largest")
    number = F.xxhash64("doc_id")
    tile = F.when(F.col("in_main"), F.col("apart") + F.pmod(number, F.col("largest"))).otherwise(F.pmod(number, F.col("apart"))).cast("int")
    cut = cut.join(sets.select("doc_id", "grams"), "doc_id").withColumn("tile", tile)
    meets = F.when(F.col("in_main"), F.col("apart")).otherwise(F.col("apart") + F.col("largest"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    cut = cut.select("group", "doc_id", "tree", "in_main", "grams", "tile", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        node, tile, lab = pdf["doc_id"].to_numpy(), pdf["tile"].to_numpy(), pdf["tree"].to_numpy().copy()
        size = np.fromiter(map(len, pdf["grams"]), np.int64, len(pdf))
        begin = np.cumsum(size) - size
        known, gram = np.unique(np.concatenate(pdf["grams"].tolist()), return_inverse=True)
        mine = np.zeros(len(known), bool)
        links = []
        for i in np.flatnonzero(~pdf["in_main"].to_numpy()).tolist():
            # Sizes further apart than this can't share enough.
            some = np.flatnonzero((tile == key[1] + key[2] - tile[i]) & (lab != lab[i]) & (np.minimum(size, size[i]) >= similar * np.maximum(size, size[i])))
            if not len(some):
                continue
            at = gram[begin[i] : begin[i] + size[i]]
            mine[at] = True
            shared = totals(mine[gram[ragged(begin[some], size[some])]], size[some])
            mine[at] = False
            some = some[shared >= similar * (size[i] + size[some] - shared)]
            joined, first = np.unique(lab[some], return_index=True)
            links += [(node[i], node[j]) for j in some[first].tolist()]
            lab[np.isin(lab, joined)] = lab[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cut.groupBy("group", "t1", "t2").applyInPandas(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with the columns it came with. Near copies
    share NEAR_SHARE or more of their five-word shingles; such texts' wide fingerprints lie within NEAR_BITS of each other."""
    found = near_duplicates(docs, 5, NEAR_BITS, NEAR_WORDS, NEAR_SHARE, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return without_rows(packed(docs, doc_id=F.col(id_col).cast("long")), keep(gone, "near-copies")).select("row.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, k=4, most=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
