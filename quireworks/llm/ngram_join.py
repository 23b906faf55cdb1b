"""Near-duplicate self join: MinHash bands find candidates, full word n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import discard, free_name, mix64, prepare, shingle_hashes, stage, text_column, word_hashes
from quireworks.llm.graph import connected_components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 256
BLOCK = 96
#: Cells that shingles of large components are counted in, to put them in order; two that share a cell count as one
CELLS = 1 << 18


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that a pair at the threshold meets in a band with this recall."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _band_keys(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) uint64: each band's hash of `rows` minima over the text's shingles.  Every text has a shingle."""
    rng = np.random.default_rng(20_240_229)
    mult = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    keys = np.zeros((len(offsets) - 1, bands), np.uint64)
    starts = offsets[:-1]
    h = np.empty_like(x)
    for band in range(bands):
        acc = np.full(len(starts), band + 1, np.uint64)
        for r in range(rows):
            i = band * rows + r
            np.multiply(x, mult[i], out=h)
            h ^= h >> np.uint32(15)
            h += add[i]
            h *= np.uint32(0x2C1B3C6D)
            acc = mix64(acc ^ np.minimum.reduceat(h, starts).astype(np.uint64))
        keys[:, band] = acc
    return keys


def _signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, offsets = word_hashes(text_column(batch))
        full = np.diff(offsets) > 0
        shingles, at = shingle_hashes(words, offsets, width)
        at = np.concatenate([at[:-1][full], at[-1:]])
        keys = _band_keys(shingles, at, bands, rows) if full.any() else np.zeros((0, bands), np.uint64)
        # a digest of the word sequence: equal texts (up to case and white space) need no pairwise work
        whole = np.zeros((2, full.sum()), np.uint64)
        if full.any():
            starts = offsets[:-1][full]
            position = np.arange(len(words), dtype=np.uint64) - np.repeat(starts, np.diff(offsets)[full]).astype(np.uint64)
            for k in range(2):
                whole[k] = mix64(np.add.reduceat(mix64(words ^ mix64(position * np.uint64(2 * k + 3) + np.uint64(k))), starts))
        n = batch.num_rows
        row = np.full(n, -1, np.int64)
        row[full] = np.arange(full.sum())
        take = pa.array(row, mask=row < 0)
        digests = pa.Array.from_buffers(pa.binary(16), int(full.sum()), [None, pa.py_buffer(np.ascontiguousarray(whole.T))])
        lists = pa.ListArray.from_arrays(np.arange(full.sum() + 1, dtype=np.int32) * bands, pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), digests.cast(pa.binary()).take(take), lists.take(take)], ["doc_id", "text_hash", "digest", "bands"])


class _Block:
    """The members of one pair of blocks: their shingle sets and band keys; links them and counts links."""

    def __init__(self, threshold: float):
        self.threshold, self.rows = threshold, []

    def links(self) -> tuple[list[int], list[int], list[int]]:
        """(ids, links of each within this unit, a representative of each one's class within this unit)"""
        ids = np.array([r[0] for r in self.rows], np.int64)
        side = np.array([r[1] for r in self.rows], np.int8)
        weight = np.array([r[2] for r in self.rows], np.int64)
        keys = np.stack([r[3] for r in self.rows])
        sets = [r[4] for r in self.rows]
        n = len(ids)
        count, parent = np.zeros(n, np.int64), list(range(n))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        two = side.max() > 0
        near = np.zeros((n, n), bool)
        for band in range(keys.shape[1]):
            k = keys[:, band]
            near |= k[:, None] == k[None, :]
        near &= np.triu(np.ones((n, n), bool), 1)
        if two:
            near &= side[:, None] != side[None, :]
        sizes = np.array([len(s) for s in sets])
        left, right = np.nonzero(near)
        least, most = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        possible = least >= self.threshold * most - 1e-9
        for i, j in zip(left[possible], right[possible], strict=True):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= self.threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                count[i] += weight[j]
                count[j] += weight[i]
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = [int(ids[find(i)]) for i in range(n)]
        return ids.tolist(), count.tolist(), roots


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Batches sorted by unit; each unit holds the candidates of one component, or one pair of its blocks."""
    unit, last, block = None, None, _Block(threshold)

    def flush() -> pa.RecordBatch:
        ids, counts, roots = block.links()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64())], ["doc_id", "links", "root"])

    for batch in batches:
        words, offsets = word_hashes(text_column(batch))
        shingles, at = shingle_hashes(words, offsets, width)
        units, ids = batch.column("unit").to_pylist(), batch.column("doc_id").to_pylist()
        sides, copies, texts = batch.column("side").to_pylist(), batch.column("copies").to_pylist(), batch.column("text_hash").to_pylist()
        lists = batch.column("bands")
        keys = lists.flatten().to_numpy().reshape(len(ids), -1)
        for i, u in enumerate(units):
            if u != unit and block.rows:
                yield flush()
                block = _Block(threshold)
            if (u, ids[i], texts[i]) == last:
                continue  # a row that repeats an id and a text
            unit, last = u, (u, ids[i], texts[i])
            block.rows.append((ids[i], sides[i], copies[i], keys[i].copy(), np.unique(shingles[at[i] : at[i + 1]])))
    if block.rows:
        yield flush()


def _set_rows(batch: pa.RecordBatch, name: str, width: int) -> list[np.ndarray]:
    """The shingle set of each text of a column, in order of the hashes."""
    shingles, at = shingle_hashes(*word_hashes(text_column(batch, name)), width)
    return [np.unique(shingles[at[i] : at[i + 1]]) for i in range(batch.num_rows)]


def _cells(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(20)).astype(np.int64) % CELLS


def _cell_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for one in _set_rows(batch, "text", width):
            np.add.at(counts, _cells(one), 1)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["cell", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each set of n the n - ceil(threshold * n) + 1 rarest shingles: two sets as similar as that share one of these.

    Any order that is the same for all sets will do; this one is by the count of the shingle's cell, then by its hash.
    """
    for batch in batches:
        found = []
        for one in _set_rows(batch, "text", width):
            keep = len(one) - math.ceil(threshold * len(one) - 1e-9) + 1
            found.append(one[np.lexsort((one, counts[_cells(one)]))[: max(keep, 1)]].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), keys], ["node", "component", "keys"])


def _near_hub(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whether a set's distance (1 - similarity) to its hub's is at most half of that of a link.  The distance is a metric,
    so any two such sets of one hub are linked."""
    for batch in batches:
        pairs = zip(_set_rows(batch, "text", width), _set_rows(batch, "hub_text", width), strict=True)
        tight = []
        for mine, hub in pairs:
            both = len(np.intersect1d(mine, hub, assume_unique=True))
            tight.append(both >= (1 + threshold) / 2 * (len(mine) + len(hub) - both) + 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(tight, pa.bool_())], ["node", "tight"])


def _dealt(texts: DataFrame, reps: DataFrame, large: DataFrame, small: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Members of large candidate components dealt to blocks, beside those of small ones; pairs of blocks to compare; paths.

    (node, block, crowd): members of a crowd (named by its hub) are linked to each other and only compared with others.
    (block, other): blocks of which some n-gram among the rarest is in a member of each.
    """
    spark = texts.sparkSession
    if large.isEmpty():
        return small, spark.createDataFrame([], "block string, other string"), []
    wanted = large.join(reps.select(F.col("rep").alias("node"), "text_hash"), "node").withColumnRenamed("node", "doc_id")
    big = texts.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    big, big_at = stage(big.select(F.col("doc_id").alias("node"), "component", "text"), "large-components")
    cells = big.select("text").mapInArrow(lambda it: _cell_counts(it, width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    rarest, rarest_at = stage(
        big.mapInArrow(lambda it: _prefixes(it, shared.value, width, threshold), "node long, component long, keys array<long>"), "rarest"
    )
    buckets = rarest.select("node", "component", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("component", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met, met_at = stage(buckets.join(hubs, ["component", "key"]), "rarest-buckets")
    parts, parts_at = stage(connected_components(met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "parts")
    sizes = parts.groupBy("component").agg((F.count("*") > BLOCK).alias("large"))
    firsts = met.groupBy("node").agg(F.min("hub").alias("first"))
    placed, placed_at = stage(parts.join(sizes, "component").join(firsts, "node"), "part-members")
    blocks = placed.where("large").groupBy("first").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    salted, salted_at = stage(
        placed.where("large").join(blocks, "first").select("node", "first", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("k")), "part-blocks"
    )
    # an id with several texts is in no crowd and leads none
    single = big.groupBy("node").agg(F.count("*").alias("n"), F.first("text").alias("text")).where("n = 1").drop("n")
    leaders = blocks.join(single.select(F.col("node").alias("first"), F.col("text").alias("hub_text")), "first").select(
        "first", "hub_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")
    )
    beside = salted.drop("blocks").join(single, "node").join(leaders, ["first", "k"]).select("node", "text", "hub_text")
    near, near_at = stage(beside.mapInArrow(lambda it: _near_hub(it, width, threshold), "node long, tight boolean"), "near-hub")
    tight = F.coalesce("tight", F.lit(False))
    block = F.concat_ws(":", "first", F.when(tight, "near").otherwise("far"), "k")
    apart = salted.join(near, "node", "left").select("node", block.alias("block"), F.when(tight, F.col("first")).alias("crowd"))
    whole = placed.where("not large").select("node", F.col("component").cast("string").alias("block"), F.lit(None).cast("long").alias("crowd"))
    apart, apart_at = stage(apart, "blocks")
    dealt, dealt_at = stage(small.union(whole).union(apart), "dealt")
    of_bucket, of_bucket_at = stage(met.join(apart, "node").select("component", "key", "block", "crowd").distinct(), "bucket-blocks")
    others = of_bucket.withColumnsRenamed({"block": "other", "crowd": "other_crowd"})
    pairs, pairs_at = stage(
        of_bucket.join(others, ["component", "key"]).where("block < other and coalesce(crowd <> other_crowd, true)").select("block", "other").distinct(), "block-pairs"
    )
    shared.unpersist()
    discard(spark, big_at, rarest_at, met_at, parts_at, placed_at, salted_at, near_at, apart_at, of_bucket_at)
    return dealt, pairs, [dealt_at, pairs_at]


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
    max_hashes: int = MAX_HASHES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Group documents whose word n-gram sets have a Jaccard similarity of `threshold` or more.

    One row per document: doc_id, class_id (smallest id of the connected component), n_links (documents it is similar
    to, exact copies counted one by one), class_size.  Words are maximal runs without white space, in lower case; a
    text of fewer than `width` words has one n-gram, all its words; texts without words (null, empty, blank) and
    documents without a partner are classes of their own with no link.  Rows that repeat an id and a text (up to case
    and white space) are one document; an id with several texts is one node with the links of all.  Rows with a null id are classes of
    their own, with a null class_id, and link to nothing.  Extra columns are ignored; an empty table gives an empty result.

    Equal word sequences are first reduced to one representative.  Representatives meet in the buckets of MinHash bands;
    the buckets' stars, not their pairs, are joined to candidate components.  A component of up to BLOCK members is
    compared in one unit.  In a larger one, sets meet again only if they share one of their rarest n-grams, which two
    similar sets always do and texts with a common line do not; that gives smaller components.  Where one is still large,
    members that are so near to the smallest id they meet that they must all be similar to each other are a crowd, whose
    links are counted without pairs.  The others, and what lies between crowds, are dealt to blocks of about BLOCK, and two
    blocks are compared only if some bucket holds members of both.  A compared pair is verified on the full sets if any band
    agrees; no task holds more than two blocks.
    """
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = banding(threshold, recall, max_hashes)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))

    signed, signed_at = stage(
        texts.mapInArrow(lambda it: _signatures(it, bands, rows, width), "doc_id long, text_hash long, digest binary, bands array<long>"), "signatures"
    )
    reps, reps_at = stage(
        signed.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.countDistinct("doc_id").alias("copies"), F.first("bands").alias("bands"))
        .select("digest", F.col("m.doc_id").alias("rep"), F.col("m.text_hash").alias("text_hash"), "copies", "bands"),
        "representatives",
    )
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    hubs, hubs_at = stage(
        buckets.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs"
    )
    met, met_at = stage(buckets.join(hubs, ["band", "key"]), "buckets")
    stars = met.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    candidates, candidates_at = stage(connected_components(stars), "candidates")

    sizes, sizes_at = stage(candidates.groupBy("component").agg((F.count("*") > BLOCK).alias("large")), "component-sizes")
    placed, placed_at = stage(candidates.join(sizes, "component"), "members")
    small = placed.where("not large").select("node", F.col("component").cast("string").alias("block"), F.lit(None).cast("long").alias("crowd"))
    dealt, pairs, dealt_at = _dealt(texts, reps, placed.where("large").select("node", "component"), small, width, threshold)
    units = (
        dealt.where("crowd is null").select("block").distinct().select("block", F.col("block").alias("unit"), F.lit(0).alias("side"))
        .union(pairs.select("block", F.concat_ws("|", "block", "other"), F.lit(0)))
        .union(pairs.select("other", F.concat_ws("|", "block", "other"), F.lit(1)))
    )
    members = dealt.drop("crowd").join(units, "block").join(reps.select(F.col("rep").alias("node"), "text_hash", "copies", "bands"), "node")
    work = texts.join(members.withColumnRenamed("node", "doc_id"), ["doc_id", "text_hash"]).repartition("unit").sortWithinPartitions("unit", "doc_id", "text_hash")
    found, found_at = stage(
        work.select("unit", "doc_id", "text_hash", "side", "copies", "bands", "text")
        .mapInArrow(lambda it: _verify(it, width, threshold), "doc_id long, links long, root long"),
        "links",
    )
    # all pairs of a crowd are links: each member has those to the crowd's other documents
    crowds = dealt.where("crowd is not null").join(reps.select(F.col("rep").alias("node"), "copies"), "node")
    whole = crowds.groupBy("crowd").agg(F.sum("copies").alias("all"))
    found = found.union(crowds.join(whole, "crowd").select(F.col("node").alias("doc_id"), (F.col("all") - F.col("copies")).alias("links"), F.col("crowd").alias("root")))
    classes = connected_components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links")).select(F.col("doc_id").alias("rep"), "links")
    per_rep = (
        reps.select("digest", "rep", "copies").join(links, "rep", "left")
        .join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    per_rep, per_rep_at = stage(per_rep, "per-representative")
    class_sizes, class_sizes_at = stage(per_rep.groupBy("class_id").agg(F.sum("copies").alias("class_size")), "class-sizes")
    sized, sized_at = stage(per_rep.join(class_sizes, "class_id"), "per-representative")
    known = signed.where("doc_id is not null")
    with_words = known.where("digest is not null").select("doc_id", "digest").distinct().join(sized, "digest").select("doc_id", "class_id", "n_links", "class_size").distinct()
    alone = known.where("digest is null").select("doc_id").distinct().union(signed.where("doc_id is null").select("doc_id")).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size")
    )
    out, _ = stage(with_words.union(alone), "classes")
    discard(
        spark, signed_at, reps_at, hubs_at, met_at, candidates_at, sizes_at, placed_at, *dealt_at, found_at, per_rep_at, class_sizes_at, sized_at,
    )
    return out


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Documents with only the smallest id of each class of near duplicates, with all their columns, whatever their names.

    Rows with a null id stay, and so do repeated rows of an id that stays; an id with several texts stays if it is the
    smallest of one of their classes.  An empty table gives an empty result.
    """
    classes = near_duplicates(docs, threshold, width)
    one = free_name(docs, "dropped_id")
    drop = classes.groupBy(F.col("doc_id").alias(one)).agg(F.min(F.col("class_id") < F.col("doc_id")).alias("other")).where("other").select(one)
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(one), "left_anti")
