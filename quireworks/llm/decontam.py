"""Benchmark decontamination: spaced-seed hashes find benchmark passages in documents, also with words replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import free_name, join_sized, mix64, prepare, stage, text_column, word_hashes

#: 1: the word counts, 0: it is ignored
MASKS = ("11011", "1101011", "10110011", "110010101")
MIN_WORDS = 12
IDENTITY = 0.8
#: Powers of two between which the bit filter's size lies: 8 MB to 64 MB
MIN_BITS, MAX_BITS = 26, 29
#: Documents up to which their (id, digest) rows are broadcast, 16 bytes each
FEW = 1_000_000


def seeds(words: np.ndarray, offsets: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a mask at every place where it fits inside one text."""
    span, total = len(mask), len(words)
    if total < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(total - span + 1, (number + 1) % (1 << 64), np.uint64)
    weight = 0xD6E8FEB86659FD93
    for k, bit in enumerate(mask):
        if bit == "1":
            h += words[k : total - span + 1 + k] * np.uint64(weight)
            weight = weight * 0xA0761D6478BD642F % (1 << 64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
    at = np.nonzero(np.arange(len(h)) + span <= ends)[0]
    return at, mix64(h[at])


def best_segment(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(start, end, matches) of the longest run of positions of which at least `identity` match, between two matches."""
    # a match gains what keeps the balance with mismatches at that identity; a run passes if its sum is not negative
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - identity, -identity))])
    low = np.minimum.accumulate(score)
    first = np.searchsorted(-low, -(score + 1e-9), "left")
    end = int(np.argmax(np.arange(len(score)) - first))
    start = int(first[end])
    inside = np.nonzero(same[start:end])[0]
    if not len(inside):
        return 0, 0, 0
    return start + int(inside[0]), start + int(inside[-1]) + 1, len(inside)


def _benchmark_seeds(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(hash, item, place) of every mask at every place of each item; an item too short for any mask is one seed, whole."""
    narrowest = min(map(len, masks))
    for batch in batches:
        words, offsets = word_hashes(text_column(batch))
        lengths = np.diff(offsets)
        found = [seeds(words, offsets, mask, number) for number, mask in enumerate(masks)]
        for n in range(1, narrowest):
            at, h = seeds(words, offsets, "1" * n, -n)
            whole = np.isin(at, offsets[:-1][lengths == n])
            found.append((at[whole], h[whole]))
        at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        row = np.searchsorted(offsets, at, "right") - 1
        items = batch.column(batch.schema.get_field_index("item")).take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), items, pa.array((at - offsets[row]).astype(np.int32)), pa.array(np.minimum(lengths[row], narrowest).astype(np.int32))],
            ["hash", "item", "place", "short"],
        )


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of 2**bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(64 - bits)) & mask).astype(np.int64)


def _filter_pieces(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct (piece, bit) of the hashes, 2**16 bits to a piece."""
    for batch in batches:
        at = np.unique(np.concatenate(_probes(batch.column("hash").to_numpy().view(np.uint64), bits)))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32))], ["piece", "bit"])


def _packed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece: each piece's bits, packed."""
    held, bits = None, np.zeros(1 << 16, bool)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["piece", "bits"])

    for batch in batches:
        pieces, at = batch.column("piece").to_numpy(), batch.column("bit").to_numpy()
        cuts = np.concatenate([[0], np.nonzero(np.diff(pieces))[0] + 1, [len(pieces)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held is not None and pieces[lo] != held:
                yield out()
                bits[:] = False
            held = int(pieces[lo])
            bits[at[lo:hi]] = True
    if held is not None:
        yield out()


def _seed_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A filter that holds the hashes, packed, and its size as a power of two: 16 bits a hash, within MIN_BITS and MAX_BITS.

    Its size is bounded whatever the benchmark's; a fuller filter lets more seeds pass to the join, and loses none.
    """
    n = hashes.count()
    bits = min(max(MIN_BITS, (16 * max(n, 1)).bit_length()), MAX_BITS)
    parts = max(1, min(1 << (bits - 16), n // 1_000_000 + 1))
    pieces = hashes.mapInArrow(lambda it: _filter_pieces(it, bits), "piece int, bit int").repartition(parts, "piece").sortWithinPartitions("piece")
    table = pieces.mapInArrow(_packed_pieces, "piece int, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for piece, raw in zip(table.column("piece").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out[piece << 13 : (piece + 1) << 13] = np.frombuffer(raw, np.uint8)
    return out, bits


def _document_seeds(batches: Iterator[pa.RecordBatch], held: Broadcast, masks: tuple[str, ...], short: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Seeds of documents that the filter lets pass: doc_id, digest, hash, place."""
    packed, bits = held.value
    for batch in batches:
        words, offsets = word_hashes(text_column(batch))
        found = []
        for number, mask in [*enumerate(masks), *((-n, "1" * n) for n in short)]:
            at, h = seeds(words, offsets, mask, number)
            for k in (0, 1):
                probe = _probes(h, bits)[k]
                some = packed[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8) & 1 == 1
                at, h = at[some], h[some]
            found.append((at, h))
        at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        row = np.searchsorted(offsets, at, "right") - 1
        take = pa.array(row)
        columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("doc_id", "digest")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(h.view(np.int64)), pa.array((at - offsets[row]).astype(np.int32))], ["doc_id", "digest", "hash", "place"])


SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matches long, identity double"


def _overlaps(batches: Iterator[pa.RecordBatch], min_words: int, identity: float) -> Iterator[pa.RecordBatch]:
    """Rows by document, its text before its candidates: the best overlap of each document and item that passes.

    One document's words and one item's are held at a time.
    """
    doc = doc_words = held = pair = own = best = None
    rows: list[tuple] = []

    def close() -> None:
        if best is not None:
            rows.append((doc[0], pair, *best, best[3] / best[2]))

    for batch in batches:
        words, offsets = word_hashes(text_column(batch))
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "digest", "item", "item_id", "shift")]
        for i, (doc_id, digest, item, item_id, shift) in enumerate(zip(*columns, strict=True)):
            mine = words[offsets[i] : offsets[i + 1]]
            if item is None:
                close()
                doc, doc_words, pair, held, best = (doc_id, digest), mine.copy(), None, None, None
                continue
            if item != held:
                close()
                held, pair, own, best = item, item_id, mine.copy(), None
            first, last = max(0, -shift), min(len(own), len(doc_words) - shift)
            if last <= first:
                continue
            start, end, matches = best_segment(own[first:last] == doc_words[first + shift : last + shift], identity)
            if matches >= min(min_words, len(own)) and matches >= identity * (end - start) and (best is None or matches > best[3]):
                best = (first + start + shift, first + start, end - start, matches)
        if rows:
            yield _overlap_batch(rows)
            rows.clear()
    close()
    if rows:
        yield _overlap_batch(rows)


def _overlap_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, identity: float = IDENTITY,
) -> DataFrame:
    """Overlaps between documents (doc_id, text) and benchmark items (item_id, text).

    One row per document and item whose best overlap, without gaps, has at least min_words equal words (all words of a
    shorter item) and at least `identity` of its words equal: doc_id, item_id, where it starts in either (in words),
    its length, matches and identity; of equally good ones, the one with the smallest shift.  Words are maximal runs
    without white space, in lower case.  Null or empty texts have no overlap.  Rows with a null id take part and keep the
    null; rows that repeat an id and a text are one.  Extra columns are ignored; empty tables give an empty result.

    Both sides' spaced-seed hashes are joined: the benchmark's are a table, the documents' pass a bit filter of bounded
    size first, so that only those that very likely meet some item are shuffled.  Every pair that shares a seed is then
    verified on whole words, at each shift its seeds name.  Items narrower than the masks are one seed, taken whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items, items_at = stage(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text("text").alias("text")), "items")
    theirs, _ = stage(items.select("item", "text").mapInArrow(lambda it: _benchmark_seeds(it, masks), "hash long, item long, place int, short int"), "item-seeds")
    narrowest = min(map(len, masks))
    short = tuple(sorted(r[0] for r in theirs.where(F.col("short") < narrowest).select("short").distinct().collect()))
    held = spark.sparkContext.broadcast(_seed_filter(theirs.select("hash").distinct()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("text").alias("text")).withColumn("digest", F.xxhash64("text"))
    mine = texts.mapInArrow(lambda it: _document_seeds(it, held, masks, short), "doc_id long, digest long, hash long, place int")
    met = join_sized(mine.withColumnRenamed("place", "doc_place"), theirs.select("hash", "item", "place"), "hash", "inner")
    shifts, _ = stage(met.select("doc_id", "digest", "item", (F.col("doc_place") - F.col("place")).alias("shift")).distinct(), "shifts")

    found, _ = stage(shifts.select("doc_id", "digest").distinct(), "documents-met")
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["digest"] == found["digest"])
    with_text = texts.join(F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "digest"])
    candidates = join_sized(shifts, items, "item", "inner").select("doc_id", "digest", "item", "item_id", "shift", "text")
    rows = with_text.unionByName(candidates, allowMissingColumns=True)
    ordered = rows.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "item", "shift")
    return ordered.select("doc_id", "digest", "item", "item_id", "shift", "text").mapInArrow(lambda it: _overlaps(it, min_words, identity), SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without an overlap, with all their columns, whatever their names.

    A document goes if any row of its id has an overlap; rows with a null id stay.  Null and empty texts stay, repeated
    rows share their fate, an empty benchmark keeps every document and an empty table is an empty result.
    """
    hit = free_name(docs, "hit")
    found = contaminated(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(hit), "left_anti")
