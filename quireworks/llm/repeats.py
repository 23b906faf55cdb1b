"""Substring deduplication: windows of words that occur earlier, found by doubling the length of repeated windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.llm.common import STAGED, ascii_words, mix64, new_path, prepare, string_hashes, text_column

#: Windows of this many words or fewer are not halved again
SHORTEST = 5
#: Where a null doc_id stands in the order of documents: after every number
LAST = (1 << 63) - 1

BLOCK = "block long, doc_ids array<long>, offsets array<long>, ids binary, n_ids long, vocabulary binary, n_vocabulary long"
_CODEC = "zstd"


def lengths(words: int) -> list[int]:
    """The window lengths that are looked at in turn, each at most twice the one before it; the last is `words`."""
    found = [words]
    while found[0] > SHORTEST:
        found.insert(0, -(-found[0] // 2))
    return found


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: the words of a batch of documents as numbers of the block's own vocabulary, compressed."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        words, offsets = ascii_words(text_column(batch))
        coded = pc.dictionary_encode(words)
        ids, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), " ".join(coded.dictionary.to_pylist()).encode()
        yield pa.record_batch([
            pa.array([(part << 32) + k], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([offsets], pa.list_(pa.int64())), pa.array([bytes(pa.compress(ids, _CODEC))], pa.binary()), pa.array([len(ids)], pa.int64()),
            pa.array([bytes(pa.compress(vocabulary, _CODEC))], pa.binary()), pa.array([len(vocabulary)], pa.int64()),
        ], ["block", "doc_ids", "offsets", "ids", "n_ids", "vocabulary", "n_vocabulary"])


class _Block:
    """One block, read back; hashes of windows are made as they are asked for."""

    def __init__(self, row: dict, words: int):
        self.sizes, self.words = lengths(words), words
        self.block, self.offsets, self.doc_ids = row["block"], np.array(row["offsets"], np.int64), row["doc_ids"]
        self.ids = np.frombuffer(pa.decompress(row["ids"], row["n_ids"], _CODEC), np.int32) if row["n_ids"] else np.zeros(0, np.int32)
        text = bytes(pa.decompress(row["vocabulary"], row["n_vocabulary"], _CODEC)).decode() if row["n_vocabulary"] else ""
        self.vocabulary = pa.array(text.split(" ") if text else [], pa.string())
        counts = np.maximum(np.diff(self.offsets) - words + 1, 0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        #: where windows start, and the row each belongs to
        self.starts = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.offsets[:-1], counts)
        self.rows = np.repeat(np.arange(len(counts)), counts)
        self._hash = [self._first()]

    def _first(self) -> np.ndarray:
        of_word = mix64(string_hashes(self.vocabulary) + np.uint64(0x9E3779B97F4A7C15))[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        n, weight = max(len(of_word) - self.sizes[0] + 1, 0), 1
        out = np.zeros(n, np.uint64)
        for k in range(self.sizes[0]):
            out += of_word[k : k + n] * np.uint64(weight)
            weight = weight * 0xD6E8FEB86659FD93 % (1 << 64)
        return mix64(out)

    def hashes(self, level: int) -> np.ndarray:
        """Hashes of all windows of the level's length: of two windows of the level below, which together cover them."""
        while len(self._hash) <= level:
            k = len(self._hash)
            half, step = self._hash[-1], self.sizes[k] - self.sizes[k - 1]
            n = max(len(half) - step, 0)
            self._hash.append(mix64(half[:n] * np.uint64(0xA24BAED4963EE407) + half[step : step + n]))
        return self._hash[level]

    def chosen(self, level: int, starts: np.ndarray) -> np.ndarray:
        """For full windows at `starts`, the place of the window of the level's length that stands for each: of those
        inside it the one with the smallest hash, of equal ones the first.  Equal full windows choose equally."""
        h, width, span = self.hashes(level), self.words - self.sizes[level] + 1, 1
        best = np.arange(len(h))
        while span < width:
            step = min(span, width - span)
            a, b = best[: len(best) - step], best[step:]
            best, span = np.where(h[b] < h[a], b, a), span + step
        return best[starts]


def _in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def _keys(values: list | None) -> np.ndarray:
    return np.sort(np.array(values or [], np.int64).view(np.uint64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


PAIRS = "key long, block long, n long, doc long, start long"


def _pairs(words: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's candidates at a level: each window's key once with the number of its places and, at full length, the
    first of them.  Below the first level only windows inside full windows whose choice survived the level before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, words)
            starts, rows = b.starts, b.rows
            if level:
                alive = _in(_keys(row["keys"]), b.hashes(level - 1)[b.chosen(level - 1, starts)])
                starts, rows = starts[alive], rows[alive]
            if not len(starts):
                continue
            full = level == len(b.sizes) - 1
            if full:
                docs = np.array([LAST if d is None else d for d in b.doc_ids], np.int64)[rows]
                places = starts - b.offsets[rows]
                keys = b.hashes(level)[starts]
                order = np.lexsort((places, docs, keys))
                keys = keys[order]
                heads = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
                keys, counts, docs, places = keys[heads], np.diff(np.append(heads, len(keys))), docs[order][heads], places[order][heads]
            else:
                keys, counts = np.unique(b.hashes(level)[np.unique(b.chosen(level, starts))], return_counts=True)
                docs = places = np.zeros(len(keys), np.int64)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), b.block)), pa.array(counts.astype(np.int64)), pa.array(docs), pa.array(places)], ["key", "block", "n", "doc", "start"])

    return run


def _remove(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The documents of a block without what repeats: `later` are keys first seen elsewhere, `here` keys first seen here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, words)
            hashes = b.hashes(len(b.sizes) - 1)[b.starts]
            gone = _in(_keys(row["later"]), hashes)
            mine = np.nonzero(_in(_keys(row["here"]), hashes))[0]
            if len(mine):
                docs = np.array([LAST if d is None else d for d in b.doc_ids], np.int64)[b.rows[mine]]
                places = b.starts[mine] - b.offsets[b.rows[mine]]
                order = np.lexsort((places, docs, hashes[mine]))
                k, d, p = hashes[mine][order], docs[order], places[order]
                head = np.concatenate([[True], k[1:] != k[:-1]])
                group = np.cumsum(head) - 1
                first_d, first_p = d[head][group], p[head][group]
                gone[mine[order]] = (d != first_d) | (p != first_p)
            edges = np.zeros(len(b.ids) + 1, np.int64)
            np.add.at(edges, b.starts[gone], 1)
            np.add.at(edges, b.starts[gone] + words, -1)
            kept = np.cumsum(edges[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(kept)])[b.offsets]
            lists = pa.LargeListArray.from_arrays(pa.array(total), b.vocabulary.cast(pa.large_string()).take(pa.array(b.ids[kept])))
            n = np.diff(b.offsets)
            yield pa.record_batch([
                pa.array(b.doc_ids, pa.int64()), pa.array(n), pa.array(n - np.diff(total)), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "text"])

    return run


def without_repeats(docs: DataFrame, words: int = 20) -> DataFrame:
    """Documents (doc_id, text) without each word that lies in a window of `words` words that starts earlier, too: in a
    document of a smaller doc_id, or further up in the same one.  Windows are judged on the input.

    Returns one row per row: doc_id, n_words, n_removed, text (what is left, words joined by one space).  Words are runs
    without ASCII white space.  A null text has no words; texts shorter than a window keep all.  A null doc_id comes after
    every number.  Rows of one doc_id are the same document: of equal windows at equal places none is earlier.  Other
    columns are ignored; an empty table gives an empty result.

    Levels: of a window's sub-windows of a quarter (then half) its length, the one with the smallest hash stands for it;
    where that occurs once in the corpus, the window is unique and is dropped; survivors go on to twice the length.  So
    the first exchange carries about one key in eight words, later ones only what repeats.  A block of documents sends
    each key once, however often it has it, so a very common passage is as many rows as there are blocks.  Keys are 64-bit.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = new_path(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, BLOCK)
    STAGED.append(path)
    # dealt once by block, so that no level moves the documents again
    made.repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    same = W.partitionBy("key")
    last, answers = len(lengths(words)) - 1, None
    for level in range(last + 1):
        ready = blocks if answers is None else blocks.join(answers.hint("merge"), "block")
        found = ready.mapInArrow(_pairs(words, level), PAIRS)
        if level < last:
            again = found.select("key", "block", "n").withColumn("total", F.sum("n").over(same)).where("total > 1")
            answers = again.groupBy("block").agg(F.collect_list("key").alias("keys"))
    placed = found.select("key", "block", "n", F.struct("doc", "start").alias("at"))
    placed = placed.withColumns({"total": F.sum("n").over(same), "first": F.min("at").over(same)}).where("total > 1")
    first = F.col("at") == F.col("first")
    verdict = placed.groupBy("block").agg(F.collect_list(F.when(first, F.col("key"))).alias("here"), F.collect_list(F.when(~first, F.col("key"))).alias("later"))
    return blocks.join(verdict.hint("merge"), "block", "left").mapInArrow(_remove(words), "doc_id long, n_words long, n_removed long, text string")
