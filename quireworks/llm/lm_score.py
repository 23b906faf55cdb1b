"""Cross-entropy difference: how much better a target bigram model predicts a document than a background model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import join_sized, mix64, prepare, stage, text_column, word_hashes

#: Texts are dealt in blocks of so many bytes; a block sends each of its grams once
BLOCK_BYTES = 8 << 20
#: Parts of the count table for words, contexts and pairs; doubled for every further PART_BYTES of texts
PARTS = (256, 256, 1024)
PART_BYTES = 32 << 30
PAIR_WEIGHT = 8.0
WORD_WEIGHT = 0.1


def _grams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its own 64-bit key, that of the word before it (or of the text's start), and that of the pair."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = np.uint64(1)
    return mix64(words ^ np.uint64(0x51)), mix64(before ^ np.uint64(0xC7)), mix64(before * np.uint64(0xA0761D6478BD642F) + words)


BLOCK = "block long, size long, docs binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed row per BLOCK_BYTES of a task's texts."""
    block, size, held = TaskContext.get().partitionId() << 32, 0, []

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for some in held:
                writer.write_batch(some)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "docs"])

    for batch in batches:
        texts = text_column(batch)
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), texts], ["doc_id", "target", "text"])
        while len(batch):
            n = max(int(np.searchsorted(np.cumsum(sizes), BLOCK_BYTES - size, "right")), 0 if held else 1)
            if n:
                held.append(batch.slice(0, n))
                size += int(sizes[:n].sum())
                batch, sizes = batch.slice(n), sizes[n:]
            if len(batch):
                yield out()
                block, size, held = block + 1, 0, []
    if held:
        yield out()


class Block:
    """A block's texts as words, and the sorted distinct keys of each kind of gram."""

    def __init__(self, docs: bytes):
        batches = list(pa.ipc.open_stream(docs))
        self.ids = pa.concat_arrays([b.column("doc_id") for b in batches])
        self.target = np.concatenate([b.column("target").to_numpy(zero_copy_only=False).astype(bool) for b in batches])
        found = [word_hashes(text_column(b)) for b in batches]
        words, self.lengths = np.concatenate([w for w, _ in found]), np.concatenate([np.diff(o) for _, o in found])
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.keys, self.at = [], []
        for gram in _grams(words, np.concatenate([[0], np.cumsum(self.lengths)])):
            keys, at = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)

    def parts(self, scale: int) -> Iterator[tuple[int, int, int, int]]:
        """kind, part and range of the keys that each part of the count table holds."""
        first = 0
        for kind, (keys, parts) in enumerate(zip(self.keys, PARTS, strict=True)):
            parts *= scale
            part = (keys >> np.uint64(65 - parts.bit_length())).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            yield from ((kind, first + p, cuts[p], cuts[p + 1]) for p in range(parts) if cuts[p] < cuts[p + 1])
            first += parts


def _packed(flags: np.ndarray, *columns: np.ndarray) -> bytes:
    """Flags and 64-bit columns, each column byte by byte, so that leading zeros take no room."""
    return pa.compress(flags.tobytes() + b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, m: int, columns: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(pa.decompress(data, n + 8 * m * columns, "zstd", asbytes=True), np.uint8)
    wide = (np.ascontiguousarray(raw[n + 8 * m * k : n + 8 * m * (k + 1)].reshape(8, m).T).view(np.uint64).ravel() for k in range(columns))
    return raw[:n].astype(bool), *wide


SENT = "part int, block long, n long, data binary"


def _send(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Per block and part of the count table: the block's distinct grams, their counts, and whether several of its texts have them."""
    for batch in batches:
        for number, docs in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            block = Block(docs)
            columns = []
            for keys, at in zip(block.keys, block.at, strict=True):
                low, high = np.full(len(keys), len(block.target)), np.full(len(keys), -1)
                # owners ascend, so what is written last is the largest and, backwards, the smallest
                high[at], low[at[::-1]] = block.owner, block.owner[::-1]
                mine = np.bincount(at[block.target[block.owner]], minlength=len(keys))
                columns.append((low != high, keys, np.bincount(at, minlength=len(keys)).astype(np.uint64), mine.astype(np.uint64)))
            rows = []
            for kind, part, lo, hi in block.parts(scale):
                several, keys, n_all, n_target = (c[lo:hi] for c in columns[kind])
                rows.append((part, number, hi - lo, _packed(several, np.diff(keys, prepend=np.uint64(0)), n_all, n_target)))
            for lo in range(0, len(rows), 400):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 400], strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["part", "block", "n", "data"],
                )


ANSWER = "block long, part int, n long, m long, data binary, words long, total_all long, total_target long"
_ANSWER = dict(zip("block part n m data words total_all total_target".split(), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3], strict=True))


def _answer(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """For each block and part: which of the grams it sent two texts or more have, and their counts over the whole corpus.

    The counts of a gram that one text has are that text's own, which its score leaves out: it is the same as unseen.
    The first row of a part of words has their number and the sums of their counts.
    """

    def out(part: int, rows: list) -> Iterator[pa.RecordBatch]:
        several, deltas, n_all, n_target = zip(*[_unpacked(data, n, n, 3) for _, n, data in rows], strict=True)
        keys, inverse, seen = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d in deltas]), return_inverse=True, return_counts=True)
        every, mine = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        np.add.at(every, inverse, np.concatenate(n_all))
        np.add.at(mine, inverse, np.concatenate(n_target))
        shared = seen > 1
        shared[inverse[np.concatenate(several)]] = True
        totals = (len(keys), int(every.sum()), int(mine.sum())) if part < PARTS[0] * scale else (0, 0, 0)
        at, made = 0, []
        for block, n, _ in rows:
            own = inverse[at : at + n]
            at += n
            has = shared[own]
            own = own[has]
            made.append((block, part, n, len(own), _packed(has, every[own], mine[own]), *totals))
            totals = (0, 0, 0)
            if len(made) >= 400 or at == len(inverse):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _ANSWER.values(), strict=True)], list(_ANSWER))
                made = []

    part, rows = None, []
    for batch in batches:
        for p, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and p != part:
                yield from out(part, rows)
                rows = []
            part = p
            rows.append(row)
    if rows:
        yield from out(part, rows)


class Models:
    """Target and background counts over the whole corpus of a block's grams; zero for those only one text has."""

    def __init__(self, block: Block, answers: pa.Table, scale: int, vocabulary: float, totals: tuple[float, float]):
        self.block, self.vocabulary, self.totals = block, vocabulary, totals
        self.counts = [(np.zeros(len(k)), np.zeros(len(k))) for k in block.keys]
        where = {part: (kind, lo, hi) for kind, part, lo, hi in block.parts(scale)}
        for part, n, m, data in zip(*[answers.column(c).to_pylist() for c in ("part", "n", "m", "data")], strict=True):
            kind, lo, hi = where.pop(part)
            has, n_all, n_target = _unpacked(data, n, m, 2)
            target, background = self.counts[kind]
            target[lo:hi][has], background[lo:hi][has] = n_target, n_all - n_target
        if where:
            raise ValueError(f"no counts for {len(where)} parts of a block")

    def losses(self) -> tuple[np.ndarray, np.ndarray]:
        """Summed loss of each text under the target and the background model, its own counts left out of the one it trained."""
        owner, lengths = self.block.owner, self.block.lengths
        own = []
        for keys, at in zip(self.block.keys, self.block.at, strict=True):
            _, inverse, count = np.unique(owner * len(keys) + at, return_inverse=True, return_counts=True)
            own.append(count[inverse].astype(np.float64))
        out = []
        for model, total in enumerate(self.totals):
            trained = (~self.block.target if model else self.block.target)[owner]
            c_word, c_context, c_pair = (np.maximum(self.counts[k][model][self.block.at[k]] - own[k] * trained, 0) for k in range(3))
            base = (c_word + WORD_WEIGHT) / (np.maximum(total - lengths[owner] * trained, 0) + WORD_WEIGHT * self.vocabulary)
            p = (c_pair + PAIR_WEIGHT * base) / (np.maximum(c_context, c_pair) + PAIR_WEIGHT)
            out.append(np.bincount(owner, -np.log2(p), len(lengths)))
        return out[0], out[1]


SCORE = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score(docs: bytes, answers: pa.Table, scale: int, vocabulary: float, totals: tuple[float, float]) -> pa.Table:
    block = Block(docs)
    loss_t, loss_b = Models(block, answers, scale, vocabulary, totals).losses()
    per = np.maximum(block.lengths, 1)
    return pa.table(
        [block.ids, pa.array(block.lengths, pa.int64()), pa.array(loss_t / per), pa.array(loss_b / per), pa.array((loss_t - loss_b) / per)],
        ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
    )


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Score each document by the difference of its per-word losses under a target and a background bigram model.

    target_ids (doc_id) names the documents the target model is trained on; all others train the background model.  Both
    models have the same order, smoothing and vocabulary.  Returns doc_id, n_tokens, target_loss, background_loss and
    score (bits per word; lower means closer to the target).  A document's own counts are left out of the model it
    trained, so membership in the target does not lower its score.  Words are maximal runs without white space, in lower
    case.  A null or empty text has no word and scores 0.  Null ids score as background; repeated rows are scored each;
    extra columns are ignored; an empty table gives an empty result.

    Counts cover every word of every document, each word, context and pair under its own 64-bit hash.  The count table is
    dealt over parts by hash and grows with the corpus; blocks of texts send it each of their grams once, so the most
    common gram makes one entry a block, and get back the counts of those that two texts or more have.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = join_sized(texts, ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks, _ = stage(marked.mapInArrow(_blocks, BLOCK), "lm-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    scale = 1 << (size // PART_BYTES).bit_length()
    sent = blocks.select("block", "docs").mapInArrow(lambda it: _send(it, scale), SENT)
    answers, _ = stage(sent.repartition("part").sortWithinPartitions("part").select("part", "block", "n", "data").mapInArrow(lambda it: _answer(it, scale), ANSWER), "lm-counts")
    words, total_all, total_target = (x or 0 for x in answers.agg(F.sum("words"), F.sum("total_all"), F.sum("total_target")).first())
    vocabulary, totals = float(words + 1), (float(total_target), float(total_all - total_target))
    theirs = answers.select("block", "part", "n", "m", "data").groupBy("block")
    return blocks.select("block", "docs").groupBy("block").cogroup(theirs).applyInArrow(
        lambda d, a: _score(d.column("docs")[0].as_py(), a, scale, vocabulary, totals), SCORE
    )
