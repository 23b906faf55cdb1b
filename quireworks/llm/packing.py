"""Sequence packing along a Hilbert curve through projected document vectors."""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import prepare, stage, text_column

LENGTH = 2048
DIMS, BITS = 4, 8
END = 1
#: Words that a worker's table of known words keeps
CACHED = 1_000_000
#: Stands between words that are encoded together; words that hold it are encoded alone
MARK = "|"
#: Signs in a tokenizer's file that it lowers its input, and takes letters, digits and other signs apart (fixed values)
LOWERED = '{"type": "Lowercase"}'
PARTED = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: ASCII punctuation after a letter or digit, up to the end of the word
PUNCTUATED = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])[!-/:-@\[-`{-~]+$"
#: Ids of one row between tokens and packing: rows of like size let a range sort by rows balance ids
CHUNK = 1024
#: Tokens that one range partition should hold
PER_PARTITION = 4_000_000


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of integer points (n, dims), each coordinate below 2**bits, along the Hilbert curve."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... of n[i] places, end to end."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class WordTokenizer:
    """Token ids of texts through a table of known words: ids of a text are those of its words one after another.

    Holds for tokenizers that never merge across ASCII white space and drop it.  Where the tokenizer's file says that it
    lowers its input and parts letters from punctuation, words are looked up in lower case and without the punctuation at
    their end, which is a word of its own; words that could hold a special token are left as they are.  The table keeps
    the words used last, in columns of bounded size, and lives as long as the Python worker.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint32 if self.tokenizer.get_vocab_size() > 1 << 16 else np.uint16)
        self.parts_words = LOWERED in json.dumps(spec.get("normalizer")) and PARTED in json.dumps(spec.get("pre_tokenizer"))
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words = pa.array([], pa.string())
        self.first, self.size, self.used, self.pool, self.turn = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, self.kind), 0

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        held = sys.modules[__name__].__dict__.setdefault("_TOKENIZERS", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each word): many words to a call, a mark that none of them holds between two."""
        plain = ~pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
        if self.mark is None:
            plain[:] = False
        listed, at = words.filter(pa.array(plain)).to_pylist(), np.nonzero(plain)[0]
        size, ids = np.zeros(len(words), np.int64), [np.zeros(0, self.kind)] * len(words) if not plain.all() else []
        pieces = []
        for lo in range(0, len(listed), 8192):
            texts = [f" {MARK} ".join(listed[k : min(k + 512, lo + 8192)]) + f" {MARK}" for k in range(lo, min(lo + 8192, len(listed)), 512)]
            pieces += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        whole = np.concatenate([np.zeros(0, self.kind), *pieces])
        ends = np.nonzero(whole == self.mark)[0] if self.mark is not None else np.zeros(0, np.int64)
        size[at] = np.diff(ends, prepend=-1) - 1
        if plain.all():
            return whole[whole != self.mark], size
        for i, part in zip(at, np.split(whole, ends + 1)[:-1], strict=True):
            ids[i] = part[:-1]
        rest = np.nonzero(~plain)[0]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, self.kind)
            size[i] = len(ids[i])
        return np.concatenate([np.zeros(0, self.kind), *ids]), size

    def _known(self, words: pa.StringArray) -> np.ndarray:
        """Places of the words in the table, which takes up those it did not hold."""
        self.turn += 1
        if len(self.words) > CACHED:
            # the words used last stay, and so do the ids they have
            keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHED // 2])
            self.pool = self.pool[_runs(self.first[keep], self.size[keep])]
            self.words, self.size, self.used = self.words.take(pa.array(keep)), self.size[keep], self.used[keep]
            self.first = np.cumsum(self.size) - self.size
        place = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(place).to_numpy(zero_copy_only=False)
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        if missing.any():
            new = words.filter(pa.array(missing))
            ids, size = self._encode(new)
            place[missing] = len(self.words) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.full(len(new), self.turn)])
            self.pool = np.concatenate([self.pool, ids])
            self.words = pa.concat_arrays([self.words, new])
        self.used[place] = self.turn
        return place

    def _parted(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Distinct words to look up, and for each given word the places of itself and of its end among them (-1: none)."""
        safe = pc.invert(pc.match_substring(words, "<|"))
        lowered = pc.if_else(pc.and_(safe, pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        core = pc.if_else(safe, pc.replace_substring_regex(lowered, PUNCTUATED, r"\1"), lowered)
        cut = pc.binary_length(core).to_numpy().astype(np.int64)
        ended = np.nonzero(cut < pc.binary_length(lowered).to_numpy())[0]
        ends = pa.array([w[n:].decode() for w, n in zip(lowered.take(pa.array(ended)).cast(pa.binary()).to_pylist(), cut[ended].tolist(), strict=True)], pa.string())
        coded = pa.concat_arrays([core, ends]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        tail = np.full(len(words), -1, np.int64)
        tail[ended] = codes[len(words) :]
        return coded.dictionary, codes[: len(words)], tail

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets of the texts)"""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if self.parts_words and len(words):
            distinct, core, tail = self._parted(words)
        else:
            distinct, core, tail = words, np.arange(len(words)), np.full(len(words), -1, np.int64)
        place = self._known(distinct)
        first, size = self.first[place], self.size[place]
        # each distinct word of these texts with the ids of its end behind its own
        n_core, n_tail = size[core], np.where(tail >= 0, size[tail], 0)
        both_first = np.stack([first[core], first[tail]], 1).ravel() if len(words) else np.zeros(0, np.int64)
        pool = self.pool[_runs(both_first, np.stack([n_core, n_tail], 1).ravel())]
        n_word = n_core + n_tail
        at_word = np.cumsum(n_word) - n_word
        codes = coded.indices.to_numpy()
        n = n_word[codes]
        at = lists.offsets.to_numpy().astype(np.int64)
        return pool[_runs(at_word[codes], n)], np.concatenate([[0], np.cumsum(n)])[at - at[0]]


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many bytes of text: fewer words then recur from batch to batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _projection(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((vocabulary, DIMS)).astype(np.float32)


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer.get(path)
    table = _projection(1 << 12)
    for batch in _gathered(batches):
        ids, offsets = tokenizer(text_column(batch))
        n = len(offsets) - 1
        hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
        lengths = np.diff(offsets)
        owner = np.repeat(np.arange(n), lengths)
        vector = np.stack([np.bincount(owner, table[hashed, d], n) for d in range(DIMS)], 1)
        vector /= np.sqrt(np.maximum(lengths, 1))[:, None]
        # a rank-like squashing, so that cells of the curve fill evenly whatever the spread of the vectors
        cells = np.clip((0.5 + np.arctan(vector) / np.pi) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(bounds[-1], end, ids.dtype)
        out[np.arange(len(ids)) + owner] = ids
        size, totals = out.dtype.itemsize, lengths + 1
        parts = -(-totals // CHUNK)
        row = np.repeat(np.arange(n), parts)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
        cuts = np.concatenate([bounds[row] + start, bounds[-1:]])
        data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(out.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(row)), pa.array(start), pa.array(hilbert_key(cells, BITS)[row]), pa.array(np.diff(cuts)),
                pa.array(totals[row]), pa.array(np.full(len(row), size, np.int32)), data,
            ],
            ["doc_id", "start", "curve_key", "n_tokens", "doc_tokens", "width", "ids"],
        )


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def _packed(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents in curve order, end to end, cut every `length` ids; the rest is cut into powers of two."""
    base, number = TaskContext.get().partitionId() << 36, 0
    open_rows: list[list] = []  # pieces of the sequence that is being filled
    filled = 0

    def emit(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        ids = [np.asarray(c, "<u4").tobytes() for c in columns[3]]
        columns[3] = [zlib.crc32(c) for c in ids]
        columns.append(ids if with_ids else [None] * len(ids))
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], names)

    for batch in batches:
        done: list[list] = []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "width", "ids")]
        for doc_id, begin, total, width, raw in zip(*columns, strict=True):
            ids = np.frombuffer(raw, np.uint32 if width == 4 else np.uint16)
            start = 0
            while start < len(ids):
                n = min(length - filled, len(ids) - start)
                last = open_rows[-1] if open_rows else None
                if last and last[0] == doc_id and last[1] + last[2] == begin + start and last[4] == total:
                    # the row goes on where the piece before it ends
                    last[2], last[3] = last[2] + n, np.concatenate([last[3], ids[start : start + n]])
                else:
                    open_rows.append([doc_id, begin + start, n, ids[start : start + n], total, base + number, filled, length])
                filled, start = filled + n, start + n
                if filled == length:
                    done.extend(open_rows)
                    open_rows, filled, number = [], 0, number + 1
        if done:
            yield emit(done)
    tail: list[list] = []
    room = at = 0
    left = filled
    for doc_id, start, n, ids, total, *_ in open_rows:
        used = 0
        while used < n:
            if at == room:
                room, at = 1 << (left.bit_length() - 1), 0
                left -= room
                number += 1
            take = min(room - at, n - used)
            tail.append([doc_id, start + used, take, ids[used : used + take], total, base + number, at, room])
            used, at = used + take, at + take
    if tail:
        yield emit(tail)


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, with_ids: bool = True, per_partition: int = PER_PARTITION
) -> DataFrame:
    """Pack whole documents into sequences of `length` ids, neighbours in topic next to each other.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and, if
    with_ids, the ids (little-endian unsigned 32-bit).  Each document is its text's ids and then `end`; a null or empty
    text is `end` alone.  Token counts, hashed and projected to a few dimensions, give a place on a Hilbert curve;
    documents are sorted by it over range partitions (ties by id, so copies never pile up in one partition) and laid end
    to end, long ones in several rows, so that no row and no partition grows with a text.  What is left at a partition's end is cut into sequences of a power of two, so there is no padding.
    Repeated rows and null ids are packed as they are; extra columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokens, _ = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            lambda it: _tokenised(it, tokenizer_path, end), "doc_id long, start long, curve_key long, n_tokens long, doc_tokens long, width int, ids binary"
        ),
        "tokens",
    )
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    partitions = max(1, -(-total // per_partition))
    ordered = tokens.repartitionByRange(partitions, "curve_key", "doc_id", "start").sortWithinPartitions("curve_key", "doc_id", "doc_tokens", "start", "ids")
    return ordered.select("doc_id", "start", "doc_tokens", "width", "ids").mapInArrow(lambda it: _packed(it, length, with_ids), PIECES)
