"""Periodic runs of words: squares from a suffix automaton whose paths are recoloured, extended to maximal runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import ascii_words, mix64, prepare, text_column

RUN = "struct<start:long,length:long,period:long>"


def automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of seq: for each state its suffix link and longest length, and the state of each prefix.
    States count from 1, the state of the empty word; link 0 is none."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, prefixes, last = [0, 0], [0, 0], [], 1
    for c in seq:
        state, p = len(link), last
        moves.append({})
        link.append(1)
        length.append(length[last] + 1)
        while p and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(link)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
        prefixes.append(state)
    return link, length, prefixes


def squares(seq: list[int]) -> dict[tuple[int, int], int]:
    """Of every maximal stretch with a period of at most half its length: (start, smallest period) to its end (exclusive).

    The suffix links form a tree, kept as link-cut splay trees: one for each path of states whose words last ended at the
    same place, the place noted at the splay tree's root.  Appending a word accesses its prefix's state: each path segment
    met on the way to the root names the previous end of a suffix, and its longest length.  If that end is no further
    back than the length, the two occurrences make a square that reaches as far left as its period holds; the path is
    then recoloured with the new end.  A run shows itself at each of its ends from two periods on, so the last end seen
    for a start and period is the run's.
    """
    up, length, prefixes = automaton(seq)
    n = len(up)
    left, right, colour = [0] * n, [0] * n, [0] * n
    found: dict[tuple[int, int], int] = {}

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    for end, state in enumerate(prefixes, 1):
        below, x = 0, state
        while x:
            while True:  # splay x to the root of its path
                p = up[x]
                if not p or (left[p] != x and right[p] != x):
                    break
                g = up[p]
                if not g or (left[g] != p and right[g] != p):
                    rotate(x, p)
                    colour[x] = colour[p]
                    break
                h = up[g]
                top = not h or (left[h] != g and right[h] != g)
                if (left[p] == x) == (left[g] == p):
                    rotate(p, g)
                    rotate(x, p)
                else:
                    rotate(x, p)
                    rotate(x, g)
                if top:
                    colour[x] = colour[g]
                    break
            before = colour[x]
            if right[x]:
                colour[right[x]] = before
            if before and end - before <= length[x]:
                period = end - before
                found[end - length[x] - period, period] = end
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
    return found


def _stretches(ids: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs can be: (starts, ends) of stretches of words, no run reaching over the end of one.

    A run of n words and period q is n - q words that occur again q words on, so each of its words lies in a sequence of
    `gram` words that occurs again one period away, where gram is the least n - q of any run; and a period is at most a
    `times`-th of any stretch that holds the run.  So words in no such sequence cut the texts; in what lies between, the
    condition is asked again until no more words fall out.  Ids are exact, only sequences are compared by hash, which can
    keep a word too many but never lose one.
    """
    gram = min(max(least, times * q) - q for q in range(1, least + 1))
    at = np.arange(len(ids))
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ids = ids.astype(np.uint64)
    while len(at):
        n = len(at)
        sizes = np.bincount(piece)
        if n < gram:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(key)] + np.uint64(1))
        key = mix64(key + piece[: len(key)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        whole = np.nonzero(piece[: len(key)] == piece[gram - 1 :])[0]
        order = whole[np.argsort(key[whole], kind="stable")]
        near = (key[order[1:]] == key[order[:-1]]) & (piece[order[1:]] == piece[order[:-1]])
        near &= (at[order[1:]] - at[order[:-1]]) * times <= sizes[piece[order[1:]]]
        edges = np.zeros(n + 1, np.int64)
        hit = np.zeros(n, bool)
        hit[order[1:][near]] = hit[order[:-1][near]] = True
        starts = np.nonzero(hit)[0]
        edges[starts] += 1
        edges[starts + gram] -= 1
        stays = np.cumsum(edges[:-1]) > 0
        kept, old = at[stays], piece[stays]
        new = np.concatenate([[True], (np.diff(kept) > 1) | (old[1:] != old[:-1])]) if len(kept) else np.zeros(0, bool)
        parts = np.cumsum(new) - 1
        long = np.bincount(parts)[parts] >= least if len(kept) else np.zeros(0, bool)
        done = long.sum() == n
        ids, at, piece = ids[stays][long], kept[long], np.unique(parts[long], return_inverse=True)[1]
        if done:
            break
    heads = np.nonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))[0] if len(at) else np.zeros(0, np.int64)
    return at[heads], (at[np.append(heads[1:], len(at)) - 1] + 1) if len(at) else heads


def _find(least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = ascii_words(text_column(batch))
            coded = pc.dictionary_encode(words)
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs: dict[int, list[tuple[int, int, int]]] = {}
            edges = np.zeros(len(ids) + 1, np.int64)
            for lo, hi in zip(*(a.tolist() for a in _stretches(ids, offsets, least, times)), strict=True):
                row = int(np.searchsorted(offsets, lo, "right")) - 1
                for (start, period), end in squares(ids[lo:hi].tolist()).items():
                    if end - start >= max(least, times * period):
                        runs.setdefault(row, []).append((lo + start - int(offsets[row]), end - start, period))
                        edges[lo + start + period] += 1
                        edges[lo + end] -= 1
            kept = np.cumsum(edges[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(kept)])[offsets]
            lists = pa.LargeListArray.from_arrays(pa.array(total), words.cast(pa.large_string()).filter(pa.array(kept)))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in sorted(runs.get(i, []), key=lambda r: (r[0], r[2]))] for i in range(batch.num_rows)], shape)
            yield pa.record_batch([
                batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)), listed,
                pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            ], ["doc_id", "n_words", "runs", "text"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """The periodic runs in each row of docs (doc_id, text), and the text without their repeats.

    A run is a stretch of words of smallest period q, of at least `least` words (two or more) and `times` (two or more)
    periods, that no neighbouring word extends with that period.  Words are runs without ASCII white space, numbered from
    0.  Returns one row per row: doc_id, n_words, runs (start, length, period; by start, then period) and text: the words
    that no run contains after its first period, joined by one space.  A null text has no words; repeated rows are rows of
    their own, doc_id may be null; other columns are ignored; an empty table gives an empty result.

    Each row is read where it lies: nothing is shuffled.  The automaton sees the stretches that can hold a run
    (_stretches); its memory follows the longest of them.
    """
    if least < 2 or times < 2:
        raise ValueError("runs have at least two words and two periods")
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(least, times), f"doc_id long, n_words long, runs array<{RUN}>, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period (compared in whole numbers), of equal ones the first; null where there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """A document's text; for one document in ten, by its id, with its words from some place on repeated periodically."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)
