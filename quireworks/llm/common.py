"""Helpers the operators share: staged tables in the shared folder, Arrow batches, word hashes and size-checked joins."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.session import STAGED, discard, discard_since, shared_dir, stage  # noqa: F401
from quireworks.session import shared_path as new_path  # noqa: F401

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package; where the session does not say how large Arrow batches may be, keep them
    small enough for very long texts (one setting for all operators, made once)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_HOME, *[p for p in paths if p]])
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def join_sized(df: DataFrame, other: DataFrame, on: str | list[str], how: str, bound: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Join; broadcasts `other` only if a count shows at most `bound` rows and most_bytes, else both sides are shuffled."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in other.schema]
    size = other.limit(bound + 1).agg(F.count("*").alias("n"), F.sum(sum(wide, F.lit(8))).alias("bytes")).first()
    if size["n"] <= bound and (size["bytes"] or 0) <= most_bytes:
        return df.join(F.broadcast(other), on, how)
    return df.join(other.hint("merge"), on, how)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def string_hashes(strings: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each string's UTF-8 bytes, from one pass over the column's buffer."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    buffers = strings.buffers()
    offsets = np.frombuffer(buffers[1], kind)[strings.offset : strings.offset + n + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    ends = offsets - lo
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    starts = ends[:-1]
    return mix64((sums[ends[1:]] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends[1:] - starts).astype(np.uint64))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.StringArray:
    """A batch's text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.string()), "")


def split_words(texts: pa.StringArray, lower: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """Words (maximal runs without white space) of all texts end to end, and each text's offsets in them."""
    return _flat(pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts))


def _flat(lists: pa.ListArray) -> tuple[pa.StringArray, np.ndarray]:
    values = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0)
    if not pc.all(full, min_count=0).as_py():
        mask = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        values = values.filter(full)
    return values, offsets


def ascii_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words (maximal runs without ASCII white space: blank, tab to carriage return), unchanged, of all texts end to end,
    and each text's offsets in them."""
    return _flat(pc.ascii_split_whitespace(texts))


def word_hashes(texts: pa.StringArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = split_words(texts, lower)
    return string_hashes(words), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words; a text of 1 to width-1 words has one shingle, its whole word run."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    total = len(words)
    rolled = np.zeros(total, np.uint64)
    salt, weight = 0xD6E8FEB86659FD93, 1
    for k in range(width):
        if total - k > 0:
            rolled[: total - k] += words[k:] * np.uint64(weight)
        weight = weight * salt % (1 << 64)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], counts) + np.repeat(offsets[:-1], counts)
    out = mix64(rolled[index])
    for i in np.nonzero((lengths > 0) & (lengths < width))[0]:
        h = int(lengths[i])
        for w in words[offsets[i] : offsets[i + 1]].tolist():
            h = (h * salt + w) % (1 << 64)
        out[out_offsets[i]] = mix64(np.array([h], np.uint64))[0]
    return out, out_offsets
