"""Exact deduplication against a persistent digest index (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import discard, free_name, new_path, stage
from quireworks.sources.manifests import Manifests


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """SHA-256 digests seen so far with the id that stays, in tables bucketed and sorted by digest.

    The index lives at `path` (a folder all executors see) and outlives the session: opening the same path again, in any
    session, finds the digests of earlier batches.  It consists of segments, one sorted file a bucket, which a manifest
    names; `add` joins a batch's digests to each of them by sort-merge anti-join, without a shuffle or a sort of the index,
    and appends the new ones as a segment.  A segment is merged with the one before it while that is not FAN times as
    large, so there are as many segments as the logarithm of the index, and a small batch rewrites no large one.  The
    number of buckets is given when the index is made (the session's shuffle partitions where none is) and doubles
    when a bucket holds more than `per_bucket` digests on average; asking for another first number later is an error.
    The manifest is replaced last: a batch that fails leaves the index as it was.  One writer at a time.
    """

    FAN = 4

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, per_bucket: int = 4_000_000):
        self.spark, self.path, self.per_bucket = spark, path, per_bucket
        self.manifests = Manifests(spark, f"{path}/_manifests")
        self.number, state = self.manifests.read()
        if state and buckets and state["made_with"] != buckets:
            raise ValueError(f"the index at {path} was made with {state['made_with']} buckets, not {buckets}")
        if not state:
            made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            state = {"made_with": made, "buckets": made, "segments": []}
            self.number = self.manifests.commit(self.number, state)
        self.made_with, self.buckets, self.segments = state["made_with"], state["buckets"], state["segments"]
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """Within this, plans read tables by their buckets, and know that a bucket of one file is sorted."""
        keys = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
        before = {key: self.spark.conf.get(key) for key in keys}
        try:
            for key, value in keys.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)

    def _write(self, rows: DataFrame, name: str, at: str) -> DataFrame:
        """rows, dealt by digest over as many partitions as there are buckets, as a table of one sorted file a bucket."""
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "digest").sortBy("digest").option("path", at).saveAsTable(name)
        return self.spark.table(name)

    def _append(self, rows: DataFrame) -> dict:
        part = uuid.uuid4().hex
        n = self._write(rows, f"{self.table}_{part}", f"{self.path}/{part}").count()
        return {"part": part, "rows": n}

    def _open(self, segment: dict) -> DataFrame:
        name = f"{self.table}_{segment['part']}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{segment['part']}'"
        )
        return self.spark.table(name)

    def _remove(self, *segments: dict) -> None:
        for segment in segments:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}_{segment['part']}")
            discard(self.spark, f"{self.path}/{segment['part']}")

    def _merged(self, older: dict, newer: dict) -> dict:
        """Two segments as one, bucket by bucket; no digest is in both."""
        both = self._open(older).hint("merge").join(self._open(newer).withColumnRenamed("keep_id", "new_id"), "digest", "full_outer")
        return self._append(both.select("digest", F.coalesce("keep_id", "new_id").alias("keep_id")))

    def digests(self) -> DataFrame:
        parts = [self._open(s) for s in self.segments] or [self.spark.createDataFrame([], "digest binary, keep_id long")]
        return reduce(DataFrame.union, parts)

    def drop(self) -> None:
        """Delete the index with its files."""
        self._remove(*self.segments)
        discard(self.spark, self.path)

    def _settle(self, segments: list[dict]) -> None:
        """Merge the newest segments while they are alike in size, double the buckets if they are full, and commit."""
        segments, old = list(segments), []
        while len(segments) > 1 and segments[-2]["rows"] < self.FAN * segments[-1]["rows"]:
            pair = segments[-2:]
            segments[-2:] = [self._merged(*pair)]
            old += pair
        if sum(s["rows"] for s in segments) > self.per_bucket * self.buckets:
            whole = reduce(DataFrame.union, [self._open(s) for s in segments])
            old += segments
            self.buckets *= 2
            segments = [self._append(whole.repartition(self.buckets, "digest"))]
        self.number = self.manifests.commit(self.number, {"made_with": self.made_with, "buckets": self.buckets, "segments": segments})
        self.segments = segments
        self._remove(*old)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch: one row per (id, text) with keep_id, group_size, kept and text_sha256.

        Of equal texts the one already in the index stays, else the smallest id of the batch; group_size counts the
        batch's documents with that text.  Rows that repeat an id and a text are one document (n_rows counts them).  A
        null text is an empty one, and empty texts equal each other.  A null id sorts after every number and is kept
        only if it is alone.  Extra columns are ignored.  An empty batch gives an empty result.  A batch that is added
        again (as after a failed job) appends nothing and gets the same answer.
        """
        spark = self.spark
        seen = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")
        ).groupBy("digest", "doc_id").agg(F.count("*").alias("n_rows"))
        seen, seen_at = stage(seen, "digests")
        groups = seen.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        groups_at, groups_table = new_path(spark, "digest-groups"), f"{self.table}_groups_{uuid.uuid4().hex}"
        with self.in_order():
            groups = self._write(groups.repartition(self.buckets, "digest"), groups_table, groups_at)
            known = [self._open(s) for s in self.segments]
            fresh = groups.select("digest", "keep_id")
            for segment in known:
                fresh = fresh.join(segment.select("digest").hint("merge"), "digest", "left_anti")
            added = self._append(fresh)
            sizes = groups.select("digest", "group_size")
            settled = reduce(DataFrame.union, [sizes.join(segment.hint("merge"), "digest") for segment in [*known, self._open(added)]])
            settled, settled_at = stage(settled, "digest-settled")
            if added["rows"]:
                self._settle([*self.segments, added])
            else:
                self._remove(added)
        # both sides are plain exchanges here, so that a digest with very many copies can be split
        out = seen.join(settled, "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), "n_rows",
        )
        out, _ = stage(out, "digest-answer")
        spark.sql(f"DROP TABLE IF EXISTS {groups_table}")
        discard(spark, seen_at, groups_at, settled_at)
        return out


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Deduplicate `docs` (doc_id, text) against the index at index_path; where none is given, among themselves, by an
    index that is deleted again.  Nulls, repeated rows and empty tables: see DigestIndex.add."""
    spark = docs.sparkSession
    if index_path:
        return DigestIndex(spark, index_path, buckets).add(docs)
    index = DigestIndex(spark, new_path(spark, "digest-index"), buckets)
    out = index.add(docs)
    index.drop()
    return out


def drop_copies(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows that repeat an id and a text, one
    stays.  Nulls and empty tables: see DigestIndex.add."""
    keep = exact_dedup(docs, index_path).where("kept").select("doc_id", "text_sha256", "n_rows")
    sha = free_name(docs, "sha")
    mine = docs.withColumn(sha, F.sha2(normalised(docs["text"]), 256))
    same_id, same_text = free_name(mine, "kept_id"), free_name(mine, "kept_sha")
    side = keep.select(F.col("doc_id").alias(same_id), F.col("text_sha256").alias(same_text))
    out = mine.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(same_id)) & (F.col(sha) == F.col(same_text)), "left_semi")
    if not keep.where("n_rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", sha])
    return out.drop(sha)
