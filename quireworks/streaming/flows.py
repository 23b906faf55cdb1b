"""Event flows as batch operators: debounce, gates, presence, retries, undo windows.  Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.session import stage

SECOND = 1_000_000


def distinct_until_changed(changes: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*value)).over(w)
    return changes.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.struct(*value))).drop("__before")


def debounce_last(samples: DataFrame, gap: int, key: str = "document_id", value: str = "unit") -> DataFrame:
    """The last changed sample of each burst, once nothing changed for `gap`; an equal sample does not count."""
    changed = distinct_until_changed(samples, key, [value], ["ts", "event_id"])
    after = F.lead("ts").over(W.partitionBy(key).orderBy("ts", "event_id"))
    return changed.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") - F.col("ts") >= gap)).select(key, value, "ts")


def movement_gate(samples: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Nothing counts until a sample differs from the first one by its unit or by more than the tolerance; then all do."""
    w = W.partitionBy("document_id").orderBy("ts", "event_id")
    first = F.first(F.struct("unit", "fraction", "zoom")).over(w)
    rows = samples.withColumn("__f", first)
    moved = (F.col("unit") != F.col("__f.unit")) | (F.abs(F.col("fraction") - F.col("__f.fraction")) > tolerance) | (F.abs(F.col("zoom") - F.col("__f.zoom")) > tolerance)
    return rows.withColumn("__m", F.max(moved).over(w.rowsBetween(W.unboundedPreceding, 0))).where("__m").drop("__f", "__m")


def restore_gate(samples: DataFrame, markers: DataFrame) -> DataFrame:
    """S3: samples after their document's restore was applied."""
    done = markers.groupBy("document_id").agg(F.min("ts").alias("__restored"))
    return samples.join(done, "document_id").where("ts >= __restored").drop("__restored")


def combine_latest_gate(signals: DataFrame) -> DataFrame:
    """Open when enabled and neither reading nor on battery saver, over the latest values, changes only: ts, open.

    One order over all signals is needed, so the log is range-sorted and folded in two levels: within a range the values
    carried in are unknown; what each range leaves behind is carried over them first.  Ranges hold like numbers of rows,
    whatever the rate.  The sorted log is written once with each row's range, so all later steps see the same ranges.
    """
    names = ("enabled", "reading", "battery")
    rows, _ = stage(signals.repartitionByRange("ts", "event_id").withColumn("__slot", F.spark_partition_id()), "signals")
    ends = rows.groupBy("__slot").agg(*[F.max_by("on", F.when(F.col("signal") == n, F.struct("ts", "event_id"))).alias(n) for n in names])
    carry = W.orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    # one row per range
    carried = ends.select("__slot", *[F.last(n, ignorenulls=True).over(carry).alias(f"c_{n}") for n in names])
    within = W.partitionBy("__slot").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    latest = lambda n: F.coalesce(F.last(F.when(F.col("signal") == n, F.col("on")), ignorenulls=True).over(within), F.col(f"c_{n}"), F.lit(False))
    states = rows.join(F.broadcast(carried), "__slot").withColumn("open", latest("enabled") & ~latest("reading") & ~latest("battery"))
    last = states.groupBy("__slot").agg(F.max_by("open", F.struct("ts", "event_id")).alias("open"))
    previous = last.select("__slot", F.lag("open").over(W.orderBy("__slot")).alias("p_open"))
    before = F.coalesce(F.lag("open").over(W.partitionBy("__slot").orderBy("ts", "event_id")), F.col("p_open"))
    changes = states.join(F.broadcast(previous), "__slot").withColumn("__b", before)
    return changes.where(F.col("__b").isNull() | (F.col("__b") != F.col("open"))).select("ts", "open")


def presence_count(moves: DataFrame, key: str) -> DataFrame:
    """A counter of entries (+1) and exits (-1) that never goes below zero: key, ts, count."""
    w = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = moves.withColumn("__s", F.sum("step").over(w))
    return rows.select(key, "event_id", "ts", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).alias("count"))


def eager_arrivals(snapshots: DataFrame, max_bytes: int) -> DataFrame:
    """Small documents that are new at their size against the list before: snapshot_no, id, size_bytes."""
    small = snapshots.where(F.col("size_bytes") <= max_bytes).select("snapshot_no", "id", "size_bytes").distinct()
    before = small.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "id", "size_bytes")
    return small.join(before, ["snapshot_no", "id", "size_bytes"], "left_anti")


def settled_batches(arrivals: DataFrame, settle: int, key: str = "user_id") -> DataFrame:
    """Bursts: arrivals less than `settle` apart: key, burst_no, first_ts, last_ts, n."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    rows = arrivals.withColumn("__new", (F.col("ts") - F.lag("ts").over(w) >= settle).cast("int"))
    numbered = rows.withColumn("burst_no", F.coalesce(F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return numbered.groupBy(key, "burst_no").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def retry_deadlines(attempts: DataFrame, retry: int, key: str = "user_id") -> DataFrame:
    """Failed attempts, when each may be repeated, and whether it was in time: key, ts, eligible_at, retried."""
    after = F.lead("ts").over(W.partitionBy(key).orderBy("ts", "event_id"))
    return attempts.select(key, "event_id", (F.col("ts") + retry).alias("eligible_at"), F.coalesce(after >= F.col("ts") + retry, F.lit(False)).alias("retried"))


def undo_window(begins: DataFrame, undos: DataFrame, window: int) -> DataFrame:
    """When a removal commits: after the window, at once when the token's next one begins, never if undone in time."""
    b = begins.select("token", "ts", "event_id", F.lit(None).cast("long").alias("undo_ts"))
    u = undos.select("token", "ts", "event_id", F.col("ts").alias("undo_ts"))
    ahead = W.partitionBy("token").orderBy("ts", "event_id").rowsBetween(1, W.unboundedFollowing)
    both = b.withColumn("begin_ts", F.col("ts")).unionByName(u.withColumn("begin_ts", F.lit(None).cast("long")))
    rows = both.withColumn("next_begin", F.first("begin_ts", ignorenulls=True).over(ahead)).withColumn("undone", F.first("undo_ts", ignorenulls=True).over(ahead)).where("begin_ts is not null")
    due = F.least(F.col("ts") + window, F.coalesce("next_begin", F.col("ts") + window))
    return rows.select("token", "event_id", F.when(F.col("undone") < due, None).otherwise(due).alias("committed_at"))


def stale_answer_filter(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """Answers to the query their session asked last."""
    last = queries.groupBy("session").agg(F.max_by("query", F.struct("ts", "event_id")).alias("query"))
    return answers.join(last, ["session", "query"], "left_semi")
