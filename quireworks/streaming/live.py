"""The flows on streams.  Late rows: behind the watermark (ten minutes unless given) they are dropped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quireworks.operators import segments

LATE = "10 minutes"


def debounce(samples: DataFrame, gap: str, key: str = "document_id", value: str = "unit", late: str = LATE) -> DataFrame:
    """S1 by session windows: the last value of each burst; an equal sample restarts the burst, unlike in the batch form."""
    last = F.max_by(F.struct(F.col(value), F.col("ts")), F.struct("ts", "event_id")).alias("s")
    sessions = samples.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(last)
    return sessions.select(key, F.col(f"s.{value}").alias(value), "s.ts")


def bursts(arrivals: DataFrame, settle: str, key: str = "user_id", late: str = LATE) -> DataFrame:
    """Arrivals less than `settle` apart as one burst."""
    window = F.session_window("ts", settle)
    grouped = arrivals.withWatermark("ts", late).groupBy(key, window).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return grouped.select(key, "first_ts", "last_ts", "n")


def undone_removals(begins: DataFrame, undos: DataFrame, window: str, late: str = LATE) -> DataFrame:
    """Removals with the undo of the same token within the window, as an interval join of two streams."""
    b = begins.select(F.col("token").alias("b_token"), F.col("ts").alias("begin_ts"), F.col("event_id").alias("begin_id")).withWatermark("begin_ts", late)
    u = undos.select("token", F.col("ts").alias("undo_ts")).withWatermark("undo_ts", late)
    near = (F.col("token") == F.col("b_token")) & (F.col("undo_ts") >= F.col("begin_ts")) & (F.col("undo_ts") < F.col("begin_ts") + F.expr(f"interval {window}"))
    return b.join(u, near, "leftOuter").select(F.col("b_token").alias("token"), "begin_id", "begin_ts", "undo_ts")


class _Changes(StatefulProcessor):
    """Keeps the last value of a key and lets rows through that differ from it."""

    def __init__(self, columns: list[str], value: str):
        self.columns, self.value = columns, value

    def init(self, handle) -> None:  # noqa: ANN001
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for i, now in enumerate(batch[self.value].astype(str)):
            if now != last:
                out.append(i)
                last = now
        self.last.update((last,))
        yield batch.iloc[out][self.columns]

    def close(self) -> None:
        pass


def distinct_until_changed(changes: DataFrame, key: str, value: str) -> DataFrame:
    """S4 with one value of state per key; needs a state store with column families (RocksDB)."""
    return changes.groupBy(key).transformWithStateInPandas(_Changes(changes.columns, value), outputStructType=changes.schema, outputMode="append", timeMode="none")


class _Arrivals(StatefulProcessor):
    """The list and size a document was last seen in; lets it through unless the list before had it at this size."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.last = handle.getValueState("last", "snapshot_no long, size_bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).drop_duplicates().sort_values("snapshot_no")
        last = self.last.get() if self.last.exists() else (None, None)
        out = []
        for i, now in enumerate(zip(batch["snapshot_no"].tolist(), batch["size_bytes"].tolist(), strict=True)):
            if last[0] is None or last[0] != now[0] - 1 or last[1] != now[1]:
                out.append(i)
            last = now
        self.last.update(last)
        yield batch.iloc[out][["snapshot_no", "id", "size_bytes"]]

    def close(self) -> None:
        pass


def eager_arrivals(snapshots: DataFrame, max_bytes: int) -> DataFrame:
    """Small documents that are new at their size against the list before, one value of state per document; lists
    (snapshot_no, id, size_bytes) arrive in their order, in whole batches."""
    small = snapshots.where(F.col("size_bytes") <= max_bytes).select(*[F.col(c).cast("long").alias(c) for c in ("snapshot_no", "id", "size_bytes")])
    return small.groupBy("id").transformWithStateInPandas(_Arrivals(), outputStructType=small.schema, outputMode="append", timeMode="none")


class _Timed(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them; then they are handled in their order.

    handle_due gets the rows that are due and the time reached (microseconds), and returns rows of output and the next
    time to wake up, if any.  The store is keyed by event time, so late rows within the watermark fall into place.
    """

    columns: list[str] = []

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, begin boolean")
        self.pending = handle.getValueState("pending", "ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for ts, event, begin in zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["begin"].tolist(), strict=True):
                self.waiting.appendValue((int(ts), int(event), bool(begin)))
                self.handle.registerTimer(-(-int(ts) // 1000))
        yield pd.DataFrame({c: [] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        # everything before the watermark is here; timers set behind it would not fire in this batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        if due:
            later = [r for r in rows if r[0] > now]
            self.waiting.put(later) if later else self.waiting.clear()
        out, wake = self.handle_due(due, now)
        if wake is not None:
            self.handle.registerTimer(-(-wake // 1000))
        yield pd.DataFrame({c: [key[0] if c == "key" else r[c] for r in out] for c in self.columns}).astype("object")

    def handle_due(self, due: list[tuple], now: int) -> tuple[list[dict], int | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Deadlines(_Timed):
    """Says of each failed attempt when it may be repeated, once that time has come."""

    columns = ["key", "event_id", "eligible_at"]

    def __init__(self, retry: int):
        self.retry = retry

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from super().handleInputRows(key, (b.assign(us=b["us"] + self.retry) for b in rows), timerValues)

    def handle_due(self, due: list[tuple], now: int) -> tuple[list[dict], int | None]:
        return [{"event_id": e, "eligible_at": at} for at, e, _ in due], None


class _Undo(_Timed):
    """At most one pending removal of a token: it commits when its window ends or the next one begins, unless undone."""

    columns = ["key", "event_id", "committed_at"]

    def __init__(self, window: int):
        self.window = window

    def handle_due(self, due: list[tuple], now: int) -> tuple[list[dict], int | None]:
        pending = self.pending.get() if self.pending.exists() else None
        out = []
        for ts, event, begin in [*due, (now, None, None)]:
            if pending and pending[0] + self.window <= ts:
                out.append({"event_id": pending[1], "committed_at": pending[0] + self.window})
                pending = None
            if event is None:
                break
            if pending:
                out.append({"event_id": pending[1], "committed_at": ts if begin else None})
                pending = None
            if begin:
                pending = (ts, event)
        self.pending.update(pending) if pending else self.pending.clear()
        return out, pending[0] + self.window if pending else None


def _by_time(events: DataFrame, processor: StatefulProcessor, names: list[str], late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).select(F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "begin")
    made = rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=", ".join(f"{c} long" for c in processor.columns), outputMode="append", timeMode="eventTime")
    return made.select(*[F.col(c).alias(n) for c, n in zip(processor.columns, names, strict=True)])


def retry_deadlines(attempts: DataFrame, retry: int, key: str = "user_id", late: str = LATE) -> DataFrame:
    """S9 by event-time timers: key, event_id, eligible_at (microseconds), for each failed attempt once its time has come."""
    return _by_time(attempts.select(F.col(key).alias("key"), "ts", "event_id", F.lit(True).alias("begin")), _Deadlines(retry), [key, "event_id", "eligible_at"], late)


def undo_window(begins: DataFrame, undos: DataFrame, window: int, late: str = LATE) -> DataFrame:
    """Token, event_id and committed_at of each removal, by event-time timers: after the window, at once when the
    token's next removal begins, and null as soon as it is undone in time."""
    side = lambda df, begin: df.select(F.col("token").alias("key"), "ts", "event_id", F.lit(begin).alias("begin"))
    return _by_time(side(begins, True).unionByName(side(undos, False)), _Undo(window), ["token", "event_id", "committed_at"], late)


class _Fold(StatefulProcessor):
    """Rows of a key in the order of event time, folded over a state that is kept as text.

    Rows wait until the watermark has passed them, so late ones within it fall into place; `step` gets the state (None at
    first) and a row (ts in microseconds, side, event_id, value) and returns the next state and the values of a row of
    output, or None.
    """

    def __init__(self, step: Callable, columns: list[str]):
        self.step, self.columns = step, columns

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, side int, event_id long, value string")
        self.state = handle.getValueState("state", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for ts, side, event, value in zip(batch["us"].tolist(), batch["side"].tolist(), batch["event_id"].tolist(), batch["value"].tolist(), strict=True):
                self.waiting.appendValue((int(ts), int(side), int(event), value))
                self.handle.registerTimer(-(-int(ts) // 1000))
        yield pd.DataFrame({c: [] for c in self.columns}, dtype="object")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], r[2])) if self.waiting.exists() else []
        due, out = [r for r in rows if r[0] <= now], []
        if due:
            later = rows[len(due) :]
            self.waiting.put(later) if later else self.waiting.clear()
            held = json.loads(self.state.get()[0]) if self.state.exists() else None
            for row in due:
                held, made = self.step(held, *row)
                if made is not None:
                    out.append((key[0], *made))
            self.state.update((json.dumps(held),))
        yield pd.DataFrame({c: [r[i] for r in out] for i, c in enumerate(self.columns)}, dtype="object")

    def close(self) -> None:
        pass


def fold_in_order(events: DataFrame, step: Callable, columns: dict[str, str], late: str = LATE) -> DataFrame:
    """A fold over each key's events (key, ts, side, event_id, value) in event time: key and the columns that step returns."""
    rows = events.withWatermark("ts", late).select(
        F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("side").cast("int").alias("side"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("string").alias("value")
    )
    shape = ", ".join(f"{c} {t}" for c, t in {"key": "long", **columns}.items())
    return rows.groupBy("key").transformWithStateInPandas(_Fold(step, ["key", *columns]), outputStructType=shape, outputMode="append", timeMode="eventTime")


def _gate(held: dict | None, ts: int, side: int, event_id: int, value: str) -> tuple[dict, tuple | None]:
    held = held or {"last": {}, "open": None}
    signal, on = value.rsplit("=", 1)
    held["last"][signal] = on == "true"
    is_open = held["last"].get("enabled", False) and not held["last"].get("reading", False) and not held["last"].get("battery", False)
    changed, held["open"] = is_open != held["open"], is_open
    return held, (ts, is_open) if changed else None


def combine_latest_gate(signals: DataFrame, key: str | None = None, late: str = LATE) -> DataFrame:
    """Changes of the gate (ts in microseconds, open) over the latest values of its three signals; one gate a key, one in
    all where no key is named."""
    rows = signals.select((F.col(key) if key else F.lit(0)).alias("key"), "ts", F.lit(0).alias("side"), "event_id", F.concat("signal", F.lit("="), F.col("on").cast("string")).alias("value"))
    return fold_in_order(rows, _gate, {"ts": "long", "open": "boolean"}, late)


def _count(held: int | None, ts: int, side: int, event_id: int, value: str) -> tuple[int, tuple]:
    held = max((held or 0) + int(value), 0)
    return held, (event_id, ts, held)


def presence_count(moves: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """A counter of entries (step +1) and exits (-1) that never goes below zero: key, event_id, ts, count."""
    rows = moves.select(F.col(key).alias("key"), "ts", F.lit(0).alias("side"), "event_id", F.col("step").alias("value"))
    return fold_in_order(rows, _count, {"event_id": "long", "ts": "long", "count": "long"}, late).withColumnRenamed("key", key)


def _latest(held: str | None, ts: int, side: int, event_id: int, value: str) -> tuple[str | None, tuple | None]:
    return (value, None) if side == 0 else (held, (event_id, value, held))


def latest_value(rows: DataFrame, values: DataFrame, key: str, column: str, late: str = LATE) -> DataFrame:
    """Each row (key, ts, event_id, column) with the value of the other stream (key, ts, event_id, column) that was the
    latest at its time: key, event_id, value, latest; null where there was none yet."""
    side = lambda df, n: df.select(F.col(key).alias("key"), "ts", F.lit(n).alias("side"), "event_id", F.col(column).alias("value"))
    return fold_in_order(side(values, 0).unionByName(side(rows, 1)), _latest, {"event_id": "long", "value": "string", "latest": "string"}, late).withColumnRenamed("key", key)


def stale_answer_filter(answers: DataFrame, queries: DataFrame, late: str = LATE) -> DataFrame:
    """S12 while sessions go on: answers to the query that was their session's latest when they came: session, event_id, query."""
    return latest_value(answers, queries, "session", "query", late).where("value = latest").select("session", "event_id", F.col("value").alias("query"))


def _after_first(held: bool | None, ts: int, side: int, event_id: int, value: str) -> tuple[bool, tuple | None]:
    held = bool(held) or side == 0
    return held, (event_id, ts) if held and side else None


def restore_gate(samples: DataFrame, markers: DataFrame, key: str = "document_id", late: str = LATE) -> DataFrame:
    """S3: samples from their document's restore on: key, event_id, ts."""
    side = lambda df, n: df.select(F.col(key).alias("key"), "ts", F.lit(n).alias("side"), "event_id", F.lit("").alias("value"))
    return fold_in_order(side(markers, 0).unionByName(side(samples, 1)), _after_first, {"event_id": "long", "ts": "long"}, late).withColumnRenamed("key", key)


class _Moved:
    """Passes from the first sample on that differs from the first one by its unit or by more than the tolerance."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def __call__(self, held: dict | None, ts: int, side: int, event_id: int, value: str) -> tuple[dict, tuple | None]:
        unit, fraction, zoom = json.loads(value)
        held = held or {"first": [unit, fraction, zoom], "moved": False}
        far = lambda a, b: a is not None and b is not None and abs(a - b) > self.tolerance
        held["moved"] = held["moved"] or unit != held["first"][0] or far(fraction, held["first"][1]) or far(zoom, held["first"][2])
        return held, (event_id, ts) if held["moved"] else None


def movement_gate(samples: DataFrame, tolerance: float = 0.01, key: str = "document_id", late: str = LATE) -> DataFrame:
    """Samples once their document has moved: key, event_id, ts."""
    rows = samples.select(F.col(key).alias("key"), "ts", F.lit(0).alias("side"), "event_id", F.to_json(F.array(F.col("unit").cast("double"), F.col("fraction").cast("double"), F.col("zoom").cast("double"))).alias("value"))
    return fold_in_order(rows, _Moved(tolerance), {"event_id": "long", "ts": "long"}, late).withColumnRenamed("key", key)


def index_arrivals(arrivals: DataFrame, parents: Callable[[], DataFrame], path: str, checkpoint: str, trigger: dict | None = None, fan: int = 4) -> StreamingQuery:
    """Every settled batch of new or changed texts (a null one: removed) becomes a segment of the index at `path`.

    SegmentIndex(path) is searched while the stream runs.  Texts whose parent is gone by the time of the batch remove
    what the index has of them.  A batch that is sent again after a failure is recognised by its number.
    """
    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("document_id").agg(F.max_by("text", "ts").alias("text"))
        alive = parents().select(F.col("id").alias("document_id"), F.lit(True).alias("alive"))
        rows = last.join(alive, "document_id", "left").select(F.col("document_id").alias("doc_id"), F.when(F.col("alive"), F.col("text")).alias("text"))
        segments.SegmentIndex(batch.sparkSession, path, fan).apply(rows, number)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
