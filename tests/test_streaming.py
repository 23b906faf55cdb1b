"""Streams against their batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quireworks.operators import search as S
from quireworks.operators.segments import SegmentIndex
from quireworks.sources.views import Tables
from quireworks.streaming import flows, live

START = datetime(2024, 1, 1)


@pytest.fixture
def events(spark, sf, tmp_path):
    """The events table as files of one day each, read as a stream in their order."""
    rows = Tables(spark, sf).events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withColumn("day", F.to_date("ts"))
    days = sorted(r.day for r in rows.select("day").distinct().collect())[:6]
    for i, day in enumerate(days):
        rows.where(F.col("day") == F.lit(day)).drop("day").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:03d}"))
    last = rows.agg(F.max("event_id").alias("e")).first().e
    # a row far behind moves the watermark past everything before it
    end = spark.createDataFrame([(last + 1, -1, START + timedelta(days=400), "view", 0.0)], rows.drop("day").schema)
    end.coalesce(1).write.parquet(str(tmp_path / "in" / "999"))
    batch = spark.read.parquet(*[str(tmp_path / "in" / f"{i:03d}") for i in range(len(days))])
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return batch, stream


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_bursts(spark, events, tmp_path):
    batch, stream = events
    got = run(live.bursts(stream(), "2 hours", late="1 day"), "bursts", tmp_path).where("user_id >= 0")
    timed = batch.withColumn("ts", F.unix_micros("ts"))
    want = flows.settled_batches(timed, 7_200_000_000)
    mine = {(r.user_id, r.a, r.b, r.n) for r in got.select("user_id", F.unix_micros("first_ts").alias("a"), F.unix_micros("last_ts").alias("b"), "n").collect()}
    assert mine == {(r.user_id, r.first_ts, r.last_ts, r.n) for r in want.collect()} and mine


def test_debounce(spark, events, tmp_path):
    """The stream keeps each burst's last value; without equal neighbours both forms agree."""
    batch, stream = events
    got = run(live.debounce(stream(), "3 hours", "user_id", "event_id", late="1 day"), "debounced", tmp_path).where("user_id >= 0")
    want = flows.debounce_last(batch.withColumn("ts", F.unix_micros("ts")), 10_800_000_000, "user_id", "event_id")
    assert {(r.user_id, r.event_id) for r in got.collect()} == {(r.user_id, r.event_id) for r in want.collect()}


def test_changes(spark, events, tmp_path):
    batch, stream = events
    got = run(live.distinct_until_changed(stream().select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type"), "changes", tmp_path)
    want = flows.distinct_until_changed(batch, "user_id", ["event_type"], ["ts", "event_id"])
    assert {r.event_id for r in got.where("user_id >= 0").collect()} == {r.event_id for r in want.collect()}


def test_undone_removals(spark, events, tmp_path):
    batch, stream = events
    side = lambda df, kind: df.where((F.col("event_type") == kind) | (F.col("user_id") < 0)).select(F.col("user_id").alias("token"), "ts", "event_id")
    joined = live.undone_removals(side(stream(), "purchase"), side(stream(), "signup"), "6 hours", late="1 day")
    got = run(joined, "undone", tmp_path).where("token >= 0 and undo_ts is not null")
    b, u = side(batch, "purchase"), side(batch, "signup").select(F.col("token").alias("t2"), F.col("ts").alias("u_ts"))
    want = b.join(u, (F.col("token") == F.col("t2")) & (F.col("u_ts") >= F.col("ts")) & (F.col("u_ts") < F.col("ts") + F.expr("interval 6 hours")))
    assert sorted(r.begin_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_retry_deadlines(spark, events, tmp_path):
    batch, stream = events
    got = run(live.retry_deadlines(stream().where("event_type = 'error' or user_id < 0"), 3_600_000_000, late="1 day"), "deadlines", tmp_path).where("user_id >= 0")
    want = flows.retry_deadlines(batch.where("event_type = 'error'").withColumn("ts", F.unix_micros("ts")), 3_600_000_000)
    mine = sorted((r.user_id, r.event_id, r.eligible_at) for r in got.collect())
    assert mine == sorted((r.user_id, r.event_id, r.eligible_at) for r in want.collect()) and mine


def test_undo_window(spark, events, tmp_path):
    """Commits after the window, at the next begin, or never, as in the batch form."""
    batch, stream = events
    side = lambda df, kind: df.where((F.col("event_type") == kind) | (F.col("user_id") < 0)).select(F.col("user_id").alias("token"), "ts", "event_id")
    got = run(live.undo_window(side(stream(), "purchase"), side(stream(), "signup").where("token >= 0"), 6 * 3_600_000_000, late="1 day"), "committed", tmp_path).where("token >= 0")
    timed = batch.withColumn("ts", F.unix_micros("ts"))
    want = flows.undo_window(side(timed, "purchase"), side(timed, "signup"), 6 * 3_600_000_000)
    mine = sorted((r.token, r.event_id, r.committed_at or 0) for r in got.collect())
    assert mine == sorted((r.token, r.event_id, r.committed_at or 0) for r in want.collect()) and 0 < sum(r[2] == 0 for r in mine) < len(mine)


@pytest.fixture
def shuffled(spark, sf, tmp_path):
    """Events whose files are no days: each holds rows of the whole time, so most rows come late, within the watermark."""
    rows = Tables(spark, sf).events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").where("event_id < 600")
    end = rows.agg(F.max("ts") + F.expr("interval 400 days")).first()[0]
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    last = [(-1 - i, -1 - i, end + timedelta(days=400 * i), "end", 0.0) for i in range(2)]
    for i, row in enumerate(last):
        spark.createDataFrame([row], "event_id long, user_id long, ts timestamp, event_type string, value double").select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{3 + i:03d}"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return rows, stream


def test_gate_on_late_input(spark, shuffled, tmp_path):
    batch, stream = shuffled
    signals = lambda df: df.select("ts", "event_id", F.element_at(F.array(*map(F.lit, ["enabled", "reading", "battery"])), (F.abs("event_id") % 3 + 1).cast("int")).alias("signal"), (F.hash("event_id") % 2 == 0).alias("on"))
    got = run(live.combine_latest_gate(signals(stream()), late="300 days"), "gate", tmp_path)
    want = flows.combine_latest_gate(signals(batch).withColumn("ts", F.unix_micros("ts")))
    last = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
    assert sorted((r.ts, r.open) for r in got.where(F.col("ts") <= last).collect()) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_presence_on_late_input(spark, shuffled, tmp_path):
    batch, stream = shuffled
    moves = lambda df: df.withColumn("step", F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1))
    got = run(live.presence_count(moves(stream()), "user_id", late="300 days"), "presence", tmp_path).where("user_id >= 0")
    want = flows.presence_count(moves(batch).withColumn("ts", F.unix_micros("ts")), "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == batch.count()


def test_latest_values_on_late_input(spark, shuffled, tmp_path):
    batch, stream = shuffled
    side = lambda df, kind: df.where((F.col("event_type") == kind) | (F.col("user_id") < 0)).select(F.col("user_id").alias("session"), "ts", "event_id", (F.col("event_id") % 2).alias("query"))
    got = run(live.stale_answer_filter(side(stream(), "click"), side(stream(), "view"), late="300 days"), "answers", tmp_path).where("session >= 0")
    asked = sorted((r.ts, r.event_id, r.session, r.query) for r in side(batch, "view").collect())
    want = []
    for r in side(batch, "click").collect():
        before = [q for ts, _, session, q in asked if session == r.session and ts <= r.ts]
        if before and before[-1] == r.query:
            want.append((r.session, r.event_id, str(r.query)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_gates_of_samples_on_late_input(spark, shuffled, tmp_path):
    batch, stream = shuffled
    samples = lambda df: df.select(F.col("user_id").alias("document_id"), "ts", "event_id", (F.col("event_id") % 2).alias("unit"), F.lit(0.5).alias("fraction"), (F.col("event_id") % 7 / 1000).alias("zoom"))
    micros = lambda df: df.withColumn("ts", F.unix_micros("ts"))
    moved = run(live.movement_gate(samples(stream()), late="300 days"), "moved", tmp_path).where("document_id >= 0")
    want = flows.movement_gate(micros(samples(batch))).select("document_id", "event_id", "ts")
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, want.collect())) and 0 < want.count() < batch.count()
    marks = lambda df: samples(df.where("event_type = 'signup' or user_id < 0"))
    restored = run(live.restore_gate(samples(stream()), marks(stream()), late="300 days"), "restored", tmp_path).where("document_id >= 0")
    want = flows.restore_gate(micros(samples(batch)), micros(marks(batch))).select("document_id", "event_id", "ts")
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, want.collect())) and 0 < want.count() < batch.count()


def test_eager_arrivals(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(n, i, rng.choice([100, 100, 100, 200, 900])) for n in range(6) for i in range(60) if rng.random() < 0.8]
    lists = spark.createDataFrame(rows, "snapshot_no long, id long, size_bytes long")
    for n in range(6):
        lists.where(F.col("snapshot_no") == n).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    source = spark.readStream.schema(lists.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(live.eager_arrivals(source, 512), "arrivals", tmp_path)
    want = flows.eager_arrivals(lists, 512)
    mine = sorted(map(tuple, got.collect()))
    assert mine == sorted(map(tuple, want.select("snapshot_no", "id", "size_bytes").collect())) and mine


def test_incremental_index_equals_a_rebuild(spark, sf, tmp_path):
    docs = Tables(spark, sf).documents.select(F.col("doc_id").alias("document_id"), "text", F.lit(START).alias("ts"))
    parents = docs.where("document_id % 7 <> 0").select(F.col("document_id").alias("id"))
    changed = docs.where("document_id % 5 = 0").withColumn("text", F.concat(F.lit("fresh words "), "text")).withColumn("ts", F.lit(START + timedelta(days=1)))
    for i, part in enumerate((docs.where("document_id % 2 = 0"), docs.where("document_id % 2 = 1"), changed)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "index")
    live.index_arrivals(source, lambda: parents, path, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(180)
    final = docs.join(changed.select("document_id"), "document_id", "left_anti").unionByName(changed).join(parents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rebuilt, _ = S.build_postings(final.select(F.col("document_id").alias("doc_id"), "text"))
    index = SegmentIndex(spark, path)
    kept = index.postings().select("term", "doc_id", "tf")
    assert kept.exceptAll(rebuilt.select('term', 'doc_id', 'tf')).count() == 0 and rebuilt.select('term', 'doc_id', 'tf').exceptAll(kept).count() == 0
    assert index.texts().count() == final.count() and index.state()[1]["batch"] == 2
    queries = spark.createDataFrame([(1, "ment tion"), (2, "a the"), (3, "fresh")], "query_id int, text string")
    scores = lambda df: {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}
    want = scores(S.scored(final.select(F.col("document_id").alias("doc_id"), "text"), queries))
    assert scores(index.scored(queries)) == want and len(want) > 50
