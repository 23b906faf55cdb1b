"""Queries of event flows and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import segments
from quireworks.plans.registry import query
from quireworks.session import shared_path
from quireworks.streaming import flows as S
from quireworks.streaming import live

HOUR = 3_600_000_000


def timed(t):
    return t.events.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


EV = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts)::BIGINT AS ts, value FROM events)"


@query("S1", f"""
    WITH c AS (SELECT *, lag(unit) OVER w AS p FROM samples WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
         n AS (SELECT document_id, unit, ts, lead(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS n FROM c WHERE p IS NULL OR p <> unit)
    SELECT document_id, unit, ts FROM n WHERE n IS NULL OR n - ts >= {6 * HOUR}""", "samples")
def _(t):
    return S.debounce_last(t.samples, 6 * HOUR)


@query("S2", """
    WITH f AS (SELECT *, first_value(unit) OVER w AS u0, first_value(fraction) OVER w AS f0 FROM samples WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
         m AS (SELECT *, max((unit <> u0 OR abs(fraction - f0) > 0.01)::INT) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM f)
    SELECT event_id, document_id, unit FROM m WHERE m = 1""", "samples")
def _(t):
    return S.movement_gate(t.samples).select("event_id", "document_id", "unit")


@query("S3", "SELECT s.event_id, s.document_id FROM samples s JOIN (SELECT document_id, min(ts) AS r FROM samples WHERE event_id % 9 = 0 GROUP BY 1) m USING (document_id) WHERE s.ts >= r", "samples")
def _(t):
    return S.restore_gate(t.samples, t.samples.where("event_id % 9 = 0")).select("event_id", "document_id")


@query("S4", f"WITH {EV}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e) SELECT event_id, user_id, event_type FROM c WHERE p IS NULL OR p <> event_type")
def _(t):
    return S.distinct_until_changed(timed(t), "user_id", ["event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("S5", """
    WITH l AS (SELECT ts, event_id, coalesce(last_value(CASE WHEN signal = 'enabled' THEN "on" END IGNORE NULLS) OVER w, false) AND NOT coalesce(last_value(CASE WHEN signal = 'reading' THEN "on" END IGNORE NULLS) OVER w, false)
                      AND NOT coalesce(last_value(CASE WHEN signal = 'battery' THEN "on" END IGNORE NULLS) OVER w, false) AS open FROM signals WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
         p AS (SELECT *, lag(open) OVER (ORDER BY ts, event_id) AS p FROM l)
    SELECT ts, open FROM p WHERE p IS NULL OR p <> open""", "signals")
def _(t):
    return S.combine_latest_gate(t.signals)


@query("S6", f"""
    WITH {EV}, s AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, ts, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))::BIGINT AS count FROM s""")
def _(t):
    return S.presence_count(timed(t).withColumn("step", F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)), "user_id")


@query("S7", """
    WITH s AS (SELECT n AS snapshot_no, id, size_bytes + CASE WHEN id % 7 = n THEN 1 ELSE 0 END AS size_bytes FROM library, range(0, 4) r(n) WHERE id % 4 <= n), k AS (SELECT * FROM s WHERE size_bytes <= 4096)
    SELECT * FROM k WHERE (snapshot_no - 1, id, size_bytes) NOT IN (SELECT snapshot_no, id, size_bytes FROM k)""", "library")
def _(t):
    lists = t.library.select("id", "size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("snapshot_no")).where("id % 4 <= snapshot_no")
    return S.eager_arrivals(lists.withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("id") % 7 == F.col("snapshot_no"), 1).otherwise(0)), 4096)


@query("S8", f"""
    WITH {EV}, g AS (SELECT *, (ts - lag(ts) OVER w >= {2 * HOUR})::INT AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS burst_no FROM g)
    SELECT user_id, burst_no::BIGINT AS burst_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t):
    return S.settled_batches(timed(t), 2 * HOUR)


@query("S9", f"WITH {EV} SELECT user_id, event_id, ts + {24 * HOUR} AS eligible_at, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts + {24 * HOUR}, false) AS retried FROM e WHERE event_type = 'error'")
def _(t):
    return S.retry_deadlines(timed(t).where("event_type = 'error'"), 24 * HOUR)


@query("S10", f"""
    WITH b AS (SELECT token, ts, event_id FROM removals WHERE action = 'begin'),
         n AS (SELECT b.*, (SELECT min(ts) FROM removals r WHERE r.action = 'begin' AND r.token = b.token AND (r.ts, r.event_id) > (b.ts, b.event_id)) AS nb,
                      (SELECT min(ts) FROM removals r WHERE r.action = 'undo' AND r.token = b.token AND (r.ts, r.event_id) > (b.ts, b.event_id)) AS u FROM b)
    SELECT token, event_id, CASE WHEN u < least(ts + {6 * HOUR}, coalesce(nb, ts + {6 * HOUR})) THEN NULL ELSE least(ts + {6 * HOUR}, coalesce(nb, ts + {6 * HOUR})) END AS committed_at FROM n""", "removals")
def _(t):
    return S.undo_window(t.removals.where("action = 'begin'"), t.removals.where("action = 'undo'"), 6 * HOUR)


@query("S11", """
    WITH p AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 8 = 0 THEN 'new ' || text ELSE text END)), '[\\p{L}\\p{N}]+')) AS term FROM documents)
    SELECT term, doc_id, count(*) AS tf FROM p GROUP BY 1, 2""")
def _(t):
    """The stream itself: all documents arrive, then an eighth of them anew; the postings it keeps."""
    place = shared_path(t.spark, "arrivals")
    docs = t.documents.select(F.col("doc_id").alias("document_id"), "text", F.lit(0).alias("ts"))
    changed = docs.where("document_id % 8 = 0").select("document_id", F.concat(F.lit("new "), "text").alias("text"), F.lit(1).alias("ts"))
    for number, part in enumerate((docs, changed)):
        part.write.parquet(f"{place}/in/{number}")
        source = t.spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        # parents are asked for anew in every batch
        run = live.index_arrivals(source, lambda: t.documents.select(F.col("doc_id").alias("id")), f"{place}/index", f"{place}/checkpoint", {"availableNow": True})
        run.awaitTermination()
    return segments.SegmentIndex(t.spark, f"{place}/index").postings().select("term", "doc_id", "tf")


@query("S12", f"""
    WITH {EV}, q AS (SELECT user_id AS session, arg_max(event_id % 6, (ts, event_id)) AS query FROM e WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, user_id AS session, event_id % 6 AS query FROM e JOIN q ON q.session = e.user_id AND q.query = e.event_id % 6 WHERE event_type = 'click'""")
def _(t):
    rows = timed(t).select("event_id", F.col("user_id").alias("session"), (F.col("event_id") % 6).alias("query"), "ts", "event_type")
    return S.stale_answer_filter(rows.where("event_type = 'click'"), rows.where("event_type = 'view'")).select("event_id", "session", "query")
