"""Upkeep queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import store
from quireworks.operators import upkeep as U
from quireworks.plans.catalog import mtimes
from quireworks.plans.registry import query
from quireworks.session import shared_path

LIB = "library"


def base(t):
    return t.library.select("id", "uri", "title", "format", "size_bytes", "last_opened_at", "created_at", "is_starred")


UPDATES = """u AS (SELECT id AS update_no, CASE WHEN id % 4 = 0 THEN 'lib://new/' || (id % 100) ELSE uri END AS uri, 'n' || title AS title, format, size_bytes + 1 AS size_bytes,
    (last_opened_at + id * 1000)::BIGINT AS opened_at FROM library WHERE id % 3 = 0),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY opened_at DESC, update_no DESC) AS r FROM u) WHERE r = 1)"""


@query("M1", f"""WITH {UPDATES}
    SELECT l.id, l.uri, coalesce(w.title, l.title) AS title, coalesce(w.format, l.format) AS format, coalesce(w.size_bytes, l.size_bytes) AS size_bytes, coalesce(w.opened_at, l.last_opened_at) AS last_opened_at, l.created_at, l.is_starred
    FROM library l LEFT JOIN w USING (uri)
    UNION ALL SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY uri), uri, title, format, size_bytes, opened_at, opened_at, false FROM w WHERE uri NOT IN (SELECT uri FROM library)""", LIB)
def _(t):
    i = F.col("id")
    updates = t.library.where("id % 3 = 0").select(
        i.alias("update_no"), F.when(i % 4 == 0, F.concat(F.lit("lib://new/"), i % 100)).otherwise(F.col("uri")).alias("uri"), F.concat(F.lit("n"), "title").alias("title"), "format",
        (F.col("size_bytes") + 1).alias("size_bytes"), (F.col("last_opened_at") + i * 1000).alias("opened_at"),
    )
    return U.upsert_by_uri(base(t), updates)


REQUESTS = "r AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'lib://moved/' || (id % 300) WHEN id % 5 = 0 THEN uri ELSE 'lib://src' || ((id + 1) % 20) || '/' || (id + 1) END AS new_uri FROM library WHERE id % 3 = 1)"
JUDGED = f"""{REQUESTS}, j AS (SELECT r.*, o.id AS owner FROM r LEFT JOIN library o ON o.uri = r.new_uri),
    g AS (SELECT *, row_number() OVER (PARTITION BY new_uri ORDER BY id) AS k FROM j WHERE owner IS NULL OR owner = id)"""


@query("M2", f"""WITH {JUDGED}
    SELECT l.id, coalesce(g.new_uri, l.uri) AS uri, false AS refused FROM library l LEFT JOIN (SELECT * FROM g WHERE k = 1) g USING (id)
    UNION ALL SELECT id, new_uri, true FROM j WHERE owner <> id UNION ALL SELECT id, new_uri, true FROM g WHERE k > 1""", LIB)
def _(t):
    i = F.col("id")
    uri = F.when(i % 2 == 0, F.concat(F.lit("lib://moved/"), i % 300)).when(i % 5 == 0, F.col("uri")).otherwise(F.concat(F.lit("lib://src"), (i + 1) % 20, F.lit("/"), i + 1))
    after, refused = U.rebind_uri(t.library.select("id", "uri"), t.library.where("id % 3 = 1").select("id", uri.alias("new_uri")))
    return after.select("id", "uri", F.lit(False).alias("refused")).union(refused.select("id", "new_uri", F.lit(True)))


@query("M3", "SELECT id, CASE WHEN id % 4 = 0 THEN true ELSE is_starred END AS is_starred, CASE WHEN id % 4 = 0 THEN 7 ELSE last_opened_at END::BIGINT AS last_opened_at, CASE WHEN id % 4 = 0 THEN 'CODE' ELSE format END AS format FROM library", LIB)
def _(t):
    ids, out = t.library.where("id % 4 = 0").select("id"), base(t)
    for column, value in (("is_starred", F.lit(True)), ("last_opened_at", F.lit(7).cast("long")), ("format", F.lit("CODE"))):
        out = U.set_column(out, ids, column, value)
    return out.select("id", "is_starred", "last_opened_at", "format")


LEFT = """
    SELECT 'library' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM library WHERE id % 6 <> 0 UNION ALL SELECT 'progress', count(*), sum(document_id)::BIGINT FROM progress WHERE document_id % 6 <> 0
    UNION ALL SELECT 'highlights', count(*), sum(document_id)::BIGINT FROM highlights WHERE document_id % 6 <> 0 UNION ALL SELECT 'text', count(*), sum(document_id)::BIGINT FROM document_text WHERE document_id % 6 <> 0
    UNION ALL SELECT 'bookmarks', count(*), sum(document_id)::BIGINT FROM locations WHERE document_id % 6 <> 0"""


@query("M4", LEFT, "library progress highlights document_text locations")
def _(t):
    left = U.delete_documents({"library": t.library, "progress": t.progress, "highlights": t.highlights, "text": t.document_text, "bookmarks": t.locations}, t.library.where("id % 6 = 0"))
    out = None
    for name, df in left.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id" if name == "library" else "document_id").alias("ids"))
        out = part if out is None else out.union(part)
    return out


@query("M4_store", LEFT, "library progress highlights document_text locations")
def _(t):
    """The same removal as one change of kept tables."""
    kept = store.Store(t.spark, shared_path(t.spark, "store"))
    owned = {"progress": t.progress, "highlights": t.highlights, "text": t.document_text, "bookmarks": t.locations}
    kept.create({"documents": (t.library, "id")} | {name: (rows, "document_id") for name, rows in owned.items()})
    store.delete_documents(kept, t.library.where("id % 6 = 0"), dict.fromkeys(owned, "document_id"))
    out = kept.read("documents").agg(F.lit("library").alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    for name in owned:
        out = out.union(kept.read(name).agg(F.lit(name), F.count("*"), F.sum("document_id")))
    return out


REPLACED = """n AS (SELECT doc_id + 5 AS document_id, 'new ' || text AS text FROM documents WHERE doc_id % 8 = 0)
    SELECT document_id, text FROM document_text WHERE document_id NOT IN (SELECT document_id FROM n WHERE document_id IN (SELECT id FROM library))
    UNION ALL SELECT document_id, text FROM n WHERE document_id IN (SELECT id FROM library)"""


def replacing(t):
    return t.documents.where("doc_id % 8 = 0").select((F.col("doc_id") + 5).alias("document_id"), F.concat(F.lit("new "), "text").alias("text"))


@query("M5", f"WITH {REPLACED}", "library document_text")
def _(t):
    return U.replace_if_exists(t.document_text.select("document_id", "text"), replacing(t), t.library)


@query("M6", """
    WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS r FROM samples WHERE event_id % 2 = 0) WHERE r = 1 AND document_id IN (SELECT id FROM library WHERE id % 5 <> 0))
    SELECT document_id, unit, round(fraction, 9) AS fraction, zoom FROM progress WHERE document_id NOT IN (SELECT document_id FROM s) UNION ALL SELECT document_id, unit, round(fraction, 9), zoom FROM s""", "library progress")
def _(t):
    return U.save_progress(t.progress, t.samples.where("event_id % 2 = 0"), t.library.where("id % 5 <> 0")).withColumn("fraction", F.round("fraction", 9))


@query("M7", """
    WITH RECURSIVE c AS (SELECT event_id AS id, document_id AS d, kind, unit, fraction, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS n FROM locations WHERE kind < 3),
    f(d, n, id, kept, decision) AS (
      SELECT d, 0::BIGINT, NULL::BIGINT, []::STRUCT(kind INT, unit BIGINT, fraction DOUBLE)[], NULL::VARCHAR FROM (SELECT DISTINCT d FROM c)
      UNION ALL
      SELECT x.d, x.n, x.id, CASE WHEN near OR len(kept) >= 12 THEN kept ELSE list_append(kept, {'kind': kind, 'unit': unit, 'fraction': fraction}) END,
             CASE WHEN near THEN 'ALREADY_BOOKMARKED' WHEN len(kept) >= 12 THEN 'LIMIT_REACHED' ELSE 'ADD' END
      FROM (SELECT c.*, f.kept, len(list_filter(f.kept, lambda k: k.kind = c.kind AND k.unit = c.unit AND (c.kind = 0 OR abs(k.fraction - c.fraction) <= CASE c.kind WHEN 1 THEN 0.05 ELSE 0.1 END))) > 0 AS near
            FROM f JOIN c ON c.d = f.d AND c.n = f.n + 1) x)
    SELECT d AS document_id, id AS candidate_id, decision FROM f WHERE n > 0""", "locations")
def _(t):
    rows = t.locations.where("kind < 3").select("document_id", F.col("event_id").alias("candidate_id"), "ts", "kind", "unit", "fraction")
    return U.bookmark_dedupe(rows, 12)


@query("M8", """
    WITH b AS (SELECT event_id AS id, document_id, unit FROM samples WHERE event_id % 3 <> 0), u AS (SELECT event_id AS id, document_id, unit + 1 AS unit FROM samples WHERE event_id % 2 = 0)
    SELECT * FROM b UNION ALL SELECT * FROM u WHERE id NOT IN (SELECT id FROM b) AND document_id IN (SELECT id FROM library WHERE id % 4 <> 0)""", "library samples")
def _(t):
    rows = t.samples.select(F.col("event_id").alias("id"), "document_id", "unit")
    return U.restore_bookmark(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").withColumn("unit", F.col("unit") + 1), t.library.where("id % 4 <> 0"))


@query("M9", "SELECT id, document_id, (CASE WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN 1 ELSE 2 END ELSE kind END)::INT AS kind, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'a note ' || id END AS note FROM highlights", "highlights")
def _(t):
    notes = t.highlights.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "  \n ").otherwise(F.concat(F.lit("  a \t note  "), "id")).alias("note"))
    return U.set_note(t.highlights, notes).select("id", "document_id", "kind", "note")


@query("M10", """
    WITH m AS (SELECT id, CASE WHEN id % 5 = 0 THEN created_at + 1 WHEN id % 7 = 0 THEN 0 ELSE created_at END AS mtime FROM library),
         o AS (SELECT document_id, source_size, source_modified, 1 + (document_id % 4 = 0)::INT AS cache_version FROM document_text)
    SELECT document_id, source_size = size_bytes AND source_modified <> 0 AND source_modified = mtime AND cache_version = 1 AS valid FROM o JOIN library l ON l.id = document_id JOIN m ON m.id = document_id""", "library document_text")
def _(t):
    outlines = t.document_text.select("document_id", "source_size", "source_modified", (1 + (F.col("document_id") % 4 == 0).cast("int")).alias("cache_version"))
    return U.outline_cache_valid(outlines, t.library, mtimes(t), 1)


@query("M11", """
    WITH l AS (SELECT c.id, 'u' || c.id AS uri, title, strlen(text) AS size_bytes, sha256(text) AS hash FROM copies c WHERE id % 2 = 0),
         i AS (SELECT c.id AS incoming_id, 'u' || (c.id % 400 * 3) AS uri, title, strlen(text) AS size_bytes, sha256(text) AS hash FROM copies c WHERE id % 2 = 1),
         w AS (SELECT title, size_bytes, hash, min(id) AS twin FROM l GROUP BY ALL)
    SELECT incoming_id, coalesce(twin, l.id) AS id, CASE WHEN twin IS NOT NULL THEN 'touch' WHEN l.id IS NOT NULL THEN 're-point' ELSE 'insert' END AS action
    FROM i LEFT JOIN w ON w.title = i.title AND w.size_bytes = i.size_bytes AND w.hash = i.hash LEFT JOIN l ON l.uri = i.uri""", "copies")
def _(t):
    rows = t.copies.select("id", "title", F.octet_length("text").alias("size_bytes"), F.sha2("text", 256).alias("hash"))
    have = rows.where("id % 2 = 0").withColumn("uri", F.concat(F.lit("u"), "id"))
    new = rows.where("id % 2 = 1").withColumn("uri", F.concat(F.lit("u"), F.col("id") % 400 * 3)).withColumnRenamed("id", "incoming_id")
    return U.save_to_library(have, new)


@query("M12", "SELECT document_id, state, 0::BIGINT AS source_modified FROM document_text", "document_text")
def _(t):
    return U.schema_v2(t.document_text.select("document_id", "state"))


@query("write_text_index", f"WITH {REPLACED}", "library document_text")
def _(t):
    """Two writes to an index in the session's checkpoint folder, then what it holds."""
    path = shared_path(t.spark, "text-index")
    living = t.library.select("id").union(t.document_text.select("document_id")).distinct()
    U.write_text_index(t.document_text.select("document_id", "text"), living, path)
    U.write_text_index(replacing(t), t.library, path)
    return U.read_rows(t.spark, path)
