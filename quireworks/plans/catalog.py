"""Catalog queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.functions import formats
from quireworks.operators import catalog as C
from quireworks.plans.registry import query

LIB = "library"
NOW = 1_704_110_400_000_000  # 2024-01-01 12:00
MTIMES = "SELECT id, CASE WHEN id % 5 = 0 THEN created_at + 1 WHEN id % 7 = 0 THEN 0 ELSE created_at END AS mtime FROM library"


def mtimes(t):
    i = F.col("id")
    return t.library.select("id", F.when(i % 5 == 0, F.col("created_at") + 1).when(i % 7 == 0, 0).otherwise(F.col("created_at")).alias("mtime"))


def hits(t):
    return t.documents.where(F.contains("text", F.lit("ment"))).select(F.col("doc_id").alias("id"))


SCAN = "id, uri, title, size_bytes, created_at, last_opened_at, is_starred, rank"


@query("scan_library", "SELECT id, uri, title, size_bytes, created_at, last_opened_at, is_starred, row_number() OVER (ORDER BY last_opened_at DESC, id) AS rank FROM library", LIB)
def _(t):
    return C.scan_library(t.library).select(*SCAN.split(", "))


for name, column, value in (("lookup_by_id", "id", 17), ("lookup_by_uri", "uri", "lib://src2/42"), ("lookup_by_title", "title", "file7.epub")):
    shown = repr(value) if isinstance(value, str) else value

    @query(name, f"SELECT id, uri, title, size_bytes FROM library WHERE {column} = {shown}", LIB)
    def _(t, column=column, value=value):
        return C.lookup(t.library, column, value).select("id", "uri", "title", "size_bytes")


@query("scan_uris", "SELECT 'lib://' || source || '/' || doc_id AS uri FROM documents")
def _(t):
    return t.documents.select(F.concat(F.lit("lib://"), "source", F.lit("/"), "doc_id").alias("uri"))


@query("library_filter", "SELECT id, title, format_group FROM library WHERE is_starred AND format_group IN ('TEXT', 'TSV', 'WORD')", LIB)
def _(t):
    return C.library_filter(t.library, ["TEXT", "TSV", "WORD"], True).select("id", "title", "format_group")


@query("title_contains", "SELECT id, title FROM library WHERE contains(lower(title), 'e1')", LIB)
def _(t):
    return C.title_contains(t.library, "  E1 ").select("id", "title")


@query("library_view", """
    WITH f AS (SELECT l.*, h.doc_id IS NOT NULL AS hit, contains(lower(title), '1.') AS tm FROM library l
               LEFT JOIN (SELECT doc_id FROM documents WHERE contains(text, 'ment')) h ON h.doc_id = l.id
               WHERE format_group IN ('TEXT', 'MARKDOWN', 'PDF'))
    SELECT id, title, row_number() OVER (ORDER BY CASE WHEN tm THEN 0 ELSE 1 END, size_bytes DESC, last_opened_at DESC, id) AS rank FROM f WHERE tm OR hit""", LIB)
def _(t):
    return C.library_view(t.library, hits(t), "1.", ["TEXT", "MARKDOWN", "PDF"], False, "size")


PENDING = f"""
    SELECT id, size_bytes FROM library l LEFT JOIN document_text d ON d.document_id = l.id
    WHERE %s (d.document_id IS NULL OR d.index_version < 1 OR d.source_size <> l.size_bytes OR (d.state = 'FAILED' AND d.indexed_at <= {NOW}))
    ORDER BY id LIMIT 64"""


@query("pending_index_queue", PENDING % "", "library document_text")
def _(t):
    return C.pending_index_queue(t.library, t.document_text, 1, NOW, 64)


@query("pending_index_queue_small", PENDING % "size_bytes <= 4096 AND", "library document_text")
def _(t):
    return C.pending_index_queue(t.library, t.document_text, 1, NOW, 64, 4096)


@query("changed_since_indexed", f"""
    WITH m AS ({MTIMES})
    SELECT l.id, d.source_modified AS old_mtime, m.mtime::BIGINT AS new_mtime FROM library l JOIN document_text d ON d.document_id = l.id JOIN m ON m.id = l.id
    WHERE d.state = 'INDEXED' AND d.index_version = 1 AND d.source_modified <> 0 AND m.mtime > 0 AND m.mtime <> d.source_modified""", "library document_text")
def _(t):
    return C.changed_since_indexed(t.library, t.document_text, mtimes(t), 1)


@query("keyset_page", "SELECT id, size_bytes FROM library WHERE id > 40 ORDER BY id LIMIT 25", LIB)
def _(t):
    return C.keyset_page(t.library, 40, 25).select("id", "size_bytes")


@query("text_summary", "SELECT l.id, d.state, d.char_count FROM library l JOIN document_text d ON d.document_id = l.id WHERE d.source_size = l.size_bytes", "library document_text")
def _(t):
    return C.text_summary(t.library, t.document_text)


@query("hide_pending_removals", "SELECT id, title FROM library WHERE id NOT IN (SELECT token FROM removals WHERE action = 'begin')", "library removals")
def _(t):
    hidden = t.removals.where("action = 'begin'").select(F.col("token").alias("id"))
    return C.hide_pending_removals(t.library, hidden).select("id", "title")


KIND = "CASE WHEN format IN ('PDF','PPTX') THEN 0 WHEN format IN ('TEXT','CODE','CSV','UNKNOWN') THEN 1 WHEN format = 'MARKDOWN' THEN 3 ELSE 2 END"


@query("restore_candidates", f"SELECT document_id, kind, unit, round(fraction, 6) AS fraction, zoom FROM progress p JOIN library l ON l.id = p.document_id WHERE kind = {KIND}", "library progress")
def _(t):
    return C.restore_candidates(t.progress, t.library).withColumn("fraction", F.round("fraction", 6))


@query("join_left_outer_text", "SELECT l.id, title, state, char_count FROM library l LEFT JOIN document_text d ON d.document_id = l.id", "library document_text")
def _(t):
    return C.join_text(t.library, t.document_text, "left")


@query("join_inner_text", "SELECT l.id, title, state, char_count FROM library l JOIN document_text d ON d.document_id = l.id", "library document_text")
def _(t):
    return C.join_text(t.library, t.document_text, "inner")


@query("join_semi_parent_exists", "SELECT event_id, document_id FROM samples WHERE document_id IN (SELECT id FROM library)", "library samples")
def _(t):
    return C.join_semi_parent_exists(t.samples.select("event_id", "document_id"), t.library)


@query("join_anti_orphans", f"""
    SELECT path FROM (SELECT 'lib://src' || (doc_id % 23) || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1704067200000000 + doc_id * 60000000 END AS mtime FROM documents)
    WHERE mtime > 0 AND mtime < {NOW} AND path NOT IN (SELECT uri FROM library)""", LIB)
def _(t):
    d = F.col("doc_id")
    files = t.documents.select(
        F.concat(F.lit("lib://src"), d % 23, F.lit("/"), d).alias("path"), F.when(d % 11 == 0, 0).otherwise(F.lit(1_704_067_200_000_000) + d * 60_000_000).alias("mtime")
    )
    return C.join_anti_orphans(files, t.library, NOW)


NAMES = """SELECT DISTINCT CASE WHEN doc_id % 13 = 0 THEN 'Makefile' WHEN doc_id % 7 = 0 THEN 'note' || doc_id ELSE 'A.' || upper(lang) || '.' ||
    (['Txt','md','csv','tsv','py','pdf','DOCX','epub','pptm','xyz'])[%s] END AS name, CASE WHEN doc_id %% 3 = 0 THEN 'Text/Markdown' WHEN doc_id %% 3 = 1 THEN 'application/pdf' END AS mime FROM documents"""


@query("join_broadcast_format", """
    WITH n AS (SELECT DISTINCT CASE WHEN doc_id % 13 = 0 THEN 'Makefile' WHEN doc_id % 7 = 0 THEN 'note' || doc_id ELSE 'A.' || upper(lang) || '.' ||
                      (['Txt','md','csv','tsv','py','pdf','DOCX','epub','pptm','xyz'])[doc_id % 10 + 1] END AS name,
                      CASE WHEN doc_id % 3 = 0 THEN 'Text/Markdown' WHEN doc_id % 3 = 1 THEN 'application/pdf' END AS mime FROM documents)
    SELECT name, mime, CASE WHEN name = 'Makefile' THEN 'CODE' WHEN name LIKE '%.Txt' THEN 'TEXT' WHEN name LIKE '%.md' THEN 'MARKDOWN' WHEN name LIKE '%.csv' OR name LIKE '%.tsv' THEN 'CSV'
           WHEN name LIKE '%.py' THEN 'CODE' WHEN name LIKE '%.pdf' THEN 'PDF' WHEN name LIKE '%.DOCX' THEN 'DOCX' WHEN name LIKE '%.epub' THEN 'EPUB' WHEN name LIKE '%.pptm' THEN 'PPTX'
           WHEN mime = 'Text/Markdown' THEN 'MARKDOWN' WHEN mime = 'application/pdf' THEN 'PDF' ELSE 'UNKNOWN' END AS format FROM n""")
def _(t):
    return C.join_broadcast_format(file_names(t))


def file_names(t):
    d = F.col("doc_id")
    exts = F.array(*map(F.lit, ["Txt", "md", "csv", "tsv", "py", "pdf", "DOCX", "epub", "pptm", "xyz"]))
    name = F.when(d % 13 == 0, "Makefile").when(d % 7 == 0, F.concat(F.lit("note"), d)).otherwise(F.concat(F.lit("A."), F.upper("lang"), F.lit("."), F.element_at(exts, (d % 10 + 1).cast("int"))))
    return t.documents.select(name.alias("name"), F.when(d % 3 == 0, "Text/Markdown").when(d % 3 == 1, "application/pdf").alias("mime")).distinct()


@query("F1", """
    WITH n AS (SELECT DISTINCT 'f' || doc_id AS base, CASE WHEN doc_id % 2 = 0 THEN 'APPLICATION/EPUB+ZIP' END AS mime,
                      (['', '.log', '.TSV', '.docm', '.ps1', '.ott'])[doc_id % 6 + 1] AS ext FROM documents)
    SELECT base || ext AS name, CASE ext WHEN '.log' THEN 'TEXT' WHEN '.TSV' THEN 'CSV' WHEN '.docm' THEN 'DOCX' WHEN '.ps1' THEN 'CODE' WHEN '.ott' THEN 'ODT'
           ELSE CASE WHEN mime IS NULL THEN 'UNKNOWN' ELSE 'EPUB' END END AS format FROM n""")
def _(t):
    d = F.col("doc_id")
    name = F.concat(F.lit("f"), d, F.element_at(F.array(*map(F.lit, ["", ".log", ".TSV", ".docm", ".ps1", ".ott"])), (d % 6 + 1).cast("int")))
    return t.documents.select(name.alias("name"), formats.detect(name, F.when(d % 2 == 0, "APPLICATION/EPUB+ZIP")).alias("format"))


@query("F2", "SELECT id, format_group FROM library", LIB)
def _(t):
    return t.library.select("id", "format_group")


@query("F23", """
    WITH l AS (SELECT id, format, (['text/plain', 'application/octet-stream', ' image/png ', NULL, '*/*', ''])[id % 6 + 1] AS reported FROM library),
         m AS (SELECT *, CASE format WHEN 'PDF' THEN 'application/pdf' WHEN 'MARKDOWN' THEN 'text/markdown' WHEN 'TEXT' THEN 'text/plain' WHEN 'CSV' THEN 'text/csv'
                  WHEN 'DOCX' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'EPUB' THEN 'application/epub+zip'
                  WHEN 'PPTX' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' END AS own FROM l)
    SELECT id, CASE WHEN coalesce(trim(reported), '') IN ('', 'application/octet-stream', '*/*') THEN coalesce(own, '*/*')
                    WHEN reported = 'text/plain' AND own <> 'text/plain' THEN own ELSE trim(reported) END AS mime FROM m""", LIB)
def _(t):
    reported = F.element_at(F.array(*[F.lit(x) for x in ["text/plain", "application/octet-stream", " image/png ", None, "*/*", ""]]), (F.col("id") % 6 + 1).cast("int"))
    return t.library.select("id", formats.share_type(F.col("format"), reported).alias("mime"))


@query("join_regrant_match", """
    WITH p AS (SELECT id AS pick_id, CASE WHEN id % 50 = 0 THEN ' ' ELSE 'file' || (id // 8) END AS name, CASE WHEN id % 4 = 0 THEN 'CODE' WHEN id % 4 = 1 THEN 'UNKNOWN' ELSE format END AS picked FROM library),
         l AS (SELECT id, 'file' || (id // 8) AS title, format FROM library),
         q AS (SELECT pick_id, CASE WHEN trim(name) = '' THEN 'untitled' ELSE name END AS title, picked FROM p)
    SELECT l.id, q.pick_id FROM l JOIN q USING (title)
    WHERE l.format = picked OR (l.format = 'UNKNOWN' AND picked = 'CODE') OR (l.format = 'CODE' AND picked IN ('UNKNOWN', 'CSV'))""", LIB)
def _(t):
    """All documents picked again, names shared by eight of them."""
    i = F.col("id")
    rows = t.library.withColumn("title", F.concat(F.lit("file"), F.floor(i / 8)))
    picks = rows.select(
        i.alias("pick_id"), F.when(i % 50 == 0, " ").otherwise(F.col("title")).alias("name"),
        F.when(i % 4 == 0, "CODE").when(i % 4 == 1, "UNKNOWN").otherwise(F.col("format")).alias("format"),
    )
    return C.join_regrant_match(rows, picks)


@query("join_rect_touch", """
    WITH b AS (SELECT event_id AS selection_id, document_id, unit % 5 AS page, fraction / 2 + 0.1 AS l, fraction / 2 + 0.2 AS r, unit / 50.0::DOUBLE AS t, unit / 50.0::DOUBLE + 0.03 AS b
               FROM samples)
    SELECT DISTINCT b.selection_id, h.id FROM highlights h JOIN b USING (document_id, page)
    WHERE h.l < b.r AND b.l < h.r AND (b.t + b.b) / 2 BETWEEN h.t AND h.b""", "samples highlights")
def _(t):
    v, u = F.col("fraction"), F.col("unit") / 50.0
    boxes = t.samples.select(
        F.col("event_id").alias("selection_id"), "document_id", (F.col("unit") % 5).alias("page"), (v / 2 + 0.1).alias("l"), (v / 2 + 0.2).alias("r"), u.alias("t"), (u + 0.03).alias("b")
    )
    return C.join_rect_touch(t.highlights, boxes)


@query("join_selection_pages", """
    WITH s AS (SELECT event_id AS selection_id, unit AS p0, unit % 7 AS i0, unit + event_id % 4 AS p1, unit % 9 AS i1 FROM samples),
         e AS (SELECT *, unnest(range(p0, p1 + 1)) AS page FROM s)
    SELECT selection_id, page, CASE WHEN page = p0 THEN i0 ELSE 0 END AS "from", CASE WHEN page = p1 THEN i1 ELSE -1 END AS "to" FROM e""", "samples")
def _(t):
    u = F.col("unit")
    return C.join_selection_pages(t.samples.select(
        F.col("event_id").alias("selection_id"), u.alias("start_page"), (u % 7).alias("start_index"), (u + F.col("event_id") % 4).alias("end_page"), (u % 9).alias("end_index")
    ))


@query("join_outline_target", """
    WITH nav AS (SELECT page_id AS pos, 'Ch' || (page_id % 40) AS path, CASE WHEN page_id % 3 = 0 THEN 's' || (page_id % 5) ELSE '' END AS fragment, page_id % 3 AS depth, 't' || page_id AS title FROM pages),
         a AS (SELECT DISTINCT 'Ch' || (page_id % 30) AS path, 's' || (page_id % 4) AS fragment, (page_id % 30) * 100 + page_id % 4 AS block_no FROM pages
               UNION ALL SELECT DISTINCT 'CH' || (page_id % 20), '', (page_id % 20) * 100 + 50 FROM pages),
         f AS (SELECT lower(path) AS lp, min(block_no) AS block_no FROM a WHERE fragment = '' GROUP BY 1),
         s AS (SELECT DISTINCT 'ch' || (page_id % 35) AS path, (page_id % 35) * 100 AS block_no FROM pages)
    SELECT nav.pos, coalesce(a.block_no, f.block_no, s.block_no, -1)::BIGINT AS target, nav.depth, nav.title FROM nav
    LEFT JOIN a ON a.path = nav.path AND a.fragment = nav.fragment LEFT JOIN f ON f.lp = lower(nav.path) LEFT JOIN s ON s.path = lower(nav.path)""")
def _(t):
    p = F.col("page_id")
    nav = t.pages.select(p.alias("pos"), F.concat(F.lit("Ch"), p % 40).alias("path"), F.when(p % 3 == 0, F.concat(F.lit("s"), p % 5)).otherwise("").alias("fragment"), (p % 3).alias("depth"), F.concat(F.lit("t"), p).alias("title"))
    anchors = t.pages.select(F.concat(F.lit("Ch"), p % 30).alias("path"), F.concat(F.lit("s"), p % 4).alias("fragment"), ((p % 30) * 100 + p % 4).alias("block_no")).distinct().union(
        t.pages.select(F.concat(F.lit("CH"), p % 20), F.lit(""), (p % 20) * 100 + 50).distinct()
    )
    starts = t.pages.select(F.concat(F.lit("ch"), p % 35).alias("path"), ((p % 35) * 100).alias("block_no")).distinct()
    return C.join_outline_target(nav, anchors, starts)


@query("join_exact_duplicates", "SELECT title, sha256(text) AS hash, count(*) AS n, min(id) AS first_id FROM copies GROUP BY title, strlen(text), sha256(text) HAVING count(*) > 1", "copies")
def _(t):
    return C.join_exact_duplicates(t.copies)


@query("join_reading_order", """
    WITH m AS (SELECT id AS item_id, id % 4 <> 0 AS linear FROM library WHERE id % 3 <> 0), s AS (SELECT (id * 37) % 1009 AS spine_no, id AS item_id FROM library)
    SELECT row_number() OVER (ORDER BY NOT linear, spine_no, item_id) AS pos, item_id FROM s JOIN m USING (item_id)""", LIB)
def _(t):
    i = F.col("id")
    manifest = t.library.where("id % 3 <> 0").select(i.alias("item_id"), (i % 4 != 0).alias("linear"))
    spine = t.library.select(((i * 37) % 1009).alias("spine_no"), i.alias("item_id"))
    joined = spine.join(manifest, "item_id")
    return C.ranked(joined, (~F.col("linear")).asc(), F.col("spine_no"), F.col("item_id")).select(F.col("rank").alias("pos"), "item_id")


@query("facet_groups", """
    SELECT format_group, sum(n)::BIGINT AS n FROM (SELECT format_group, count(*) AS n FROM library WHERE is_starred AND format_group IS NOT NULL GROUP BY 1
    UNION ALL SELECT * FROM (VALUES ('ODT', 0), ('TSV', 0))) GROUP BY 1""", LIB)
def _(t):
    return C.facet_groups(t.library.where("is_starred"), ["ODT", "TSV"])


@query("facet_counts", "SELECT format_group, is_starred, count(*) AS n, grouping_id(format_group, is_starred)::BIGINT AS grouping_id FROM library GROUP BY CUBE (format_group, is_starred)", LIB)
def _(t):
    return C.facet_counts(t.library)


@query("library_empty_flags", "SELECT count(*) = 0 AS is_empty, coalesce(bool_or(is_starred), false) AS has_starred FROM library", LIB)
def _(t):
    return C.library_empty_flags(t.library)


@query("index_state_counts", "SELECT coalesce(state, 'PENDING') AS state, count(*) AS n FROM library l LEFT JOIN document_text d ON d.document_id = l.id GROUP BY 1", "library document_text")
def _(t):
    return C.index_state_counts(t.library, t.document_text)


@query("shared_mime_type", "SELECT CASE WHEN id % 10 < 4 THEN id // 10 ELSE -(id // 100) * 10 - id % 10 END AS sel_id, CASE WHEN count(DISTINCT format) = 1 THEN min(format) ELSE '*/*' END AS type FROM library GROUP BY 1", LIB)
def _(t):
    return C.shared_mime_type(t.library.select(F.when(F.col("id") % 10 < 4, F.floor(F.col("id") / 10)).otherwise(-F.floor(F.col("id") / 100) * 10 - F.col("id") % 10).alias("sel_id"), F.col("format").alias("type")))


@query("marks_by_page", "SELECT document_id, page, list(id ORDER BY id)::VARCHAR AS marks FROM highlights GROUP BY 1, 2", "highlights")
def _(t):
    return C.marks_by_page(t.highlights).withColumn("marks", F.concat(F.lit("["), F.array_join(F.col("marks").cast("array<string>"), ", "), F.lit("]")))


@query("exportable_marks", "SELECT document_id, page, count(*) AS n_lists, round(sum(l), 6) AS left_sum FROM highlights WHERE kind = 1 GROUP BY 1, 2", "highlights")
def _(t):
    lists = C.exportable_marks(t.highlights)
    one = F.aggregate(F.flatten("rect_lists"), F.lit(0.0), lambda a, r: a + r["l"])
    return lists.select("document_id", "page", F.size("rect_lists").cast("long").alias("n_lists"), F.round(one, 6).alias("left_sum"))


for name, order in (("sort_last_opened", "last_opened_at DESC"), ("sort_date_added", "created_at DESC, last_opened_at DESC"), ("sort_size", "size_bytes DESC, last_opened_at DESC")):

    @query(name, f"SELECT id, row_number() OVER (ORDER BY {order}, id) AS rank FROM library", LIB)
    def _(t, sort=name.removeprefix("sort_")):
        return C.sort_by(t.library, sort)


NATURAL = """SELECT id, row_number() OVER (ORDER BY regexp_extract(title, '[0-9]+')::BIGINT %s, regexp_extract(title, '\\.(.*)$', 1) %s, last_opened_at DESC, id) AS rank FROM library"""


@query("sort_name_asc", NATURAL % ("ASC", "ASC"), LIB)
def _(t):
    return C.sort_by(t.library, "name_asc")


@query("sort_name_desc", NATURAL % ("DESC", "DESC"), LIB)
def _(t):
    return C.sort_by(t.library, "name_desc")


@query("sort_bookmarks", f"""
    SELECT s.event_id AS id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY unit, fraction, ts, event_id) AS rank
    FROM locations s JOIN library l ON l.id = s.document_id WHERE s.kind = {KIND}""", "library locations")
def _(t):
    marks = t.locations.select(F.col("event_id").alias("id"), "document_id", "kind", "unit", "fraction", F.col("ts").alias("created_at"))
    return C.sort_bookmarks(marks, t.library)


@query("limit_hits", """
    SELECT query_id, pos, n > 40 AS truncated FROM (SELECT document_id AS query_id, event_id AS pos, count(*) OVER (PARTITION BY document_id) AS n,
    row_number() OVER (PARTITION BY document_id ORDER BY event_id) AS r FROM samples) WHERE r <= 40""", "samples")
def _(t):
    return C.limit_hits(t.samples.select(F.col("document_id").alias("query_id"), F.col("event_id").alias("pos")), 40)


@query("union_ordered", """
    SELECT id, 0 AS part FROM library WHERE contains(title, '1.') UNION ALL
    SELECT doc_id, 1 FROM documents WHERE contains(text, 'ment') AND doc_id NOT IN (SELECT id FROM library WHERE contains(title, '1.'))""", LIB)
def _(t):
    named = t.library.where(F.contains("title", F.lit("1."))).select("id")
    return C.union_ordered(named, hits(t).join(named, "id", "left_anti"))


@query("set_difference_new", "SELECT id, size_bytes FROM library WHERE size_bytes <= 4096 AND NOT (id % 3 = 0 AND size_bytes % 2 = 0)", LIB)
def _(t):
    small = t.library.where("size_bytes <= 4096").select("id", "size_bytes")
    before = small.where("id % 3 = 0").select("id", (F.col("size_bytes") - F.col("size_bytes") % 2).alias("size_bytes"))
    return C.set_difference_new(before, small)


@query("set_intersect_present", "SELECT DISTINCT token AS id FROM removals WHERE token NOT IN (SELECT id FROM library WHERE is_starred)", "library removals")
def _(t):
    return C.set_intersect_present(t.removals.select(F.col("token").alias("id")).distinct(), t.library.where("is_starred"))


@query("distinct_first", "SELECT title AS key, min_by(id, created_at) AS value FROM library GROUP BY 1", LIB)
def _(t):
    return C.distinct_first(t.library.select(F.col("title").alias("key"), F.col("created_at").alias("pos"), F.col("id").alias("value")))


@query("keep_latest_n", "SELECT uri AS name FROM library ORDER BY uri DESC LIMIT 20", LIB)
def _(t):
    return C.keep_latest_n(t.library.select(F.col("uri").alias("name")))


@query("recent_k_working_set", """
    SELECT user_id, key, rank FROM (SELECT user_id, key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, key) AS rank
    FROM (SELECT user_id, event_id % 40 AS key, max(epoch_us(ts)) AS ts FROM events GROUP BY 1, 2)) WHERE rank <= 16""")
def _(t):
    return C.recent_k_working_set(t.events.select("user_id", (F.col("event_id") % 40).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")))


@query("unique_names", """
    SELECT id, CASE WHEN k = 0 THEN title ELSE split_part(title, '.', 1) || ' (' || k || ').' || split_part(title, '.', 2) END AS unique_name
    FROM (SELECT id, title, row_number() OVER (PARTITION BY title ORDER BY id) - 1 AS k FROM library)""", LIB)
def _(t):
    return C.unique_names(t.library.select("id", F.col("title").alias("name")))
