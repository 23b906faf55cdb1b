"""Queries of text functions and document-to-rows operators, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.functions import formats
from quireworks.functions import text as T
from quireworks.functions.encodings import LETTERS, PAGES
from quireworks.operators import texts as X
from quireworks.plans.legacy import guess_sql
from quireworks.plans.registry import query


def inline(t, rows, schema):
    """Inline cases next to every document: the id picks the case, so the work follows the table."""
    return t.documents.select("doc_id", *[
        F.element_at(F.array(*[F.lit(r[i]).cast(kind) for r in rows]), (F.col("doc_id") % len(rows) + 1).cast("int")).alias(name) for i, (name, kind) in enumerate(schema)
    ])


FIND = "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4)::BIGINT AS n FROM documents WHERE contains(lower(text), 'tion')"


@query("find_counts", FIND)
def _(t):
    return X.find_counts(t.documents, "tion")


PIECES = """
    p AS (SELECT doc_id, string_split(lower(text), 'tion') AS parts FROM documents),
    e AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, len(parts) AS n FROM p),
    o AS (SELECT doc_id, i, n, sum(length(part) + 4) OVER (PARTITION BY doc_id ORDER BY i) - 4 AS start FROM e)"""


@query("F12", f'WITH {PIECES} SELECT doc_id, (i - 1)::INT AS hit_no, start::INT AS start, (start + 4)::INT AS "end" FROM o WHERE i < n')
def _(t):
    return X.find_rows(t.documents, "tion")


@query("match_pages", """
    WITH b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
         n AS (SELECT doc_id, no AS page, ((length(line) - length(replace(lower(line), 'ment', ''))) / 4)::INT AS n FROM b WHERE no NOT IN (1, 3))
    SELECT doc_id, page::INT AS page, unnest(range(1, n + 1))::INT AS hit_no FROM n WHERE n > 0""")
def _(t):
    pages = X.line_rows(t.documents).select("doc_id", F.col("line_no").alias("page"), F.col("line").alias("text"))
    return X.match_pages(pages, "ment", [1, 3])


@query("corpus_feature_survey", """
    WITH s AS (SELECT count(*) AS a, count(*) FILTER (contains(html, '<table')) AS table_, count(*) FILTER (contains(html, '<script')) AS script, count(*) FILTER (contains(html, '<br>')) AS br,
                      count(*) FILTER (contains(html, '&quot;')) AS quote, count(*) FILTER (contains(html, '</body>')) AS closed FROM pages),
         r AS (SELECT unnest([{'f': 'table', 'n': table_}, {'f': 'script', 'n': script}, {'f': 'br', 'n': br}, {'f': 'quote', 'n': quote}, {'f': 'closed', 'n': closed}]) AS x, a FROM s)
    SELECT x.f AS feature, x.n AS n, round(x.n / a, 9) AS share, row_number() OVER (ORDER BY x.n DESC, x.f)::INT AS rank FROM r""")
def _(t):
    has = lambda s: F.contains("html", F.lit(s))
    found = X.corpus_feature_survey(t.pages, {"table": has("<table"), "script": has("<script"), "br": has("<br>"), "quote": has("&quot;"), "closed": has("</body>")})
    return found.withColumn("share", F.round("share", 9))


@query("line_stats", """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, len(l)::BIGINT AS lines, (len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END)::BIGINT AS numbered_lines,
           list_max(list_transform(l, lambda x: length(x) + 3 * (length(x) - length(replace(x, chr(9), '')))))::BIGINT AS max_columns FROM l""")
def _(t):
    return X.line_stats(t.documents)


def tokens(d):
    """SQL for a pattern that cuts text into cells (group 1) and what ends them (group 2)."""
    q = "\\|" if d == "|" else d
    return f"""'((?:"(?:[^"]|"")*(?:"[^{d}\\n]*)?|[^{d}"\\n][^{d}\\n]*)?)({q}|\\n|$)'"""


def sizes(d, no, text):
    """SQL for the field counts of a text's rows: a row is blank if it is one empty cell without quotes."""
    return f"""SELECT doc_id, {no} AS no, '{d}' AS d, line, count(*) AS fields FROM (
        SELECT doc_id, i, cell, count(*) FILTER (sep <> '{d}') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM (
          SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS cell, unnest(s) AS sep FROM (
            SELECT doc_id, regexp_extract_all({text}, {tokens(d)}, 1) AS c, regexp_extract_all({text}, {tokens(d)}, 2) AS s FROM documents)))
        GROUP BY doc_id, line HAVING count(*) > 1 OR max(cell) <> ''"""


@query("delimiter_mode", f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
         f AS ({" UNION ALL ".join(f"SELECT doc_id, {no} AS no, '{d}' AS d, len(list_filter(regexp_extract_all(line, {tokens(d)}, 2), lambda x: x = '{d}')) + 1 AS fields FROM l" for no, d in enumerate(",;|"))}),
         n AS (SELECT doc_id, no, d, fields, count(*) AS n FROM f GROUP BY ALL),
         m AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, no) AS rows, row_number() OVER (PARTITION BY doc_id, no ORDER BY n DESC, fields DESC) AS r FROM n)
    SELECT doc_id, no, d AS delimiter, fields, round(n / rows, 9) AS share FROM m WHERE r = 1""")
def _(t):
    return X.delimiter_mode(X.line_rows(t.documents), ",;|").withColumn("share", F.round("share", 9))


@query("F10", f"""
    WITH f AS ({" UNION ALL ".join(sizes(d, no, "CASE WHEN length(text) > 65536 AND contains(left(text, 65536), chr(10)) THEN regexp_replace(left(text, 65536), chr(10) || '[^' || chr(10) || ']*$', '') ELSE left(text, 65536) END") for no, d in enumerate([",", ";", chr(9), "|"]))}),
         g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY line) AS k FROM f) WHERE k <= 50),
         n AS (SELECT doc_id, no, d, fields, count(*) AS n FROM g GROUP BY ALL),
         m AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, no) AS rows, row_number() OVER (PARTITION BY doc_id, no ORDER BY n DESC, fields DESC) AS r FROM n),
         b AS (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY n / rows DESC, no) AS r FROM m WHERE r = 1 AND fields >= 2)
    SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN chr(9) ELSE coalesce(d, ',') END AS delimiter FROM documents LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (doc_id)""")
def _(t):
    name = F.when(F.col("doc_id") % 10 == 3, "A.TSV").otherwise("a.csv")
    return t.documents.select("doc_id", X.sniff_delimiter(name, F.col("text")).alias("delimiter"))


CELL = "CASE WHEN starts_with(cell, '\"') THEN replace(regexp_extract(cell, '(?s)^\"((?:[^\"]|\"\")*)(?:\"|$)', 1), '\"\"', '\"') || regexp_replace(cell, '(?s)^\"(?:[^\"]|\"\")*(?:\"|$)', '') ELSE cell END"


#: The caps are the reference's own: DelimitedFile.kt:9 (cells), 12 (columns), 15 (signs of a cell), and 176-180, by which the row that reaches the cells is kept
@query("F11", f"""
    WITH c AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS cell, unnest(s) AS sep FROM (
            SELECT doc_id, regexp_extract_all(text, {tokens(",")}, 1) AS c, regexp_extract_all(text, {tokens(",")}, 2) AS s FROM documents)),
         r AS (SELECT *, count(*) FILTER (sep <> ',') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM c),
         k AS (SELECT *, count(*) OVER w AS n, max(cell) OVER w AS most, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) - 1 AS col_no FROM r WINDOW w AS (PARTITION BY doc_id, line)),
         v AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS row_no, col_no, {CELL} AS value, n,
                  count(*) FILTER (col_no < 1024) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k WHERE n > 1 OR most <> ''),
         t AS (SELECT *, max(n) OVER (PARTITION BY doc_id) > 1024 OR max(before) OVER (PARTITION BY doc_id) >= 200000 AS truncated FROM v)
    SELECT doc_id, row_no::INT AS row_no, col_no::INT AS col_no, CASE WHEN length(value) > 10000 THEN left(value, 10000) || '…' ELSE value END AS value, truncated FROM t WHERE col_no < 1024 AND before < 200000""")
def _(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("path"), "text", F.lit(",").alias("delimiter"))
    return X.delimited_cells(rows).select(F.col("path").cast("long").alias("doc_id"), "row_no", "col_no", "value", "truncated")


ENC = "CASE doc_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' WHEN 2 THEN 'UTF-16BE' ELSE CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'windows-1252' ELSE 'UTF-8' END END"


def encoded(t):
    d = F.col("doc_id") % 4
    return t.documents.select(
        F.col("doc_id").cast("string").alias("path"),
        F.when(d == 0, F.encode("text", "UTF-8")).when(d == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(d == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.encode("text", "ISO-8859-1")).alias("content"),
    )


@query("F9", f"SELECT doc_id, {ENC} AS encoding FROM documents")
def _(t):
    return encoded(t).select(F.col("path").cast("long").alias("doc_id"), X.decoded(F.col("content"))[0].alias("encoding"))


#: Letters of documents by their frequency in English, and what stands for them in each legacy encoding
OFTEN = "etaoinshrdlcumwfgypbvkxjqz"
LEGACY = [("windows-1251", LETTERS["Russian"][:26]), ("KOI8-R", LETTERS["Russian"][:26]), ("windows-1253", LETTERS["Greek"][:26])]


#: Bytes of a few words do not tell what they were written in, so the SQL states the guess, not the page they are from
@query("F9_legacy", guess_sql(OFTEN, LEGACY))
def _(t):
    """Documents in Cyrillic and Greek letters, read from bytes of code pages that nothing names."""
    text = F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "")
    content = F.lit(None).cast("binary")
    for i, (name, letters) in enumerate(LEGACY):
        content = F.when(F.col("doc_id") % 3 == i, F.encode(F.translate(text, OFTEN, letters.encode(PAGES[name][0]).decode("latin-1")), "ISO-8859-1")).otherwise(content)
    encoding, read = X.decoded(F.col("content"))
    return t.documents.select("doc_id", content.alias("content")).select("doc_id", encoding.alias("encoding"), read.alias("text"))


#: A null text is no bytes, and control signs of ISO 8859-1 are bytes that windows-1252 reads as other signs
@query("read_text_corpus", f"""
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN {ENC} END AS encoding,
        left(CASE WHEN doc_id % 4 = 3 THEN translate(text, '{T.WINDOWS[0]}', '{T.WINDOWS[1]}') ELSE text END, 1000000) AS text, length(text) > 1000000 AS truncated FROM documents""")
def _(t):
    return X.from_bytes(encoded(t)).select(F.col("path").cast("long").alias("doc_id"), "encoding", "text", "truncated")


@query("read_delimited_corpus", """
    WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '"', ' ', 'g'), chr(10)) AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS line FROM l)
    SELECT doc_id, count(*) AS n_rows, sum(length(line) - length(replace(line, '|', '')) + 1 + 1)::BIGINT AS n_cells FROM r WHERE line <> '' GROUP BY 1""")
def _(t):
    """Every document as a .tsv file of two columns: the line's number of signs, and the line."""
    lines = X.line_rows(t.documents.withColumn("text", F.replace("text", F.lit('"'), F.lit(" ")))).where("line <> ''")
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.length("line").alias("n"), "line"))), lambda x: F.concat(x["n"].cast("string"), F.lit("\t"), F.replace(x["line"], F.lit("|"), F.lit("\t")))), "\n").alias("text"))
    named = body.select(F.concat(F.col("doc_id").cast("string"), F.lit(".tsv")).alias("path"), "text")
    cells = X.delimited_cells(named.withColumn("delimiter", X.sniff_delimiter(F.col("path"), F.col("text"))))
    return cells.groupBy(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("doc_id")).agg(F.count_distinct("row_no").alias("n_rows"), F.count("*").alias("n_cells"))


@query("read_html_pages", "SELECT page_id, url, length(html)::BIGINT AS n FROM pages")
def _(t):
    return X.read_html_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("write_redacted", "SELECT doc_id AS id, regexp_replace(text, 'src[0-9].*', '[redacted]', 'g') AS text FROM (SELECT doc_id, source || ' ' || text AS text FROM documents ORDER BY doc_id DESC LIMIT 20)")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), "text").alias("text"))
    return X.redacted_rows(rows, "text", [f"src{i}" for i in range(10)])


@query("F6", r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '/home/ann.*', '[redacted]', 'g'), 'content://\S+', '[redacted]', 'g'), 'file://.*', '[redacted]', 'g'),
           '\S*imports/.*', '[redacted]', 'g'), '(^|[^\w])/(?:storage|sdcard|mnt|data|cache)/[^\r\n]*', '\1[redacted]', 'g') AS text
    FROM (SELECT doc_id, (['at /storage/emulated/0/My File.pdf ', 'from content://media/1 ', 'see file:///a b c ', 'app/imports/x y ', 'rel data/cache/ok ', '/home/ann/x '])[doc_id % 6 + 1] || text AS t FROM documents)""")
def _(t):
    leads = ["at /storage/emulated/0/My File.pdf ", "from content://media/1 ", "see file:///a b c ", "app/imports/x y ", "rel data/cache/ok ", "/home/ann/x "]
    lead = F.element_at(F.array(*map(F.lit, leads)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", T.redact(F.concat(lead, F.col("text")), ["/home/ann"]).alias("text"))


@query("F3", "SELECT doc_id, doc_id % 5 NOT IN (1, 2, 3) AS is_text FROM documents")
def _(t):
    d, body = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    data = F.when(d == 1, F.concat(F.unhex(F.lit("504B0304")), body)).when(d == 2, F.concat(F.encode(F.left("text", F.lit(20)), "UTF-8"), F.unhex(F.lit("00")), body)).when(d == 3, F.unhex(F.repeat(F.hex(F.concat(F.lit("a"), F.chr(F.lit(1)))), F.lit(9)))).otherwise(body)
    return t.documents.select("doc_id", T.looks_like_text(data).alias("is_text"))


@query("F4", "SELECT kind, count(*) AS n FROM (SELECT 'MARKUP' AS kind FROM pages UNION ALL SELECT (['PYTHON', 'MARKUP', 'JSON', 'JSONC', 'JSON5', NULL, 'SHELL'])[doc_id % 7 + 1] FROM documents) GROUP BY 1")
def _(t):
    """Every document's whole text behind a head of each kind; in JSON it is a string."""
    string = F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|\}$', "")
    text = F.col("text")
    made = [
        F.concat(F.lit("#!/usr/bin/env -S python3.11 -u\n"), text), F.concat(F.lit("<!-- c --><svg:svg>"), text), F.concat(F.lit('{"u": "http://x", "v": '), string, F.lit("}")),
        F.concat(F.lit('// c\n{"a": '), string, F.lit(",}")), F.concat(F.lit("{a: 'b', c: "), string, F.lit("}")), F.concat(F.lit("x "), text), F.concat(F.lit("#!/bin/bash\n"), text),
    ]
    picked = F.element_at(F.array(*made), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = t.pages.select(F.col("html").alias("head")).union(t.documents.select(picked))
    return rows.groupBy(T.content_kind(F.col("head"), F.lit("txt")).alias("kind")).agg(F.count("*").alias("n"))


@query("F5", "SELECT id, format <> 'CODE' AND title NOT LIKE '%.log' AS is_prose FROM library", "library")
def _(t):
    return t.library.select("id", T.is_prose(F.col("title"), F.col("format") == "CODE").alias("is_prose"))


@query("F7", r"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\w.%+-]+@(?:[[:alnum:]-]+\.)+[[:alpha:]]{2,}')) AS a FROM documents)
    SELECT doc_id, 'mailto:' || a AS destination, count(*) AS n FROM m GROUP BY 1, 2
    UNION ALL SELECT -page_id - 1, regexp_replace(url, '[.,]+$', ''), 1 FROM pages""")
def _(t):
    rows = t.documents.select("doc_id", "text").union(t.pages.select(-F.col("page_id") - 1, F.concat(F.lit("see ("), "url", F.lit(").")))) 
    links = rows.select("doc_id", F.explode(T.autolinks(F.col("text"))).alias("a"))
    return links.groupBy("doc_id", F.col("a.destination").alias("destination")).agg(F.count("*").alias("n"))


HREF = """
    a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages),
    h AS (SELECT page_id, replace(regexp_extract(tag, 'href="([^"]*)"', 1), '&amp;', '&') AS href, tag FROM a)"""


@query("F8", f"""WITH {HREF}, u AS (SELECT url AS u FROM pages UNION ALL SELECT href FROM h UNION ALL SELECT 'JavaScript:x' || page_id FROM pages UNION ALL SELECT ' example' || page_id || '.org/a ' FROM pages)
    SELECT CASE WHEN u LIKE 'http%' THEN u WHEN trim(u) LIKE 'example%' THEN 'https://' || trim(u) WHEN u LIKE 'JavaScript:%' THEN NULL WHEN contains(split_part(u, '/', 1), '.') THEN 'https://' || u END AS link, count(*) AS n FROM u GROUP BY 1""")
def _(t):
    hrefs = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>.*?</a>'), F.lit(1))).alias("u"))
    p = t.pages.select(F.explode(F.array(F.col("url"), F.concat(F.lit("JavaScript:x"), "page_id"), F.concat(F.lit(" example"), "page_id", F.lit(".org/a ")))).alias("u"))
    rows = p.union(hrefs.select(F.replace("u", F.lit("&amp;"), F.lit("&"))))
    return rows.groupBy(T.safe_link(F.col("u")).alias("link")).agg(F.count("*").alias("n"))


@query("F13", "SELECT doc_id, 2 AS n, doc_id % 50 / 100.0::DOUBLE AS first_left, 0.5 AS last_bottom FROM documents")
def _(t):
    packed = F.concat(((F.col("doc_id") % 50) / 100).cast("string"), F.lit(",0.1,0.2,0.3;1,2,3;x,1,2,3;;0.1,0.2, 0.4 ,0.5"))
    rects = T.decode_rects(packed)
    return t.documents.select("doc_id", F.size(rects).alias("n"), F.element_at(rects, 1)["l"].alias("first_left"), F.element_at(rects, -1)["b"].cast("decimal(2,1)").alias("last_bottom"))


#: For each letter of a number, from the seventh (enough for 32 bits) to the last: its place and the least number that has it
LEAST = [(k, (26 ** (k + 1) - 1) // 25) for k in range(6, -1, -1)]


@query("F15", f"""
    WITH n AS (SELECT doc_id::INT AS n FROM documents),
         r AS (SELECT n, (['','m','mm','mmm'])[n // 1000 % 10 + 1] || (['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'])[n // 100 % 10 + 1] || (['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'])[n // 10 % 10 + 1]
                  || (['','i','ii','iii','iv','v','vi','vii','viii','ix'])[n % 10 + 1] AS roman,
                  {" || ".join(f"CASE WHEN n >= {least} THEN chr((97 + (n - {least}) // {26**k} % 26)::INT) ELSE '' END" for k, least in LEAST)} AS letters FROM n)
    SELECT n, CASE WHEN n < 1 THEN n::VARCHAR ELSE letters END AS letter, upper(CASE WHEN n BETWEEN 1 AND 3999 THEN roman ELSE n::VARCHAR END) AS roman, CASE WHEN n BETWEEN 0 AND 9 THEN '0' || n ELSE n::VARCHAR END AS zero FROM r""")
def _(t):
    n = F.col("doc_id").cast("int")
    return t.documents.select(n.alias("n"), *[T.list_number(n, F.lit(f)).alias(a) for f, a in (("lowerLetter", "letter"), ("upperRoman", "roman"), ("decimalZero", "zero"))])


@query("F16", r"SELECT doc_id, coalesce(nullif(trim(left(trim(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END, '\s+', ' ', 'g')), 80)), ''), 'Untitled') AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", T.clean_label(F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text")), F.lit("Untitled")).alias("label"))


CLAMP = """c AS (SELECT event_id, document_id, kind, unit, fraction, (document_id % 30)::BIGINT AS n, least(greatest(unit, 0), greatest(document_id % 30 - 1, 0)) AS u FROM locations),
    k AS (SELECT *, CASE WHEN kind = 3 OR u <> unit THEN 0.0::DOUBLE ELSE fraction END AS f FROM c),
    p AS (SELECT *, CASE WHEN n <= 0 THEN 0.0::DOUBLE ELSE least(greatest((CASE WHEN kind = 3 THEN u::DOUBLE ELSE u + f END) / n, 0), 1) END AS progress FROM k)"""


def located(t):
    return t.locations.withColumn("n", F.col("document_id") % 30), [F.col(c) for c in ("kind", "unit", "fraction", "n")]


@query("F17", f"WITH {CLAMP} SELECT event_id, u AS unit, round(f, 9) AS fraction FROM k", "locations")
def _(t):
    rows, args = located(t)
    u, f = T.clamp_location(*args)
    return rows.select("event_id", u.alias("unit"), F.round(f, 9).alias("fraction"))


@query("F18", f"WITH {CLAMP} SELECT kind, round(avg(CASE WHEN event_id % 100 = 0 THEN 1.0 ELSE progress END), 9) AS progress, count(*) AS n FROM p GROUP BY 1", "locations")
def _(t):
    rows, args = located(t)
    p = T.reading_progress(*args, F.col("event_id") % 100 == 0)
    return rows.withColumn("p", p).groupBy("kind").agg(F.round(F.avg("p"), 9).alias("progress"), F.count("*").alias("n"))


@query("F19", f"WITH {CLAMP} SELECT event_id, CASE kind WHEN 0 THEN 'PAGE' WHEN 1 THEN 'LINE' ELSE 'PERCENT' END AS kind, (CASE kind WHEN 0 THEN u + 1 WHEN 1 THEN u * 40 + least(floor(f * 40), 39) + 1 ELSE floor(progress * 100 + 0.5) END)::BIGINT AS number FROM p", "locations")
def _(t):
    rows, args = located(t)
    kind, number = T.location_summary(*args)
    return rows.select("event_id", kind.alias("kind"), number.alias("number"))


@query("F20", """
    WITH l AS (SELECT *, lag(kind) OVER w AS k2, lag(unit) OVER w AS u2, lag(fraction) OVER w AS f2 FROM locations WINDOW w AS (PARTITION BY document_id, kind ORDER BY unit, fraction, event_id))
    SELECT event_id, CASE kind WHEN 0 THEN unit = u2 WHEN 1 THEN unit = u2 AND abs(fraction - f2) <= 0.05 WHEN 2 THEN unit = u2 AND abs(fraction - f2) <= 0.1 ELSE abs(unit - u2) <= 100 END AS same
    FROM l WHERE k2 IS NOT NULL""", "locations")
def _(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("document_id", "kind").orderBy("unit", "fraction", "event_id")
    rows = t.locations.withColumns({c + "2": F.lag(c).over(w) for c in ("kind", "unit", "fraction")}).where("kind2 is not null")
    return rows.select("event_id", T.same_spot(*[F.col(c) for c in ("kind", "unit", "fraction", "kind2", "unit2", "fraction2")]).alias("same"))


@query("F21", """
    WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, (doc_id % 70)::BIGINT AS line FROM documents)
    SELECT doc_id, CASE WHEN line BETWEEN 1 AND n THEN (line - 1) // 40 END AS chunk, CASE WHEN line BETWEEN 1 AND n THEN (line - 1) % 40 END AS line_in_chunk,
           CASE WHEN line BETWEEN 1 AND n THEN line END AS back FROM l""")
def _(t):
    n = F.size(T.lines(F.col("text"))).cast("long")
    at = T.go_to_line(F.col("doc_id") % 70, n)
    return t.documents.select("doc_id", at["chunk"].alias("chunk"), at["line"].alias("line_in_chunk"), T.line_at(at["chunk"], at["fraction"], n).alias("back_at"), at.alias("at")).select(
        "doc_id", "chunk", "line_in_chunk", F.when(F.col("at").isNotNull(), F.col("back_at")).alias("back")
    )


@query("F22", r"""
    WITH b AS (SELECT doc_id, regexp_replace(coalesce(string_split(text, chr(10))[doc_id % 6 + 1], ''), '^\s+', '') AS b FROM documents)
    SELECT doc_id, rtrim(left(b, 32)) || CASE WHEN length(b) > 32 THEN '…' ELSE '' END AS snippet FROM b""")
def _(t):
    return t.documents.select("doc_id", T.line_snippet(F.col("text"), (F.col("doc_id") % 6).cast("int")).alias("snippet"))


@query("F24", """
    SELECT doc_id, (['a b' || doc_id || '.txt', 'dir name.pdf', 'seg' || doc_id || '.epub', 'imported-' || doc_id || '.md', 'v1.', 'x.y'])[doc_id % 6 + 1] AS name_ FROM documents""".replace("'v1.'", "'v1.pdf'"))
def _(t):
    d = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*xs), (d % 6 + 1).cast("int"))
    display = pick(F.concat(F.lit("a/b"), d, F.lit(".txt")), F.lit("\x01dir\\name.."), F.lit(" . "), F.lit(None), F.lit("v1.."), F.lit("x.y"))
    segment = pick(F.lit("z"), F.lit("z"), F.concat(F.lit("seg"), d), F.lit("  "), F.lit("z"), F.lit("z"))
    mime = pick(F.lit("application/pdf"), F.lit("application/pdf"), F.lit("application/epub+zip"), F.lit("text/markdown"), F.lit("application/pdf"), F.lit("application/pdf"))
    display = F.when(d % 6 == 2, F.lit("...")).otherwise(display)
    return t.documents.select("doc_id", T.import_file_name(display, segment, mime, d).alias("name_"))


@query("F25", f"""WITH {HREF}, r AS (SELECT page_id, href, regexp_replace(regexp_replace(href, '#.*$', ''), '[?].*$', '') AS raw FROM h)
    SELECT page_id, href, CASE WHEN raw <> '' THEN nullif(ltrim(CASE WHEN starts_with(raw, '/') THEN raw ELSE 'base/' || raw END, '/'), '') END AS path, ('bk/' || page_id || '/b.html') AS other FROM r""")
def _(t):
    rows = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>.*?</a>'), F.lit(1))).alias("href"))
    rows = rows.withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
    other = T.resolve_path(F.concat(F.lit("bk/x/"), "page_id", F.lit("/c/")), F.concat(F.lit("../../../"), "page_id", F.lit("/./a/../b%2Ehtml#f")))
    return rows.select("page_id", "href", T.resolve_path(F.lit("base/"), F.col("href")).alias("path"), other.alias("other"))


@query("F26", "SELECT id, id % 5 = 0 AS safe FROM library", "library")
def _(t):
    lead = F.element_at(F.array(*map(F.lit, ["a/b..c/", "/", "C:", "x/../", "a\\..\\"])), (F.col("id") % 5 + 1).cast("int"))
    return t.library.select("id", T.safe_entry_name(F.concat(lead, "title")).alias("safe"))


@query("F27", """
    SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS whole, format('{:.2f}', (round(o_totalprice * 100)::BIGINT / 100)::DOUBLE) AS two, '$' || format('{:,}', floor(o_totalprice)::BIGINT) AS money,
           format('{:.0f}', floor(o_totalprice) * 100) || '%' AS pct, format('{:,}', floor(o_totalprice)::BIGINT) || '€' AS euro, floor(o_totalprice)::BIGINT::VARCHAR AS general,
           strftime(DATE '1899-12-30' + (o_orderkey % 50000)::INT, '%Y-%m-%d') AS day FROM orders""")
def _(t):
    whole, v = F.floor("o_totalprice").cast("double"), F.round("o_totalprice", 2)
    n = T.number_format
    return t.read("orders").select(
        "o_orderkey", n(whole, "#,##0").alias("whole"), n(v, "0.00").alias("two"), n(whole, "$#,##0").alias("money"), n(whole, "0.0%").alias("pct"),
        n(whole, "#,##0 €").alias("euro"), n(whole, "General").alias("general"), n((F.col("o_orderkey") % 50000).cast("double"), "yyyy-mm-dd").alias("day"),
    )


@query("F28", """SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') || '€A' AS text FROM pages""")
def _(t):
    return t.pages.select("page_id", T.decode_entities(F.concat("html", F.lit("&#8364;&#x41;"))).alias("text"))


@query("F29", FIND)
def _(t):
    """Needles are normalised once: full-width letters and runs of space find plain text."""
    return X.find_counts(t.documents, "  ｔｉｏｎ ")


@query("F30", r"""
    WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*\s*|[.!?]+\s*')) AS s FROM documents)
    SELECT doc_id, count(*) AS n, sum(length(regexp_replace(s, '\s+$', '')))::BIGINT AS chars FROM s WHERE regexp_replace(s, '\s+$', '') <> '' GROUP BY 1""")
def _(t):
    rows = t.documents.select("doc_id", F.explode(T.sentence_bounds(F.col("text"))).alias("r"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("r.end") - F.col("r.start")).alias("chars"))


CHUNKS = """
    l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    chunks AS (SELECT doc_id, no // 40 AS chunk_no, string_agg(line, chr(10) ORDER BY no) AS text FROM l GROUP BY 1, 2)"""


@query("D1", f"WITH {CHUNKS} SELECT * FROM chunks")
def _(t):
    return X.chunk_lines(t.documents)


@query("chunk_line_numbers", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_no * 40 + 1 AS first_line FROM chunks")
def _(t):
    return X.chunk_line_numbers(X.chunk_lines(t.documents))


@query("chunk_offsets", f"WITH {CHUNKS} SELECT doc_id, chunk_no, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM chunks")
def _(t):
    return X.chunk_offsets(t.documents).select("doc_id", "chunk_no", "start_offset")


BROKEN = "regexp_replace(text, '\\. ', '.' || chr(10) || chr(10), 'g')"


def broken(t):
    """Sentences as paragraphs, because the documents have no blank lines."""
    return t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


@query("D2", f"""
    WITH s AS (SELECT doc_id, string_split({BROKEN}, chr(10) || chr(10)) AS x FROM documents),
         e AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM s),
         o AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS s FROM e)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no, s::BIGINT AS start, (s + length(p))::BIGINT AS "end", replace(p, chr(10), ' ') AS text FROM o WHERE trim(p) <> ''""")
def _(t):
    return X.paragraph_units(broken(t))


UNITS = f"""{CHUNKS}, u AS (SELECT doc_id, chunk_no AS anchor, replace(text, chr(10), ' ') AS text FROM chunks WHERE trim(text) <> '')"""


@query("D3", f"WITH {UNITS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY anchor) - 1 AS unit_no, anchor, 0::BIGINT AS start, text FROM u")
def _(t):
    return X.speakable_units(t.documents)


@query("D3_markdown", f"""
    WITH s AS (SELECT doc_id, string_split({BROKEN}, chr(10) || chr(10)) AS x FROM documents),
         e AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM s),
         o AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS s FROM e)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit_no, s::BIGINT AS anchor, 0::BIGINT AS start, replace(p, chr(10), ' ') AS text FROM o WHERE trim(p) <> ''""")
def _(t):
    return X.speakable_markdown(broken(t))


@query("unit_prefix_counts", f"""
    WITH {CHUNKS}, n AS (SELECT doc_id, max(chunk_no) + 1 AS n FROM chunks GROUP BY 1)
    SELECT doc_id, unnest(range(0, n + 1)) AS chunk_no, unnest(range(0, n + 1)) AS first_unit FROM n""")
def _(t):
    return X.unit_prefix_counts(X.speakable_units(t.documents), X.chunk_lines(t.documents))


@query("join_asof_unit", """
    WITH u AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS unit_no, (generate_subscripts(x, 1) - 1) * 25 AS spot FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
         l AS (SELECT event_id, document_id AS doc_id, unit * 7 AS p, kind FROM locations)
    SELECT l.event_id AS location_id, CASE WHEN kind = 3 THEN coalesce(max(unit_no) FILTER (spot <= p), 0) ELSE coalesce(min(unit_no) FILTER (spot >= p), max(unit_no)) END AS unit_no FROM l JOIN u USING (doc_id) GROUP BY l.event_id, kind""", "locations")
def _(t):
    units = X.line_rows(t.documents).select("doc_id", F.col("line_no").cast("long").alias("unit_no"), (F.col("line_no") * 25).cast("long").alias("anchor"))
    at = t.locations.select(F.col("event_id").alias("location_id"), F.col("document_id").alias("doc_id"), (F.col("unit") * 7).alias("position"), "kind")
    return X.join_asof_unit(units, at)


@query("join_asof_chunk", f"""
    WITH {CHUNKS}, c AS (SELECT doc_id, chunk_no, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM chunks),
    {PIECES}, m AS (SELECT doc_id, start::BIGINT AS x FROM o WHERE i < n)
    SELECT doc_id, max(chunk_no) AS chunk_no, x - max(s) AS chunk_offset, x AS "offset" FROM m JOIN c USING (doc_id) WHERE s <= x GROUP BY doc_id, x""")
def _(t):
    matches = X.find_rows(t.documents, "tion").select("doc_id", F.col("start").cast("long").alias("offset"))
    return X.join_asof_chunk(matches, X.chunk_offsets(t.documents))


@query("join_span_cover", f"""
    WITH {PIECES}, d AS (SELECT doc_id, start::BIGINT AS s, start::BIGINT + 4 AS e FROM o WHERE i < n),
         l AS (SELECT DISTINCT document_id AS doc_id, unit * 11 AS start, unit * 11 + 6 AS "end" FROM samples)
    SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id AND d.s < l."end" AND l.start < d.e)""", "samples")
def _(t):
    links = t.samples.select(F.col("document_id").alias("doc_id"), (F.col("unit") * 11).alias("start"), (F.col("unit") * 11 + 6).alias("end"))
    return X.join_span_cover(X.find_rows(t.documents, "tion"), links)


BLOCKS = r"""
    b0 AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:head|script|style)\b[^>]*>.*?</(?:head|script|style)\s*>', '', 'g') AS b FROM pages),
    b1 AS (SELECT page_id, regexp_replace(regexp_replace(b, '\s+', ' ', 'g'), '(?i)<br\b[^>]*>', chr(31), 'g') AS b FROM b0),
    b2 AS (SELECT page_id, regexp_replace(regexp_replace(b, '(?i)<h([1-6])\b[^>]*>', chr(30) || 'HEADING\1' || chr(31), 'g'), '(?i)<li\b[^>]*>', chr(30) || 'LIST_ITEM' || chr(31), 'g') AS b FROM b1),
    b3 AS (SELECT page_id, regexp_replace(regexp_replace(b, '(?i)</?(?:p|div|article|footer|nav|ul)\b[^>]*>|</(?:h[1-6]|li)\s*>', chr(30) || 'PARAGRAPH' || chr(31), 'g'), '<[A-Za-z/!?][^>]*>', '', 'g') AS b FROM b2),
    b4 AS (SELECT page_id, generate_subscripts(x, 1) AS ord, unnest(x) AS piece FROM (SELECT page_id, string_split(b, chr(30)) AS x FROM b3)),
    b5 AS (SELECT page_id, ord, split_part(piece, chr(31), 1) AS head, regexp_replace(regexp_replace(substr(piece, length(split_part(piece, chr(31), 1)) + 2), ' *\x1f *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM b4),
    b6 AS (SELECT page_id, ord, regexp_replace(head, '[1-6]$', '') AS kind, coalesce(TRY_CAST(regexp_extract(head, '([1-6])$', 1) AS INT), 0) AS level,
                  replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS text FROM b5),
    blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS block_no, kind, level, text FROM b6 WHERE text <> '' AND kind IN ('HEADING', 'LIST_ITEM', 'PARAGRAPH'))"""


@query("D4", f"WITH {BLOCKS} SELECT page_id, block_no, kind, level, text FROM blocks")
def _(t):
    return X.html_blocks(t.pages).select("page_id", "block_no", "kind", "level", "text")


@query("D4_layout", f"""WITH {BLOCKS}, n AS (SELECT page_id, count(*) FILTER (b.page_id IS NOT NULL) AS n FROM pages LEFT JOIN blocks b USING (page_id) GROUP BY 1)
    SELECT page_id, block_no, kind, level, CASE WHEN kind = 'LIST_ITEM' THEN '•' ELSE '' END AS marker, 0 AS indent, text, 0::BIGINT AS n_cells FROM blocks UNION ALL
    SELECT page_id, n + unnest(range(7)), unnest(['PARAGRAPH', 'PARAGRAPH', 'LIST_ITEM', 'LIST_ITEM', 'LIST_ITEM', 'PARAGRAPH', 'TABLE']), unnest([0, 0, 0, 1, 0, 0, 0]),
           unnest(['', '', 'iii.', '◦', 'xl.', '', '']), unnest([2, 1, 0, 0, 0, 0, 0]),
           unnest(['q' || page_id, 'r', 'one', 'in', 'two', '  a' || chr(10) || '    b', 'h' || page_id || ' x & y' || chr(10) || 'a b c']), unnest([0, 0, 0, 0, 0, 0, 4]) FROM n""")
def _(t):
    """Quotes, lists, preformatted text, a table and hidden elements behind every page's text, because the pages have none."""
    more = F.concat(
        F.lit("</p><blockquote><blockquote><p>q"), "page_id", F.lit('</p></blockquote>r</blockquote><div title="not hidden"></div><div hidden>' + "<div>" * 9 + "gone" + "</div>" * 9 + "gone</div>"),
        F.lit('<ol type="i" start="3"><li>one<ul><li>in</ul><li value=40>two</ol><pre>  a\n    b</pre><table><tr><th colspan="2">h'), "page_id",
        F.lit("<td rowspan=2>x &amp; y</tr><tr><td>a<td><b>b</b>  c</table><p style='display: none'>gone"),
    )
    blocks = X.html_blocks(t.pages.select("page_id", F.concat("html", more).alias("html")))
    return blocks.select("page_id", "block_no", "kind", "level", "marker", "indent", "text", F.size("cells").cast("long").alias("n_cells"))


@query("D3_blocks", f"WITH {BLOCKS} SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS unit_no, block_no AS anchor, 0::BIGINT AS start, replace(text, chr(10), ' ') AS text FROM blocks")
def _(t):
    return X.speakable_blocks(t.pages)


@query("D5", f"WITH {BLOCKS} SELECT page_id AS doc_id, left(string_agg(text, chr(10) ORDER BY block_no), 1000000) AS text FROM blocks GROUP BY 1")
def _(t):
    return X.blocks_to_text(X.html_blocks(t.pages))


@query("D6", f"WITH {BLOCKS} SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS pos, block_no AS target, 0 AS depth, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS title FROM blocks WHERE kind = 'HEADING'")
def _(t):
    return X.outline_from_headings(X.html_blocks(t.pages))


@query("D7", f"""WITH {HREF}
    SELECT page_id, label, path AS target, true AS internal, host, count(*) AS n FROM (
      SELECT page_id, replace(replace(trim(regexp_replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') AS label, regexp_replace(ltrim(href, '/'), '[#?].*$', '') AS path,
             lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM h JOIN pages USING (page_id)) WHERE path <> '' GROUP BY ALL""")
def _(t):
    return X.link_edges(t.pages).groupBy("page_id", "label", "target", "internal", "host").agg(F.count("*").alias("n"))


@query("D8", """
    SELECT page_id, 0 AS table_no, unnest([0, 0, 1, 1, 1]) AS row_no, unnest([0, 2, 0, 1, 2]) AS "column", unnest([2, 1, 1, 1, 1]) AS colspan, unnest([1, 2, 1, 1, 1]) AS rowspan, unnest(['h' || page_id, 'x & y', 'a', 'b', '?']) AS text
    FROM pages WHERE false UNION ALL
    SELECT page_id, 0, unnest([0, 0, 1, 1]), unnest([0, 2, 0, 1]), unnest([2, 1, 1, 1]), unnest([1, 2, 1, 1]), unnest(['h' || page_id, 'x & y', 'a', 'b c']) FROM pages""")
def _(t):
    """A table behind every page's text, because the pages have none."""
    table = F.concat(F.lit('<table class="t"><tr><th colspan="2">h'), "page_id", F.lit('</th><td rowspan=2>x &amp; y</td></tr><tr><td>a</td><td><b>b</b>  c</td></tr></table>'))
    return X.table_cells(t.pages.select("page_id", F.concat("html", table).alias("html")))


@query("D9", f"""WITH {BLOCKS}, n AS (SELECT page_id AS doc_id, block_no, ((length(text) - length(replace(lower(text), 'th', ''))) / 2)::INT
            + (contains(lower(url), 'th') AND NOT contains(left(lower(text), 6), 'th'))::INT AS n FROM blocks JOIN pages USING (page_id))
    SELECT doc_id, block_no, unnest(range(1, n + 1))::INT AS hit_no FROM n WHERE n > 0""")
def _(t):
    """The first five signs of every block lead to the page's address."""
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.col("url").alias("link")))
    return X.block_find(X.html_blocks(t.pages).join(t.pages.select("page_id", "url"), "page_id").withColumn("spans", span), "th")


@query("D10", "SELECT id, CASE WHEN size_bytes * 20000 > 67108864 THEN 'TOO_LARGE' WHEN id % 11 = 0 OR format = 'UNKNOWN' THEN 'SKIPPED' WHEN id % 17 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS state FROM library", "library")
def _(t):
    i = F.col("id")
    return X.classify_index_state(t.library.select("id", (F.col("size_bytes") * 20000).alias("size_bytes"), (i % 11 == 0).alias("encrypted"), (F.col("format") != "UNKNOWN").alias("readable"), (i % 17 == 0).alias("broken")))


@query("D11", """
    WITH e AS (SELECT doc_id AS element_id, (['p', 'li', 'td'])[doc_id % 3 + 1] AS tag, CASE WHEN doc_id % 7 = 0 THEN 'i' || doc_id % 70 END AS id, ['c' || doc_id % 4, 'd' || doc_id % 5] AS classes FROM documents),
         r AS (SELECT * FROM (VALUES ('p', NULL, NULL, 1, 'color', 'red'), ('p', NULL, 'c1', 2, 'color', 'blue'), (NULL, NULL, 'd2', 3, 'color', 'green'), (NULL, 'i7', NULL, 4, 'color', 'black'),
                  ('li', NULL, NULL, 5, 'margin', '1'), (NULL, NULL, 'c3', 6, 'margin', '2'), (NULL, NULL, 'd3', 7, 'margin', '3'), (NULL, 'i14', 'c2', 8, 'margin', '4')) AS r(tag, id, class, ord, property, value))
    SELECT element_id, property, max_by(value, s * 1000 + ord) AS value FROM (
      SELECT element_id, property, value, ord, CASE WHEN r.id IS NULL THEN 0 ELSE 100 END + CASE WHEN r.class IS NULL THEN 0 ELSE 10 END + CASE WHEN r.tag IS NULL THEN 0 ELSE 1 END AS s
      FROM e, r WHERE (r.tag IS NULL OR r.tag = e.tag) AND (r.id IS NULL OR r.id = e.id) AND (r.class IS NULL OR list_contains(classes, r.class))) GROUP BY 1, 2""")
def _(t):
    d = F.col("doc_id")
    elements = t.documents.select(d.alias("element_id"), F.element_at(F.array(*map(F.lit, ["p", "li", "td"])), (d % 3 + 1).cast("int")).alias("tag"), F.when(d % 7 == 0, F.concat(F.lit("i"), d % 70)).alias("id"), F.array(F.concat(F.lit("c"), d % 4), F.concat(F.lit("d"), d % 5)).alias("classes"))
    rules = t.rows("""SELECT * FROM VALUES ('p', NULL, NULL, 1, 'color', 'red'), ('p', NULL, 'c1', 2, 'color', 'blue'), (NULL, NULL, 'd2', 3, 'color', 'green'), (NULL, 'i7', NULL, 4, 'color', 'black'),
        ('li', NULL, NULL, 5, 'margin', '1'), (NULL, NULL, 'c3', 6, 'margin', '2'), (NULL, NULL, 'd3', 7, 'margin', '3'), (NULL, 'i14', 'c2', 8, 'margin', '4') AS r(tag, id, class, `order`, property, value)""")
    return X.rule_precedence(elements, rules)


OUTLINE = "outline AS (SELECT page_id // 50 AS doc_id, (page_id % 50) AS pos, ((page_id * 7 + page_id // 3) % 4)::INT AS depth FROM pages)"


def outline(t):
    p = F.col("page_id")
    return t.pages.select(F.floor(p / 50).alias("doc_id"), (p % 50).alias("pos"), ((p * 7 + F.floor(p / 3)) % 4).cast("int").alias("depth"))


@query("outline_has_children", f"WITH {OUTLINE} SELECT doc_id, pos, depth, coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY pos) > depth, false) AS has_children FROM outline")
def _(t):
    return X.outline_has_children(outline(t))


@query("outline_visible", f"""WITH {OUTLINE}, f AS (SELECT o.*, (SELECT coalesce(min(n.pos), 1000000) FROM outline n WHERE n.doc_id = o.doc_id AND n.pos > o.pos AND n.depth <= o.depth) AS past FROM outline o WHERE pos % 3 = 0)
    SELECT doc_id, pos FROM outline o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND f.pos < o.pos AND o.pos < f.past)""")
def _(t):
    return X.outline_visible(outline(t), outline(t).where("pos % 3 = 0"))


@query("outline_initial_folds", f"WITH {OUTLINE} SELECT doc_id, pos FROM (SELECT *, lead(depth) OVER w > depth AS has, count(*) OVER (PARTITION BY doc_id) AS n FROM outline WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE n > 40 AND has")
def _(t):
    return X.outline_initial_folds(outline(t), 40)


@query("outline_relative_depth", f"WITH {OUTLINE} SELECT doc_id, pos, least(greatest(depth + 2 - min(depth + 2) OVER (PARTITION BY doc_id), 0), 2) AS depth FROM outline")
def _(t):
    return X.outline_relative_depth(outline(t).withColumn("depth", F.col("depth") + 2), 2).select("doc_id", "pos", "depth")


@query("outline_sections", """
    WITH s AS (SELECT page_id AS slide, page_id // 10 AS section_id, 'S' || (page_id // 10) AS name FROM pages WHERE page_id % 10 BETWEEN 2 AND 7),
         f AS (SELECT section_id, name, min(slide) AS t FROM s GROUP BY 1, 2)
    SELECT t AS target, 0 AS depth, name AS title FROM f UNION ALL
    SELECT p.page_id, CASE WHEN f.t IS NULL THEN 0 ELSE 1 END, 'p' || p.page_id FROM pages p LEFT JOIN s ON s.slide = p.page_id LEFT JOIN f ON f.section_id = s.section_id WHERE f.t IS NULL OR f.t <> p.page_id""")
def _(t):
    p = F.col("page_id")
    sections = t.pages.where((p % 10).between(2, 7)).select(p.alias("slide"), F.floor(p / 10).alias("section_id"), F.concat(F.lit("S"), F.floor(p / 10)).alias("name"))
    return X.outline_sections(t.pages.select(p.alias("slide"), F.concat(F.lit("p"), p).alias("title")), sections)


@query("first_reference_numbers", """
    WITH r AS (SELECT document_id AS doc_id, event_id AS pos, unit AS key FROM samples), d AS (SELECT document_id AS doc_id, event_id AS def_no, (unit * 3) % 45 AS key FROM samples),
         f AS (SELECT doc_id, key, min(def_no) AS def_no FROM d GROUP BY 1, 2), c AS (SELECT doc_id, key, min(pos) AS p FROM r GROUP BY 1, 2)
    SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY p NULLS LAST, def_no)::INT AS number FROM f LEFT JOIN c USING (doc_id, key)""", "samples")
def _(t):
    refs = t.samples.select(F.col("document_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("unit").alias("key"))
    defs = t.samples.select(F.col("document_id").alias("doc_id"), F.col("event_id").alias("def_no"), (F.col("unit") * 3 % 45).alias("key"))
    return X.first_reference_numbers(refs, defs)


@query("list_numbering", """
    WITH i AS (SELECT document_id AS list_id, event_id AS pos, CASE WHEN event_id % 11 = 0 THEN unit END AS value, document_id % 5 AS start FROM samples),
         g AS (SELECT *, count(value) OVER (PARTITION BY list_id ORDER BY pos) AS g FROM i),
         n AS (SELECT list_id, pos, coalesce(first_value(value) OVER w, first_value(start) OVER w) + row_number() OVER w - 1 AS n FROM g WINDOW w AS (PARTITION BY list_id, g ORDER BY pos))
    SELECT list_id, pos, CASE WHEN n BETWEEN 0 AND 9 THEN '0' || n ELSE n::VARCHAR END AS marker FROM n""", "samples")
def _(t):
    items = t.samples.select(F.col("document_id").alias("list_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 11 == 0, F.col("unit")).alias("value"), (F.col("document_id") % 5).alias("start"), F.lit("decimalZero").alias("format"))
    return X.list_numbering(items)
