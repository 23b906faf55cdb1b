"""Search queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import catalog as C
from quireworks.operators import search as S
from quireworks.operators.segments import SegmentIndex
from quireworks.plans.registry import query
from quireworks.session import shared_path

QUERIES = "SELECT * FROM VALUES (1, 'ment tion'), (2, 'The, that-ing?'), (3, 'a the'), (4, 'é elle') AS q(query_id, text)"
#: The parsed queries, folded
TERMS = "(VALUES (1, 0, 'ment', true), (1, 1, 'tion', true), (2, 0, 'the', true), (2, 1, 'that', true), (2, 2, 'ing', true), (3, 0, 'the', true), (4, 0, 'elle', true)) AS t(query_id, term_no, term, is_prefix)"
POST = """
    tok AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM corpus),
    postings AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
    stats AS (SELECT c.doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'))::BIGINT AS n_tokens FROM corpus c)"""
CORPUS = "corpus AS (SELECT doc_id, text FROM documents)"
MATCH = f"""
    terms AS (SELECT query_id, term_no::BIGINT AS term_no, term, is_prefix FROM {TERMS}),
    matches AS (SELECT query_id, term_no, doc_id, sum(tf)::BIGINT AS tf FROM postings JOIN terms ON starts_with(postings.term, terms.term) GROUP BY 1, 2, 3),
    hit AS (SELECT query_id, doc_id FROM matches GROUP BY 1, 2 HAVING count(DISTINCT term_no) = (SELECT count(*) FROM terms x WHERE x.query_id = matches.query_id))"""
COUNTS = """
    counts AS (SELECT m.*, p.total, p.df, t.n_docs, t.avg_len, s.n_tokens AS len FROM matches m
        JOIN (SELECT query_id, term_no, sum(tf)::BIGINT AS total, count(DISTINCT doc_id) AS df FROM matches GROUP BY 1, 2) p USING (query_id, term_no)
        JOIN stats s USING (doc_id), (SELECT count(*) AS n_docs, greatest(floor(avg(n_tokens) + 0.5), 1)::BIGINT AS avg_len FROM stats) t)"""
SCORES = """
    scores AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - least(df, n_docs) + 0.5) / (least(df, n_docs) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
        FROM counts WHERE (query_id, doc_id) IN (SELECT query_id, doc_id FROM hit) GROUP BY 1, 2),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 20)"""


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join([CORPUS, *parts]) + " " + select


def corpus(t):
    return t.documents.select("doc_id", "text")


def parsed(t):
    return S.search_parse(t.rows(QUERIES))


@query("search_parse", """
    WITH w AS (SELECT doc_id AS query_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents),
         u AS (SELECT query_id, (CASE WHEN len(list_filter(words, lambda x: length(x) >= 2)) > 0 THEN list_filter(words, lambda x: length(x) >= 2) ELSE words END)[1:8] AS terms FROM w),
         e AS (SELECT query_id, generate_subscripts(terms, 1) - 1 AS term_no, unnest(terms) AS term FROM u)
    SELECT query_id, term_no, term, length(term) >= 2 AS is_prefix FROM e""")
def _(t):
    """Every document's text, as if it were typed."""
    return S.search_parse(t.documents.select(F.col("doc_id").alias("query_id"), "text"))


@query("fts_tokenize", "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(pos)::BIGINT AS pos_sum FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS term FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS l FROM documents)) GROUP BY 1")
def _(t):
    return S.fts_tokenize(t.documents).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("pos").alias("pos_sum"))


@query("build_postings", sql("SELECT term, doc_id, tf, n_tokens FROM postings JOIN stats USING (doc_id)", POST))
def _(t):
    return S.build_postings(corpus(t))[0].withColumnRenamed("len", "n_tokens")


@query("prefix_match", sql("SELECT * FROM matches", POST, MATCH))
def _(t):
    return S.prefix_match(parsed(t), S.token_rows(corpus(t))).drop("len")


@query("boolean_and_match", sql("SELECT * FROM hit", POST, MATCH))
def _(t):
    terms = parsed(t)
    return S.boolean_and_match(S.prefix_match(terms, S.token_rows(corpus(t))), terms)


@query("match_counts", sql("SELECT query_id, term_no, doc_id, tf, total, df, n_docs, avg_len, len FROM counts", POST, MATCH, COUNTS))
def _(t):
    return S.match_counts(S.prefix_match(parsed(t), S.token_rows(corpus(t))), S.build_postings(corpus(t))[1]).select("query_id", "term_no", "doc_id", "tf", "total", "df", "n_docs", "avg_len", "len")


@query("bm25_rank", sql("SELECT query_id, doc_id, round(score, 9) AS score FROM scores", POST, MATCH, COUNTS, SCORES))
def _(t):
    return S.scored(corpus(t), t.rows(QUERIES)).withColumn("score", F.round("score", 9))


@query("top_k_search", sql("SELECT query_id, doc_id, round(score, 9) AS score, rank FROM top", POST, MATCH, COUNTS, SCORES))
def _(t):
    return S.top_k_search(S.scored(corpus(t), t.rows(QUERIES))).withColumn("score", F.round("score", 9))


@query("search_top_hits", sql("SELECT query_id, doc_id, round(score, 9) AS score, rank FROM top", POST, MATCH, COUNTS, SCORES))
def _(t):
    return S.search_top_hits(corpus(t), t.rows(QUERIES)).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("search_kept_index", sql("SELECT query_id, doc_id, round(score, 9) AS score, rank FROM top", POST, MATCH, COUNTS, SCORES))
def _(t):
    """The index is written, and the queries read only the folders of their terms."""
    path = shared_path(t.spark, "postings")
    S.write_postings(corpus(t), path)
    return S.top_k_search(S.indexed_scored(t.spark, path, t.rows(QUERIES))).withColumn("score", F.round("score", 9))


@query("search_table_function", sql("SELECT query_id, doc_id, round(score, 9) AS score, rank FROM top", POST, MATCH, COUNTS, SCORES))
def _(t):
    """Queries joined laterally with the table function over a kept index."""
    path = shared_path(t.spark, "postings")
    S.write_postings(corpus(t), path)
    S.register_search(t.spark, path, "search_documents")
    t.rows(QUERIES).createOrReplaceTempView("search_documents_queries")
    return t.spark.sql("SELECT q.query_id, h.doc_id, round(h.score, 9) AS score, h.rank FROM search_documents_queries AS q, LATERAL search_documents(q.text) AS h")


CHANGED = "corpus AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'new ' || text ELSE text END AS text FROM documents WHERE doc_id % 9 <> 4)"


@query("search_segments", "WITH " + ",".join([CHANGED, POST, MATCH, COUNTS, SCORES]) + " SELECT query_id, doc_id, round(score, 9) AS score, rank FROM top")
def _(t):
    """Search in an index after three batches: all documents, an eighth of them anew, a ninth removed."""
    index = SegmentIndex(t.spark, shared_path(t.spark, "segments"))
    docs = corpus(t)
    index.apply(docs, 0)
    index.apply(docs.where("doc_id % 8 = 0").select("doc_id", F.concat(F.lit("new "), "text").alias("text")), 1)
    index.apply(docs.where("doc_id % 9 = 4").select("doc_id", F.lit(None).cast("string").alias("text")), 2)
    return S.top_k_search(index.scored(t.rows(QUERIES))).withColumn("score", F.round("score", 9))


#: Excerpts word by word: which terms each word meets, the best window of 32 words, its words and gaps put together
EXCERPT = """
    found AS (SELECT query_id, doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS words, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS plain,
        string_split_regex(text, '[\\p{L}\\p{N}]+') AS gaps FROM top JOIN corpus USING (doc_id)),
    word AS (SELECT query_id, doc_id, len(words) AS n, unnest(words) AS w, unnest(plain) AS f, generate_subscripts(words, 1) AS i FROM found),
    meets AS (SELECT word.query_id, doc_id, i, term_no, starts_with(f, term)::INT AS met FROM word JOIN terms USING (query_id)),
    near AS (SELECT *, max(met) OVER (PARTITION BY query_id, doc_id, term_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS ahead FROM meets),
    each_word AS (SELECT query_id, doc_id, i, sum(ahead) AS seen, max(met) AS met FROM near GROUP BY ALL),
    windows AS (SELECT *, sum(met) OVER (PARTITION BY query_id, doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS hits FROM each_word),
    best AS (SELECT query_id, doc_id, arg_min(i, (-seen, -hits, i)) AS first FROM windows GROUP BY ALL),
    shown AS (SELECT query_id, doc_id, i, first, n, gaps, w, met, CASE WHEN first > 1 THEN '…' ELSE gaps[1] END AS lead, least(first + 31, n) AS last
        FROM best JOIN word USING (query_id, doc_id) JOIN each_word USING (query_id, doc_id, i) JOIN found USING (query_id, doc_id) WHERE i BETWEEN first AND first + 31),
    pieces AS (SELECT *, w || CASE WHEN i < last THEN gaps[i + 1] WHEN last < n THEN '…' ELSE gaps[n + 1] END AS piece FROM shown),
    laid AS (SELECT *, length(lead) + coalesce(sum(length(piece)) OVER (PARTITION BY query_id, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM pieces)"""


@query("snippet", sql("""SELECT query_id, doc_id, any_value(lead) || string_agg(piece, '' ORDER BY i) AS snippet,
    string_agg(CASE WHEN met = 1 THEN place || ':' || (place + length(w)) END, ',' ORDER BY i) AS ranges FROM laid GROUP BY query_id, doc_id""", POST, MATCH, COUNTS, SCORES, EXCERPT))
def _(t):
    """Excerpts of the best hits; the places of the terms' words as start:end."""
    docs = corpus(t)
    top = S.top_k_search(S.scored(docs, t.rows(QUERIES)))
    found = S.snippet(docs, top.select("query_id", "doc_id"), parsed(t))
    return found.withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"], r["end"])), ","))


@query("search_focus_term", sql("SELECT t.query_id, doc_id, term, strpos(lower(text), lower(term)) - 1 AS first_offset FROM hit JOIN (SELECT * FROM terms WHERE term_no = 0) t USING (query_id) JOIN corpus USING (doc_id)", POST, MATCH))
def _(t):
    terms = parsed(t)
    hits = S.boolean_and_match(S.prefix_match(terms, S.token_rows(corpus(t))), terms)
    return S.search_focus_term(terms, corpus(t), hits).withColumn("first_offset", F.col("first_offset").cast("long"))


@query("search_library", """
    WITH h AS (SELECT doc_id AS id FROM documents WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])ment') AND regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])tion'))
    SELECT l.id, title, row_number() OVER (ORDER BY last_opened_at DESC, l.id) AS rank FROM library l JOIN h ON h.id = l.id""", "library")
def _(t):
    """The whole path from a query to the list shown: content matches joined into the library view."""
    terms = parsed(t).where("query_id = 1")
    hits = S.boolean_and_match(S.prefix_match(terms, S.token_rows(corpus(t))), terms).select(F.col("doc_id").alias("id"))
    return C.library_view(t.library, hits, "ment tion")
