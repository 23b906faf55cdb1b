"""The library's tables, derived from the driver's; each property is a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions import formats

EXTENSIONS = ["txt", "md", "csv", "tsv", "py", "pdf", "docx", "epub", "pptx", "xyz"]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Tables:
    """Views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, sql: str) -> DataFrame:
        """A few inline rows: parameters of an operator, such as search queries."""
        return self.spark.sql(sql)

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def library(self) -> DataFrame:
        seen = self.events.groupBy("user_id").agg(F.max(micros(F.col("ts"))).alias("seen"))
        labels = self.read("labels").select("doc_id", "quality")
        created = F.lit(1_704_067_200_000_000) + F.col("doc_id") * 60_000_000
        title = F.concat(F.lit("file"), F.col("doc_id") % 100, F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int")))
        rows = (
            self.documents.join(seen, F.col("user_id") == F.col("doc_id"), "left").join(labels, "doc_id", "left")
            .select(
                F.col("doc_id").alias("id"), F.concat(F.lit("lib://"), "source", F.lit("/"), "doc_id").alias("uri"), title.alias("title"),
                F.octet_length("text").cast("long").alias("size_bytes"), created.alias("created_at"), F.coalesce("seen", created).alias("last_opened_at"),
                F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_starred"),
            )
        )
        fmt = formats.detect(F.col("title"))
        return rows.withColumn("format", fmt).withColumn("format_group", formats.group(F.col("format"), F.col("title")))

    @cached_property
    def document_text(self) -> DataFrame:
        d, size = F.col("doc_id"), F.octet_length("text").cast("long")
        state = F.when(d % 17 == 0, "FAILED").when(d % 19 == 0, "SKIPPED").otherwise("INDEXED")
        created = F.lit(1_704_067_200_000_000) + d * 60_000_000
        return (
            self.documents.where(d % 10 != 9).withColumn("state", state)
            .select(
                d.alias("document_id"), F.when(F.col("state") == "INDEXED", F.col("text")).otherwise("").alias("text"), "state",
                F.when(F.col("state") == "INDEXED", F.length("text")).otherwise(0).cast("long").alias("char_count"),
                F.when(d % 23 == 0, size - 1).otherwise(size).alias("source_size"), F.lit(1).alias("index_version"),
                F.when(F.col("state") == "FAILED", created + 300_000_000).otherwise(created).alias("indexed_at"),
                F.when(d % 3 == 0, 0).otherwise(created).cast("long").alias("source_modified"),
            )
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.events.select(
            "event_id", F.col("user_id").alias("document_id"), micros(F.col("ts")).alias("ts"),
            (F.floor("value") % 40).cast("long").alias("unit"), (F.col("value") - F.floor("value")).alias("fraction"), F.lit(1.0).alias("zoom"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        kind = F.col("event_type")
        name = F.when(kind == "view", "reading").when(kind == "error", "battery").when(kind == "click", "enabled")
        return self.events.select("event_id", micros(F.col("ts")).alias("ts"), name.alias("signal"), (F.col("event_id") % 2 == 1).alias("on")).where("signal is not null")

    @cached_property
    def removals(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.where(kind.isin("purchase", "signup")).select(
            "event_id", micros(F.col("ts")).alias("ts"), F.when(kind == "purchase", "begin").otherwise("undo").alias("action"), F.col("user_id").alias("token")
        )

    @cached_property
    def monthly_series(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        x = (F.year(day) - 1995) * 12 + F.month(day) - 1
        return (
            self.read("lineitem").groupBy(F.col("l_returnflag").alias("series_id"), x.cast("long").alias("x"))
            .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("y"))
        )

    @cached_property
    def daily_prices(self) -> DataFrame:
        return self.read("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), F.col("o_orderkey").alias("ts"), F.col("o_totalprice").alias("price"))

    @cached_property
    def pages(self) -> DataFrame:
        return self.read("pages")

    @cached_property
    def copies(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), F.concat("lang", F.lit(".txt")).alias("title"), "text")

    @cached_property
    def locations(self) -> DataFrame:
        """Places in documents, one per sample: kind cycles with the event, unit and fraction come from its value."""
        return self.samples.withColumn("kind", (F.col("event_id") % 4).cast("int"))

    @cached_property
    def progress(self) -> DataFrame:
        """Stored positions: the last sample of each document, its kind by the parity of the document."""
        last = F.max_by(F.struct("unit", "fraction", "zoom", "event_id"), F.struct("ts", "event_id"))
        return (
            self.samples.groupBy("document_id").agg(last.alias("s"))
            .select("document_id", F.when(F.col("document_id") % 7 == 0, 9).otherwise(F.col("document_id") % 4).cast("int").alias("kind"), "s.unit", "s.fraction", "s.zoom")
        )

    @cached_property
    def highlights(self) -> DataFrame:
        """Marks: one per event, on page unit % 5, a box from its value; kind 1 for even events, else 2."""
        v = F.col("fraction")
        return self.samples.select(
            F.col("event_id").alias("id"), "document_id", (F.col("unit") % 5).alias("page"), ((F.col("event_id") % 2) + 1).cast("int").alias("kind"),
            F.array(F.struct((v / 2).alias("l"), (F.col("unit") / 50.0).alias("t"), (v / 2 + 0.3).alias("r"), (F.col("unit") / 50.0 + 0.02).alias("b"))).alias("rects"),
        )


#: The same views in DuckDB's SQL, for the oracles
SQL_VIEWS = {
    "library": """
        SELECT id, uri, title, size_bytes, created_at, last_opened_at, is_starred, format,
               CASE format WHEN 'DOCX' THEN 'WORD' WHEN 'CSV' THEN CASE WHEN title LIKE '%.tsv' THEN 'TSV' ELSE 'CSV' END
                    WHEN 'PPTX' THEN 'POWERPOINT' WHEN 'UNKNOWN' THEN NULL ELSE format END AS format_group
        FROM (SELECT d.doc_id AS id, 'lib://' || source || '/' || d.doc_id AS uri,
               'file' || (d.doc_id % 100) || '.' || (['txt','md','csv','tsv','py','pdf','docx','epub','pptx','xyz'])[d.doc_id % 10 + 1] AS title,
               strlen(text)::BIGINT AS size_bytes, (1704067200000000 + d.doc_id * 60000000)::BIGINT AS created_at,
               coalesce(e.seen, 1704067200000000 + d.doc_id * 60000000)::BIGINT AS last_opened_at, coalesce(l.quality = 1, false) AS is_starred,
               (['TEXT','MARKDOWN','CSV','CSV','CODE','PDF','DOCX','EPUB','PPTX','UNKNOWN'])[d.doc_id % 10 + 1] AS format
        FROM documents d LEFT JOIN (SELECT user_id, max(epoch_us(ts)) AS seen FROM events GROUP BY 1) e ON e.user_id = d.doc_id
             LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "document_text": """
        SELECT document_id, CASE WHEN state = 'INDEXED' THEN text ELSE '' END AS text, state,
               CASE WHEN state = 'INDEXED' THEN length(text) ELSE 0 END::BIGINT AS char_count,
               (CASE WHEN document_id % 23 = 0 THEN strlen(text) - 1 ELSE strlen(text) END)::BIGINT AS source_size, 1 AS index_version,
               (CASE WHEN state = 'FAILED' THEN created + 300000000 ELSE created END)::BIGINT AS indexed_at,
               (CASE WHEN document_id % 3 = 0 THEN 0 ELSE created END)::BIGINT AS source_modified
        FROM (SELECT doc_id AS document_id, text, 1704067200000000 + doc_id * 60000000 AS created,
                     CASE WHEN doc_id % 17 = 0 THEN 'FAILED' WHEN doc_id % 19 = 0 THEN 'SKIPPED' ELSE 'INDEXED' END AS state
              FROM documents WHERE doc_id % 10 <> 9)""",
    "samples": """
        SELECT event_id, user_id AS document_id, epoch_us(ts)::BIGINT AS ts, (floor(value)::BIGINT % 40) AS unit, value - floor(value) AS fraction,
               1.0::DOUBLE AS zoom FROM events""",
    "signals": """
        SELECT event_id, epoch_us(ts)::BIGINT AS ts, CASE event_type WHEN 'view' THEN 'reading' WHEN 'error' THEN 'battery' ELSE 'enabled' END AS signal,
               event_id % 2 = 1 AS "on" FROM events WHERE event_type IN ('view', 'error', 'click')""",
    "removals": """
        SELECT event_id, epoch_us(ts)::BIGINT AS ts, CASE event_type WHEN 'purchase' THEN 'begin' ELSE 'undo' END AS action, user_id AS token
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "monthly_series": """
        SELECT l_returnflag AS series_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS x,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS y FROM lineitem GROUP BY 1, 2""",
    "daily_prices": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, o_orderkey AS ts, o_totalprice AS price FROM orders",
    "copies": "SELECT doc_id AS id, lang || '.txt' AS title, text FROM documents",
    "locations": "SELECT *, (event_id % 4)::INT AS kind FROM samples",
    "progress": """
        SELECT document_id, (CASE WHEN document_id % 7 = 0 THEN 9 ELSE document_id % 4 END)::INT AS kind, unit, fraction, zoom
        FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS rn FROM samples) WHERE rn = 1""",
    "highlights": """
        SELECT event_id AS id, document_id, unit % 5 AS page, ((event_id % 2) + 1)::INT AS kind, fraction / 2 AS l, unit / 50.0::DOUBLE AS t,
               fraction / 2 + 0.3 AS r, unit / 50.0::DOUBLE + 0.02 AS b FROM samples""",
}
NEEDS = {"locations": ["samples"], "progress": ["samples"], "highlights": ["samples"]}


def with_views(sql: str, names: list[str]) -> str:
    """The SQL with the named views as common table expressions in front."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    if not wanted:
        return sql
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
