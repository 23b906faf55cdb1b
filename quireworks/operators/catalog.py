"""Catalog operators: filters, queues, joins, facets and sorts over the library and its child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.functions import formats
from quireworks.session import stage

SORTS = {"last_opened": "last_opened_at", "date_added": "created_at", "size": "size_bytes"}


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in a total order, for results whose order is the answer.

    The range sort is written once, each row with its partition and its place in it; the counts and the rows are both read
    from that table, so places do not depend on whether a plan sorts again, and no task sees all rows.
    """
    part, at = "__part", "__at"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    placed, _ = stage(placed, "ranked")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select(part, F.coalesce(F.sum("__n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # one row per partition, so the broadcast is bounded by their number
    return placed.join(F.broadcast(before), part).withColumn("rank", F.col("__before") + F.col(at) + 1).drop(part, at, "__before")


def scan_library(library: DataFrame) -> DataFrame:
    return ranked(library, F.desc("last_opened_at"), F.col("id"))


def lookup(library: DataFrame, column: str, value: object) -> DataFrame:
    return library.where(F.col(column) == F.lit(value))


def library_filter(library: DataFrame, groups: list[str] | None = None, starred_only: bool = False) -> DataFrame:
    kept = library.where("is_starred") if starred_only else library
    return kept.where(F.col("format_group").isin(groups)) if groups else kept


def title_match(query: str) -> Column:
    """Case-insensitive substring of the trimmed query; an empty one matches all."""
    wanted = query.strip().lower()
    return F.contains(F.lower("title"), F.lit(wanted)) if wanted else F.lit(True)


def title_contains(library: DataFrame, query: str) -> DataFrame:
    return library.where(title_match(query))


def sort_order(sort: str) -> list[Column]:
    """The order of a sort: its key, then last opened (newest first), then id."""
    ties = [F.desc("last_opened_at"), F.asc("id")]
    if sort in ("name_asc", "name_desc"):
        key = natural_key(F.col("title"))
        return [key.asc() if sort == "name_asc" else key.desc(), *ties]
    return [F.desc(SORTS[sort]), *ties]


def natural_key(title: Column, collation: str = "UNICODE_CI") -> Column:
    """Sort key of natural order: digit runs compare as numbers of any length and before text, text by the collation.

    An array of (kind, number of digits, digits, text), compared item by item; a name that ends first comes first.
    """
    runs = F.regexp_extract_all(title, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(run: Column) -> Column:
        number = run.rlike("^[0-9]")
        digits = F.when(number, F.regexp_replace(run, "^0+(?=.)", "")).otherwise("")
        return F.struct(
            F.when(number, 0).otherwise(1).alias("kind"), F.length(digits).alias("n"), digits.alias("digits"),
            F.collate(F.when(number, "").otherwise(run), collation).alias("text"),
        )

    return F.transform(runs, part)


def sort_by(library: DataFrame, sort: str) -> DataFrame:
    return ranked(library, *sort_order(sort)).select("id", "rank")


def library_view(
    library: DataFrame, hits: DataFrame, query: str = "", groups: list[str] | None = None, starred_only: bool = False, sort: str = "last_opened"
) -> DataFrame:
    """Title matches, then documents only their content matches, each part in the chosen order: id, title, rank."""
    found = library_filter(library, groups, starred_only).join(hits.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    by_title = title_match(query)
    kept = found.where(by_title | F.coalesce("hit", F.lit(False)))
    return ranked(kept, F.when(by_title, 0).otherwise(1).asc(), *sort_order(sort)).select("id", "title", "rank")


def pending_index_queue(library: DataFrame, doc_text: DataFrame, version: int, now: int, limit: int, max_bytes: int | None = None) -> DataFrame:
    """Documents to index: without a text row, of an older version, of another size, or failed with the deadline passed."""
    small = library if max_bytes is None else library.where(F.col("size_bytes") <= max_bytes)
    joined = small.join(doc_text.drop("text"), small["id"] == doc_text["document_id"], "left")
    due = (
        F.col("document_id").isNull() | (F.col("index_version") < version) | (F.col("source_size") != F.col("size_bytes"))
        | ((F.col("state") == "FAILED") & (F.col("indexed_at") <= now))
    )
    return joined.where(due).orderBy("id").limit(limit).select("id", "size_bytes")


def changed_since_indexed(library: DataFrame, doc_text: DataFrame, mtimes: DataFrame, version: int) -> DataFrame:
    """Indexed rows whose source has another time now; a stored zero or an unknown time never counts."""
    rows = doc_text.where((F.col("state") == "INDEXED") & (F.col("index_version") == version)).select("document_id", F.col("source_modified").alias("old_mtime"))
    joined = library.select("id").join(rows, F.col("id") == F.col("document_id")).join(mtimes.select("id", F.col("mtime").alias("new_mtime")), "id")
    return joined.where("old_mtime <> 0 and new_mtime > 0 and new_mtime <> old_mtime").select("id", "old_mtime", "new_mtime")


def keyset_page(df: DataFrame, after_id: int, limit: int, key: str = "id") -> DataFrame:
    return df.where(F.col(key) > after_id).orderBy(key).limit(limit)


def text_summary(library: DataFrame, doc_text: DataFrame) -> DataFrame:
    rows = doc_text.select(F.col("document_id").alias("id"), "state", "char_count", "source_size")
    return library.select("id", "size_bytes").join(rows, "id").where("source_size = size_bytes").select("id", "state", "char_count")


def hide_pending_removals(library: DataFrame, hidden: DataFrame) -> DataFrame:
    return library.join(hidden.select("id"), "id", "left_anti")


def restore_candidates(progress: DataFrame, library: DataFrame) -> DataFrame:
    """Stored positions whose kind is the one the document's format is read by."""
    kinds = library.select(F.col("id").alias("document_id"), formats.location_kind(F.col("format")).alias("expected"))
    return progress.join(kinds, "document_id").where("kind = expected").select("document_id", "kind", "unit", "fraction", "zoom")


def join_text(library: DataFrame, doc_text: DataFrame, how: str) -> DataFrame:
    rows = doc_text.select(F.col("document_id").alias("id"), "state", "char_count")
    return library.select("id", "title").join(rows, "id", how)


def join_semi_parent_exists(child: DataFrame, parents: DataFrame, key: str = "document_id") -> DataFrame:
    return child.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def join_anti_orphans(files: DataFrame, library: DataFrame, cutoff: int) -> DataFrame:
    """Files no row refers to, older than the cut-off; a zero time is unknown and stays."""
    return files.where((F.col("mtime") > 0) & (F.col("mtime") < cutoff)).join(library.select(F.col("uri").alias("path")), "path", "left_anti").select("path")


def join_broadcast_format(names: DataFrame) -> DataFrame:
    """name, mime → format by joins with the lookup tables, which hold a few dozen fixed rows."""
    spark = names.sparkSession
    ext, mime = F.broadcast(formats.lookup(spark, "extension")), F.broadcast(formats.lookup(spark, "mime"))
    keyed = names.withColumns({"e": formats.extension(F.col("name")), "n": F.lower("name"), "m": F.lower("mime")})
    side = lambda table, key, out: table.select(F.col("key").alias(key), F.col("fmt").alias(out))
    joined = keyed.join(side(ext, "e", "by_ext"), "e", "left").join(side(ext, "n", "by_name"), "n", "left").join(side(mime, "m", "by_mime"), "m", "left")
    return joined.select("name", "mime", F.coalesce("by_ext", "by_name", "by_mime", F.lit("UNKNOWN")).alias("format"))


def join_regrant_match(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows and re-picked files of the same name (blank: untitled) and compatible format: id, pick_id."""
    named = picks.select("pick_id", F.when(F.trim("name") == "", "untitled").otherwise(F.col("name")).alias("title"), F.col("format").alias("picked"))
    fmt, picked = F.col("format"), F.col("picked")
    fits = (fmt == picked) | ((fmt == "UNKNOWN") & (picked == "CODE")) | ((fmt == "CODE") & picked.isin("UNKNOWN", "CSV"))
    return rows.select("id", "title", "format").join(named, "title").where(fits).select("id", "pick_id")


def join_rect_touch(highlights: DataFrame, boxes: DataFrame) -> DataFrame:
    """Highlights a selection touches: same page, x ranges overlap, the box's vertical middle lies in the mark."""
    rects = highlights.select("id", "document_id", "page", F.explode("rects").alias("h"))
    middle = (F.col("t") + F.col("b")) / 2
    touch = (F.col("h.l") < F.col("r")) & (F.col("l") < F.col("h.r")) & middle.between(F.col("h.t"), F.col("h.b"))
    return rects.join(boxes, ["document_id", "page"]).where(touch).select("selection_id", "id").distinct()


def join_selection_pages(selections: DataFrame) -> DataFrame:
    """Selections (start page and index, end page and index) as one row per page; -1 ends a whole page."""
    page = F.explode(F.sequence("start_page", "end_page"))
    return selections.withColumn("page", page).select(
        "selection_id", "page", F.when(F.col("page") == F.col("start_page"), F.col("start_index")).otherwise(0).alias("from"),
        F.when(F.col("page") == F.col("end_page"), F.col("end_index")).otherwise(-1).alias("to"),
    )


def join_outline_target(nav: DataFrame, anchors: DataFrame, starts: DataFrame) -> DataFrame:
    """Navigation entries to block numbers: by path and fragment, else by path without case, else by the chapter's start."""
    exact = anchors.select("path", "fragment", F.col("block_no").alias("by_anchor"))
    folded = anchors.where("fragment = ''").groupBy(F.lower("path").alias("lower_path")).agg(F.min("block_no").alias("by_path"))
    chapter = starts.select(F.col("path").alias("start_path"), F.col("block_no").alias("by_start"))
    joined = (
        nav.join(exact, ["path", "fragment"], "left").join(folded, F.lower("path") == F.col("lower_path"), "left")
        .join(chapter, F.lower("path") == F.lower("start_path"), "left")
    )
    out = joined.select("pos", F.coalesce("by_anchor", "by_path", "by_start", F.lit(-1)).cast("long").alias("target"), "depth", "title")
    return out.join(out.where("target >= 0").select(F.lit(True).alias("some")).limit(1).hint("broadcast"), how="left_semi")


def join_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows with the same title, size and SHA-256: title, hash, n, first_id."""
    keyed = docs.select("id", "title", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    return keyed.groupBy("title", "size", "hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1").select("title", "hash", "n", "first_id")


def join_reading_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    return ranked(spine.join(manifest, "item_id"), (~F.col("linear")).asc(), F.col("spine_no")).select(F.col("rank").alias("pos"), "item_id")


def facet_groups(library: DataFrame, selected: list[str]) -> DataFrame:
    """Chips present, with their counts, and selected ones that no document has."""
    spark = library.sparkSession
    chosen = spark.createDataFrame([(g,) for g in selected], "format_group string") if selected else spark.createDataFrame([], "format_group string")
    present = library.where("format_group is not null").groupBy("format_group").agg(F.count("*").alias("n"))
    return present.union(chosen.withColumn("n", F.lit(0).cast("long"))).groupBy("format_group").agg(F.sum("n").alias("n"))


def facet_counts(library: DataFrame) -> DataFrame:
    return library.cube("format_group", "is_starred").agg(F.count("*").alias("n"), F.grouping_id().alias("grouping_id"))


def library_empty_flags(library: DataFrame) -> DataFrame:
    return library.agg((F.count("*") == 0).alias("is_empty"), F.coalesce(F.bool_or("is_starred"), F.lit(False)).alias("has_starred"))


def index_state_counts(library: DataFrame, doc_text: DataFrame) -> DataFrame:
    joined = library.select("id").join(doc_text.select(F.col("document_id").alias("id"), "state"), "id", "left")
    return joined.groupBy(F.coalesce("state", F.lit("PENDING")).alias("state")).agg(F.count("*").alias("n"))


def shared_mime_type(selection: DataFrame) -> DataFrame:
    one = F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("*/*")
    return selection.groupBy("sel_id").agg(one.alias("type"))


def marks_by_page(highlights: DataFrame) -> DataFrame:
    return highlights.groupBy("document_id", "page").agg(F.sort_array(F.collect_list("id")).alias("marks"))


def exportable_marks(highlights: DataFrame) -> DataFrame:
    rows = highlights.where((F.col("kind") == 1) & (F.size("rects") > 0))
    return rows.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", "rects"))).alias("marks")).withColumn("rect_lists", F.transform("marks", lambda m: m["rects"])).drop("marks")


def sort_bookmarks(bookmarks: DataFrame, library: DataFrame) -> DataFrame:
    """Bookmarks of the kind their document is read by, in reading order per document."""
    kinds = library.select(F.col("id").alias("document_id"), formats.location_kind(F.col("format")).alias("expected"))
    order = W.partitionBy("document_id").orderBy("unit", "fraction", "created_at", "id")
    return bookmarks.join(kinds, "document_id").where("kind = expected").select("id", "document_id", F.row_number().over(order).cast("long").alias("rank"))


def limit_hits(hits: DataFrame, cap: int, key: str = "query_id", order: str = "pos") -> DataFrame:
    """The first `cap` rows of each key, with a flag on all of them if there were more."""
    w = W.partitionBy(key)
    return hits.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(order))).where(F.col("r") <= cap).withColumn("truncated", F.col("n") > cap).drop("n", "r")


def union_ordered(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))


def set_difference_new(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("id", "size_bytes").join(before.select("id", "size_bytes"), ["id", "size_bytes"], "left_anti")


def set_intersect_present(hidden: DataFrame, present: DataFrame) -> DataFrame:
    return hidden.select("id").join(present.select("id"), "id", "left_anti")


def distinct_first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min_by("value", "pos").alias("value"))


def keep_latest_n(files: DataFrame, n: int = 20) -> DataFrame:
    return files.orderBy(F.desc("name")).limit(n)


def recent_k_working_set(events: DataFrame, k: int = 16) -> DataFrame:
    """Per user, the k keys touched last: user_id, key, rank."""
    last = events.groupBy("user_id", "key").agg(F.max("ts").alias("ts"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.asc("key"))).cast("long")
    return last.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "key", "rank")


def unique_names(names: DataFrame) -> DataFrame:
    """Colliding names get " (1)", " (2)" before the extension, in order of id, past names already taken."""
    dot = F.length("name") - F.locate(".", F.reverse("name"))
    has = (F.locate(".", F.reverse("name")) > 0) & (dot > 0)
    stem, ext = F.when(has, F.substring("name", F.lit(1), dot)).otherwise(F.col("name")), F.when(has, F.substring("name", dot + 1, F.length("name"))).otherwise("")
    w = W.partitionBy("name")
    numbered = names.withColumn("k", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    firsts = numbered.where("k = 0").select("id", F.col("name").alias("unique_name"))
    # numbers that are free: of 1 .. (copies + taken) drop those whose name exists, and hand the rest out in order
    groups = numbered.where("k = 0 and n > 1").select("name", "n", stem.alias("stem"), ext.alias("ext"))
    taken = names.select(F.col("name").alias("other")).distinct()
    looks = taken.withColumn("base", F.concat(F.regexp_extract("other", r"^(.*) \([1-9][0-9]*\)(\.[^.]*)?$", 1), F.regexp_extract("other", r"^(.*) \([1-9][0-9]*\)(\.[^.]*)?$", 2)))
    rivals = looks.where("base <> ''").groupBy("base").agg(F.count("*").alias("rivals"), F.collect_set("other").alias("used"))
    free = groups.join(rivals, groups["name"] == rivals["base"], "left").select("name", F.filter(
        F.transform(F.sequence(F.lit(1), F.col("n").cast("int") - 1 + F.coalesce("rivals", F.lit(0)).cast("int")), lambda i: F.concat("stem", F.lit(" ("), i.cast("string"), F.lit(")"), "ext")),
        lambda c: ~F.coalesce(F.array_contains("used", c), F.lit(False)),
    ).alias("free"))
    rest = numbered.where("k > 0").join(free, "name").select("id", F.element_at("free", F.col("k").cast("int")).alias("unique_name"))
    return firsts.union(rest)
