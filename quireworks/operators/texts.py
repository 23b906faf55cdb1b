"""Documents to rows: chunks, paragraphs, blocks, outlines, links, matches, and statistics of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.functions import text as T
from quireworks.functions.encodings import guessed
from quireworks.operators.markup import html_blocks, lay_tables, page_rows

# --- sources and sinks ---


def decoded(content: Column, cut: Column | None = None) -> tuple[Column, Column]:
    """(encoding, text) of a file's bytes: byte order mark, UTF-16 by its zero bytes, strict UTF-8, the likeliest legacy
    encoding, else windows-1252.  Only bytes that come as far as the guess are sent to Python.

    cut: whether the bytes are the head of a longer file, which may end inside a character; that one is left out.
    """
    cut = F.lit(False) if cut is None else cut
    head = F.substring(content, 1, 8192)
    pairs = F.regexp_extract_all(F.hex(head), F.lit("(....)"), F.lit(1))
    n = F.size(pairs)
    high, low = F.size(F.filter(pairs, lambda p: F.startswith(p, F.lit("00")))), F.size(F.filter(pairs, lambda p: F.endswith(p, F.lit("00"))))
    lopsided = lambda a, b: (n > 0) & (a >= 0.1 * n) & (a >= 10 * b)
    named, behind = T.mark_of(content)
    plain = F.when(lopsided(low, high), "UTF-16LE").when(lopsided(high, low), "UTF-16BE").when(T.valid_utf8(content, cut), "UTF-8")
    sure = F.coalesce(named, plain)
    legacy = guessed(content, cut, sure.isNull())
    encoding = F.when(content.isNotNull(), F.coalesce(sure, legacy["encoding"]))
    text = F.coalesce(legacy["text"], T.in_encoding(behind, encoding))
    # a cut character decodes to replacement signs at the end
    return encoding, F.when(cut & encoding.startswith("UTF"), F.regexp_replace(text, "\uFFFD{1,3}$", "")).otherwise(text)


def read_text_corpus(spark: SparkSession, path: str, max_source_bytes: int = 8_388_608, max_chars: int = 1_000_000) -> DataFrame:
    """Text files as rows: path, text, encoding, truncated.  Files over 64 MB are refused by their size, before they are read."""
    files = spark.read.format("binaryFile").load(path).where("length <= 67108864")
    return from_bytes(files, max_source_bytes, max_chars)


def from_bytes(files: DataFrame, max_source_bytes: int = 8_388_608, max_chars: int = 1_000_000) -> DataFrame:
    head = F.substring(F.col("content"), 1, max_source_bytes)
    encoding, text = decoded(head, F.length("content") > max_source_bytes)
    cut = (F.length("content") > max_source_bytes) | (F.length(text) > max_chars)
    return files.select("path", F.left(text, F.lit(max_chars)).alias("text"), encoding.alias("encoding"), cut.alias("truncated"))


def read_delimited_corpus(spark: SparkSession, path: str, max_cells: int = 200_000) -> DataFrame:
    """Delimited files as cells: path, row_no, col_no, value, truncated, the delimiter sniffed per file."""
    files = read_text_corpus(spark, path)
    rows = files.withColumn("delimiter", sniff_delimiter(F.col("path"), F.col("text")))
    return delimited_cells(rows, max_cells)


def delimited_cells(rows: DataFrame, max_cells: int = 200_000) -> DataFrame:
    parsed = rows.withColumn("t", split_delimited(F.col("text"), F.col("delimiter"), max_cells=max_cells))
    lines = parsed.select("path", F.col("t.truncated").alias("truncated"), F.posexplode("t.rows").alias("row_no", "cells"))
    return lines.select("path", "row_no", F.posexplode("cells").alias("col_no", "value"), "truncated")


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def redacted_rows(df: DataFrame, text_col: str, roots: list[str], keep: int = 20, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key)).limit(keep).withColumn(text_col, T.redact(F.col(text_col), roots))


def write_redacted(df: DataFrame, path: str, text_col: str, roots: list[str], keep: int = 20, key: str = "id") -> None:
    redacted_rows(df, text_col, roots, keep, key).write.mode("overwrite").json(path)


# --- lines, chunks, paragraphs, units ---


def line_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


def line_stats(docs: DataFrame) -> DataFrame:
    lines = T.lines(F.col("text"))
    n = F.size(lines).cast("long")
    return docs.select("doc_id", n.alias("lines"), F.when(F.element_at(lines, -1) == "", n - 1).otherwise(n).alias("numbered_lines"), F.array_max(F.transform(lines, T.columns_of)).cast("long").alias("max_columns"))


def _chunks(text: Column, per: int = T.LINES_PER_CHUNK) -> Column:
    """Chunks of lines joined by newlines, as an array; an empty last line does not start a chunk of its own."""
    def of(lines: Column) -> Column:
        n = F.size(lines)
        used = F.when((n > 1) & (F.element_at(lines, -1) == "") & ((n - 1) % per == 0), n - 1).otherwise(n)
        first = F.sequence(F.lit(0), F.floor((used - 1) / per).cast("int"))
        return F.transform(first, lambda i: F.array_join(F.slice(lines, i * per + 1, F.least(F.lit(per), used - i * per)), "\n"))

    # one lambda, so that the lines are split once
    return F.element_at(F.transform(F.array(T.lines(text)), of), 1)


def chunk_lines(docs: DataFrame, per: int = T.LINES_PER_CHUNK) -> DataFrame:
    """Chunks of lines joined by newlines: doc_id, chunk_no, text.  Built in the row, without a shuffle.

    An empty document is one empty chunk; an empty last line does not start a chunk of its own.
    """
    return docs.select("doc_id", F.posexplode(_chunks(F.col("text"), per)).alias("chunk_no", "text")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


def chunk_line_numbers(chunks: DataFrame, per: int = T.LINES_PER_CHUNK) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", (F.col("chunk_no") * per + 1).alias("first_line"))


def chunk_offsets(docs: DataFrame, per: int = T.LINES_PER_CHUNK) -> DataFrame:
    """Chunks with the place of their first sign in the document: doc_id, chunk_no, text, start_offset.  Added up in the row."""
    def starts(chunks: Column) -> Column:
        # a chunk begins where the one before and its line end are over
        return F.slice(F.array_prepend(T.running_sums(F.transform(chunks, lambda c: F.length(c).cast("long") + 1)), F.lit(0).cast("long")), F.lit(1), F.size(chunks))

    rows = docs.select("doc_id", _chunks(F.col("text"), per).alias("chunks"))
    placed = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("chunks").alias("text"), starts(F.col("chunks")).alias("start_offset"))).alias("chunk_no", "c"))
    return placed.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "c.text", "c.start_offset")


#: Lines that are not blank, one after another, with their ends
_PARAGRAPH = r"(?:[^\S\r\n]*+[^\s][^\r\n]*+(?:\r\n?|\n|\z))++"


def _paragraphs(text: Column) -> Column:
    """An array of paragraphs: start and end (of what is not blank) and text, each line trimmed, joined by one space."""
    def unit(r: Column, raw: Column) -> Column:
        start = r["start"] + F.length(F.regexp_extract(raw, r"^\s*", 0))
        lines = F.transform(F.split(raw, r"\r\n?|\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        end = r["start"] + F.length(F.regexp_replace(raw, r"\s+$", ""))
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.array_join(F.filter(lines, lambda x: x != ""), " ").alias("text"))

    hits = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0))
    return T.let(hits, lambda found: F.zip_with(T.placed(F.split(text, _PARAGRAPH, -1), found), found, unit))


def paragraph_units(docs: DataFrame) -> DataFrame:
    """Runs of lines that are not blank: doc_id, para_no, start, end, text.  Found in the row, without a shuffle."""
    rows = docs.select("doc_id", F.posexplode(_paragraphs(F.col("text"))).alias("para_no", "p"))
    return rows.select("doc_id", F.col("para_no").cast("long").alias("para_no"), "p.start", "p.end", "p.text")


def _units(rows: DataFrame, pieces: Column) -> DataFrame:
    """Units of an array of (anchor, text), numbered through: doc_id, unit_no, anchor, start, text."""
    of = lambda p: F.transform(_paragraphs(p["text"]), lambda x: F.struct(p["anchor"].cast("long").alias("anchor"), x["start"].alias("start"), x["text"].alias("text")))
    units = rows.select("doc_id", F.posexplode(F.flatten(F.transform(pieces, of))).alias("unit_no", "u"))
    return units.select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "u.anchor", "u.start", "u.text")


def speakable_units(docs: DataFrame, per: int = T.LINES_PER_CHUNK) -> DataFrame:
    """D3 for text in chunks: every paragraph of every chunk, anchored by the chunk: doc_id, unit_no, anchor, start, text."""
    return _units(docs, F.transform(_chunks(F.col("text"), per), lambda c, i: F.struct(i.alias("anchor"), c.alias("text"))))


def speakable_markdown(docs: DataFrame) -> DataFrame:
    """D3 for Markdown: every paragraph of the text, anchored by its own offset."""
    return paragraph_units(docs).select("doc_id", F.col("para_no").alias("unit_no"), F.col("start").alias("anchor"), F.lit(0).cast("long").alias("start"), "text")


def speakable_blocks(pages: DataFrame) -> DataFrame:
    """D3 for blocks: every paragraph of every block, images by what stands for them, a table row by row as one, anchored
    by the block; dividers are silent, and pages numbered as documents."""
    spoken = F.filter("blocks", lambda b: b["kind"] != "DIVIDER")
    said = lambda b: F.when(b["kind"] == "TABLE", F.array_join(F.filter(F.split(b["text"], "\n"), lambda row: F.trim(row) != ""), " ")).otherwise(b["text"])
    rows = page_rows(pages).withColumnRenamed("page_id", "doc_id")
    return _units(rows, F.transform(spoken, lambda b: F.struct(b["block_no"].alias("anchor"), said(b).alias("text"))))


def unit_prefix_counts(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units before each chunk: doc_id, chunk_no, first_unit; one more row per document holds the total."""
    per = units.groupBy("doc_id", F.col("anchor").alias("chunk_no")).agg(F.count("*").alias("n"))
    grid = chunks.select("doc_id", "chunk_no").join(per, ["doc_id", "chunk_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = grid.groupBy("doc_id").agg((F.max("chunk_no") + 1).alias("chunk_no"), F.lit(0).cast("long").alias("n"))
    before = W.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    return grid.unionByName(ends).select("doc_id", "chunk_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_unit"))


def join_asof_unit(units: DataFrame, locations: DataFrame) -> DataFrame:
    """The unit a location starts at: by offset (kind 3) the last unit at or before it, else the first at or after it.

    One sort per document carries anchors to the locations between them; no pair of rows is formed.
    """
    u = units.select("doc_id", F.col("anchor").alias("at"), "unit_no", F.lit(None).cast("long").alias("location_id"), F.lit(None).cast("int").alias("kind"))
    last = units.groupBy("doc_id").agg(F.max("unit_no").alias("last_unit"))
    at = locations.select("doc_id", F.col("position").alias("at"), F.lit(None).cast("long").alias("unit_no"), "location_id", "kind")
    both = u.withColumn("side", F.lit(1)).unionByName(at.withColumn("side", F.when(F.col("kind") == 3, 2).otherwise(0)))
    back = W.partitionBy("doc_id").orderBy("at", "side", "unit_no").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("doc_id").orderBy("at", "side", "unit_no").rowsBetween(0, W.unboundedFollowing)
    seen = both.withColumn("before", F.last("unit_no", ignorenulls=True).over(back)).withColumn("after", F.first("unit_no", ignorenulls=True).over(ahead))
    rows = seen.where("location_id is not null").join(last, "doc_id")
    return rows.select("location_id", F.when(F.col("kind") == 3, F.coalesce("before", F.lit(0))).otherwise(F.coalesce("after", "last_unit")).cast("long").alias("unit_no"))


def join_asof_chunk(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk an offset lies in: doc_id, chunk_no, chunk_offset, offset; the same one-sort way."""
    c = chunks.select("doc_id", F.col("start_offset").alias("at"), "chunk_no", F.lit(0).alias("side"))
    m = matches.select("doc_id", F.col("offset").alias("at"), F.lit(None).cast("long").alias("chunk_no"), F.lit(1).alias("side"))
    back = W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    here = F.last(F.when(F.col("side") == 0, F.struct("chunk_no", "at")), ignorenulls=True).over(back)
    rows = c.unionByName(m).withColumn("here", here).where("side = 1")
    return rows.select("doc_id", F.col("here.chunk_no").alias("chunk_no"), (F.col("at") - F.col("here.at")).alias("chunk_offset"), F.col("at").alias("offset"))


# --- matches ---


def find_rows(docs: DataFrame, query: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.find_offsets(F.col("text"), query)).alias("hit_no", "r")).select("doc_id", "hit_no", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def find_counts(docs: DataFrame, query: str) -> DataFrame:
    return docs.select("doc_id", T.find_count(F.col("text"), T.normalize_needle(query)).alias("n")).where("n > 0")


def match_pages(pages: DataFrame, query: str, hidden: list[int] | None = None) -> DataFrame:
    """One row per occurrence, pages in order, hidden ones skipped: doc_id, page, hit_no."""
    shown = pages.where(~F.col("page").isin(hidden)) if hidden else pages
    counted = shown.select("doc_id", "page", T.find_count(F.col("text"), query).cast("int").alias("n")).where("n > 0")
    return counted.select("doc_id", "page", F.explode(F.sequence(F.lit(1), "n")).alias("hit_no"))


def join_span_cover(direct: DataFrame, linked: DataFrame) -> DataFrame:
    """Link ranges no direct match overlaps, each once: doc_id, start, end.

    A sweep over each document: matches stand at their starts, links at their ends (before matches that start there), and
    a link is overlapped if the largest end of the matches so far lies behind its start.  One sort; no pairs are formed.
    """
    d = direct.select("doc_id", F.lit(None).cast("int").alias("start"), F.col("end").alias("reach"), F.col("start").alias("at"), F.lit(1).alias("side"))
    links = linked.select("doc_id", "start", F.lit(None).cast("int").alias("reach"), F.col("end").alias("at"), F.lit(0).alias("side")).distinct()
    so_far = F.max("reach").over(W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, -1))
    free = links.unionByName(d).withColumn("so_far", so_far).where("side = 0 and (so_far is null or so_far <= start)")
    return free.select("doc_id", "start", F.col("at").alias("end"))


def corpus_feature_survey(files: DataFrame, features: dict[str, Column]) -> DataFrame:
    """For each feature the number and share of files that have it: rank, feature, n, share.  One pass, one row of sums."""
    sums = files.agg(F.count("*").alias("__all"), *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in features.items()])
    rows = sums.select("__all", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in features])).alias("f"))
    flat = rows.select("f.feature", "f.n", (F.col("f.n") / F.col("__all")).alias("share"))
    # as many rows as features
    return flat.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "feature")))


# --- delimited text ---


def delimiter_mode(lines: DataFrame, candidates: str = ",;\t|") -> DataFrame:
    """The most common field count of each candidate over a document's lines, and its share; quoted cells are one field."""
    pairs = lines.select("doc_id", "line", F.posexplode(F.array(*map(F.lit, candidates))).alias("no", "delimiter"))
    d = _literal(F.col("delimiter"))
    # a line's fields: every match but one ends in a delimiter
    seps = F.regexp_extract_all("line", F.concat(F.lit("\\G"), _cell(d), F.lit("("), d, F.lit(")")), F.lit(1))
    counted = pairs.groupBy("doc_id", "no", "delimiter", (F.size(seps) + 1).cast("long").alias("fields")).agg(F.count("*").alias("n"))
    best = counted.groupBy("doc_id", "no", "delimiter").agg(F.max(F.struct("n", "fields")).alias("b"), F.sum("n").alias("rows"))
    return best.select("doc_id", "no", "delimiter", F.col("b.fields").alias("fields"), (F.col("b.n") / F.col("rows")).alias("share"))


def _cell(d: Column) -> Column:
    """A pattern for one cell: quoted, with what follows the closing quote, or without a quote at its start."""
    free = F.concat(F.lit("(?:(?!"), d, F.lit(")[^\\r\\n])*+"))
    return F.concat(F.lit('(?:"(?:[^"]|"")*+(?:"|\\z)'), free, F.lit('|(?!")'), free, F.lit(")"))


def _literal(delimiter: Column) -> Column:
    return F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))


def _raw_rows(text: Column, delimiter: Column) -> Column:
    """Rows of delimited text as arrays of cells as they stand, quotes included; rows without a sign are left out."""
    d = _literal(delimiter)
    cell = _cell(d)
    row = F.concat(F.lit("\\G((?:"), cell, d, F.lit(")*+"), cell, F.lit(")(?:\\r\\n?|\\n|\\z)"))
    rows = F.filter(F.regexp_extract_all(text, row, F.lit(1)), lambda r: r != "")
    # a delimiter in front makes every cell end where the next begins
    return F.transform(rows, lambda r: F.regexp_extract_all(F.concat(delimiter, r), F.concat(F.lit("\\G"), d, F.lit("("), cell, F.lit(")")), F.lit(1)))


def sniff_delimiter(name: Column, text: Column, candidates: str = ",;\t|", rows: int = 50, head: int = 65_536) -> Column:
    """a tab for .tsv, else the delimiter whose most common field count (2 or more) covers the largest share of the
    first rows, the earlier of equals; quoted cells hold delimiters and line ends, and the sample ends with a whole line."""
    sample = F.left(text, F.lit(head))
    kept = F.when((F.length(text) > head) & (F.instr(F.substring(sample, F.lit(2), F.lit(head)), "\n") > 0), F.regexp_replace(sample, r"\n[^\n]*\z", "")).otherwise(sample)

    def score(i: int, d: str) -> Column:
        counts = F.transform(F.slice(_raw_rows(kept, F.lit(d)), 1, rows), lambda r: F.size(r))

        def best_of(sizes: Column) -> Column:
            best = F.array_max(F.transform(F.array_distinct(sizes), lambda c: F.struct(F.size(F.filter(sizes, lambda x: x == c)).alias("n"), c.alias("fields"))))
            share = F.when(best["fields"] >= 2, best["n"] / F.size(sizes)).otherwise(0.0)
            return F.struct(F.coalesce(share, F.lit(0.0)).alias("share"), F.lit(-i).alias("order"), F.lit(d).alias("d"))

        return F.element_at(F.transform(F.array(counts), best_of), 1)

    best = F.element_at(F.transform(F.array(F.array_max(F.array(*[score(i, d) for i, d in enumerate(candidates)]))), lambda b: F.when(b["share"] > 0, b["d"]).otherwise(",")), 1)
    return F.when(F.lower(name).endswith(".tsv"), "\t").otherwise(best)


def split_delimited(text: Column, delimiter: Column, max_cells: int = 200_000, max_columns: int = 1024, max_chars: int = 10_000, cut: bool = False) -> Column:
    """rows of cells of delimited text, and whether anything was cut off.

    A quote opens only at a cell's start, two quotes inside are one, quoted cells hold delimiters and line ends; what
    follows a closing quote is taken as it is.  Blank lines and a byte order mark are skipped, long cells end in an
    ellipsis, rows end at max_columns and the table behind the row that reaches max_cells; `cut` drops a last row the
    sample may have cut.
    """
    quoted = r'(?s)^"((?:[^"]|"")*+)(?:"|\z)'

    def clean(v: Column) -> Column:
        plain = F.when(F.startswith(v, F.lit('"')), F.concat(F.replace(F.regexp_extract(v, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_replace(v, quoted, ""))).otherwise(v)
        return F.when(F.length(plain) > max_chars, F.concat(F.left(plain, F.lit(max_chars)), F.lit("…"))).otherwise(plain)

    def count(acc: Column, cells: Column) -> Column:
        fits = acc["n"] < max_cells
        return F.struct((acc["n"] + F.least(F.size(cells), F.lit(max_columns))).alias("n"), (acc["rows"] + fits.cast("int")).alias("rows"), (~fits).alias("full"), (acc["wide"] | (F.size(cells) > max_columns)).alias("wide"))

    def finish(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("rows"), F.lit(False).alias("full"), F.lit(False).alias("wide"))
        return F.element_at(F.transform(F.array(F.aggregate(rows, start, count)), lambda seen: F.struct(
            F.transform(F.slice(rows, F.lit(1), F.greatest(seen["rows"] - int(cut), F.lit(0))), lambda r: F.transform(F.slice(r, 1, max_columns), clean)).alias("rows"),
            (seen["full"] | seen["wide"] | F.lit(cut)).alias("truncated"),
        )), 1)

    return F.element_at(F.transform(F.array(_raw_rows(F.regexp_replace(text, "^\ufeff", ""), delimiter)), finish), 1)


# --- web pages ---

def blocks_to_text(blocks: DataFrame, max_chars: int = 1_000_000) -> DataFrame:
    """One line per block that is not blank, a table's cells row by row, joined by spaces."""
    line = F.when(F.col("kind") == "TABLE", F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    rows = blocks.select("page_id", "block_no", line.alias("text")).where(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(F.col("page_id").alias("doc_id")).agg(F.left(joined, F.lit(max_chars)).alias("text"))


def outline_from_headings(blocks: DataFrame) -> DataFrame:
    """Headings with a title: doc_id, pos, target, depth, title."""
    title = F.nullif(F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(200)), F.lit(""))
    rows = blocks.where("kind = 'HEADING'").select(F.col("page_id").alias("doc_id"), F.col("block_no").alias("target"), F.col("level").alias("depth"), title.alias("title")).where("title is not null")
    pos = (F.row_number().over(W.partitionBy("doc_id").orderBy("target")) - 1).cast("long")
    return outline_relative_depth(rows.withColumn("pos", pos)).select("doc_id", "pos", "target", "depth", "title")


def outline_relative_depth(outline: DataFrame, most: int = 5) -> DataFrame:
    least = F.min("depth").over(W.partitionBy("doc_id"))
    return outline.withColumn("depth", F.least(F.greatest(F.col("depth") - least, F.lit(0)), F.lit(most)))


def outline_has_children(outline: DataFrame) -> DataFrame:
    after = F.lead("depth").over(W.partitionBy("doc_id").orderBy("pos"))
    return outline.select("doc_id", "pos", "depth", F.coalesce(after > F.col("depth"), F.lit(False)).alias("has_children"))


def outline_visible(outline: DataFrame, folds: DataFrame) -> DataFrame:
    """Entries no folded one hides.

    An entry is hidden when a folded one before it is less deep than every entry from there on up to it: the entry's
    chain of parents, found level by level with one window each, decides; the depth is at most 6.
    """
    marked = outline.select("doc_id", "pos", "depth").join(folds.select("doc_id", "pos", F.lit(True).alias("fold")), ["doc_id", "pos"], "left")
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    hidden = F.lit(False)
    for d in range(6):
        # the last entry before at depth d or less; it is a parent only if it has depth d exactly and lies above
        parent = F.last(F.when(F.col("depth") <= d, F.struct(F.col("depth").alias("depth"), F.coalesce("fold", F.lit(False)).alias("fold"))), ignorenulls=True).over(before)
        hidden = hidden | F.coalesce((F.col("depth") > d) & (parent["depth"] == d) & parent["fold"], F.lit(False))
    return marked.withColumn("hidden", hidden).where("not hidden").select("doc_id", "pos")


def outline_initial_folds(outline: DataFrame, above: int = 60) -> DataFrame:
    counted = outline_has_children(outline).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    return counted.where((F.col("n") > above) & F.col("has_children")).select("doc_id", "pos")


def outline_sections(slides: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of slides: the section's name at its first slide at depth 0, its other slides at depth 1: target, depth, title."""
    first = sections.groupBy("section_id", "name").agg(F.min("slide").alias("target"))
    heads = first.select("target", F.lit(0).alias("depth"), F.col("name").alias("title"))
    rest = slides.join(sections.select("slide", "section_id"), "slide", "left").join(first.select("section_id", F.col("target").alias("head")), "section_id", "left")
    rest = rest.where("head is null or slide <> head").select(F.col("slide").alias("target"), F.when(F.col("head").isNull(), 0).otherwise(1).alias("depth"), "title")
    return heads.unionByName(rest)


def link_edges(pages: DataFrame) -> DataFrame:
    """Anchors as edges: page_id, pos, label, target, internal, host."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("pos", "tag"))
    read = rows.select(
        "page_id", "pos", F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("own"),
        T.decode_entities(F.regexp_extract("tag", r"(?is)\bhref=\"([^\"]*)\"", 1)).alias("href"),
        F.trim(F.regexp_replace(T.decode_entities(F.regexp_replace("tag", "<[^>]*>", "")), r"\s+", " ")).alias("label"),
    )
    href = F.col("href")
    led = read.withColumns({"safe": T.safe_link(F.when(href.rlike("^(?i)(https?|mailto|tel):"), href)), "path": T.resolve_path(F.lit(""), href)})
    there = F.lower(F.regexp_extract("safe", r"^[A-Za-z]+://([^/?#:]+)", 1))
    edge = F.struct(
        "label", F.coalesce("safe", "path").alias("target"), F.col("safe").isNull().alias("internal"), F.when(F.col("safe").isNull(), F.col("own")).otherwise(there).alias("host")
    )
    # dropped here, because a filter would be pushed below and repeat the expressions above it
    return led.select("page_id", "pos", F.inline(F.filter(F.array(edge), lambda e: e["target"].isNotNull())))


def table_cells(pages: DataFrame) -> DataFrame:
    """Cells of tables on their grid: page_id, table_no, row_no, column, colspan, rowspan, text.

    Spans are at most 64.  A cell stands in the first column that neither the cells before it in its row nor cells from
    above that reach down take; rows are laid in order within one table.
    """
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.posexplode(tables).alias("table_no", "t")).select("page_id", "table_no", F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\z)"), F.lit(1)).alias("trs"))
    span = lambda c, name: F.least(F.greatest(F.coalesce(F.regexp_extract(c, rf"(?is)^<t[dh]\b[^>]*\b{name}=\"?([0-9]+)", 1).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(64))
    words = lambda c: F.trim(F.regexp_replace(T.decode_entities(F.regexp_replace(c, "<[^>]*>", "")), r"\s+", " "))
    cell = lambda c: F.struct(span(c, "colspan").alias("colspan"), span(c, "rowspan").alias("rowspan"), words(c).alias("text"))
    cells = F.transform("trs", lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b.*?(?=<t[dh]\b|\z)"), F.lit(0)), cell))
    return rows.select("page_id", "table_no", cells.alias("cells")).mapInArrow(lay_tables, "page_id long, table_no int, row_no int, column int, colspan int, rowspan int, text string")


def block_find(blocks: DataFrame, query: str) -> DataFrame:
    """Hits per block: doc_id, block_no, hit_no.  Images and dividers have none; a match lies within one cell.

    Blocks may have a column `spans` of links (start, end, link), else D4's own links that lead out are taken: one whose
    target holds the query is a hit too, once per range, where no hit of the text touches it.
    """
    direct = T.find_offsets(F.col("text"), query)
    n = F.size(direct)
    if "spans" in blocks.columns or "links" in blocks.columns:
        spans = F.col("spans") if "spans" in blocks.columns else F.filter(F.transform("links", lambda x: F.struct(x["start"], x["end"], T.safe_link(x["link"]).alias("link"))), lambda x: x["link"].isNotNull())
        length = F.length("text")
        cut = F.transform(spans, lambda x: F.struct(F.least(F.greatest(x["start"], F.lit(0)), length).cast("int").alias("start"), F.least(x["end"], length).cast("int").alias("end"), x["link"].alias("link")))
        leads = F.filter(cut, lambda x: (x["end"] > x["start"]) & (T.find_count(x["link"], query) > 0) & ~F.exists(direct, lambda d: (d["start"] < x["end"]) & (x["start"] < d["end"])))
        n = n + F.size(F.array_distinct(F.transform(leads, lambda x: F.struct(x["start"], x["end"]))))
    if "cells" in blocks.columns:
        inside = F.aggregate("cells", F.lit(0), lambda acc, c: acc + T.find_count(c["text"], query).cast("int"))
        n = F.when(F.col("kind") == "TABLE", inside).otherwise(n)
    counted = blocks.where(~F.col("kind").isin("IMAGE", "DIVIDER")).select(F.col("page_id").alias("doc_id"), "block_no", n.alias("n")).where("n > 0")
    return counted.select("doc_id", "block_no", F.explode(F.sequence(F.lit(1), "n")).alias("hit_no"))


def classify_index_state(library: DataFrame) -> DataFrame:
    """TOO_LARGE, SKIPPED or FAILED by size and flags, else INDEXED: id, state."""
    state = F.when(F.col("size_bytes") > 67_108_864, "TOO_LARGE").when(F.col("encrypted") | ~F.col("readable"), "SKIPPED").when(F.col("broken"), "FAILED").otherwise("INDEXED")
    return library.select("id", state.alias("state"))


def rule_precedence(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """For each element and property the value of the most specific rule, then of the last: element_id, property, value.

    rules: tag, id, class (null: any), specificity by 1, 100 and 10 for what they name, order, property, value.
    """
    keyed = rules.withColumn("specificity", F.when(F.col("id").isNotNull(), 100).otherwise(0) + F.when(F.col("class").isNotNull(), 10).otherwise(0) + F.when(F.col("tag").isNotNull(), 1).otherwise(0))
    e = elements.select("element_id", F.col("tag").alias("e_tag"), F.col("id").alias("e_id"), "classes")
    # rules meet elements by the most telling key they name, so each join is an equality
    by_id = e.join(keyed.where("id is not null"), F.col("e_id") == F.col("id"))
    by_class = e.withColumn("c", F.explode("classes")).join(keyed.where("id is null and class is not null"), F.col("c") == F.col("class")).drop("c")
    by_tag = e.join(keyed.where("id is null and class is null"), F.col("e_tag") == F.col("tag"))
    fits = (F.col("tag").isNull() | (F.col("tag") == F.col("e_tag"))) & (F.col("class").isNull() | F.array_contains("classes", F.col("class")))
    met = by_id.unionByName(by_class).unionByName(by_tag).where(fits)
    return met.groupBy("element_id", "property").agg(F.max_by("value", F.struct("specificity", "order")).alias("value"))


def first_reference_numbers(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Numbers by first citation; later definitions of a key are ignored, uncited ones come last: doc_id, key, number."""
    first_def = defs.groupBy("doc_id", "key").agg(F.min("def_no").alias("def_no"))
    cited = refs.groupBy("doc_id", "key").agg(F.min("pos").alias("first_pos"))
    order = W.partitionBy("doc_id").orderBy(F.asc_nulls_last("first_pos"), "def_no")
    return first_def.join(cited, ["doc_id", "key"], "left").select("doc_id", "key", F.row_number().over(order).alias("number"))


def list_numbering(items: DataFrame) -> DataFrame:
    """Markers of ordered lists: a number runs on from the list's start or the last explicit value: list_id, pos, marker."""
    order = W.partitionBy("list_id").orderBy("pos")
    groups = items.withColumn("g", F.count("value").over(order))
    within = W.partitionBy("list_id", "g").orderBy("pos")
    number = F.coalesce(F.first("value").over(within), F.first("start").over(within)) + F.row_number().over(within) - 1
    return groups.select("list_id", "pos", T.list_number(number, F.col("format")).alias("marker"))
