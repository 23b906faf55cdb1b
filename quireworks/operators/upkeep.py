"""Table upkeep on snapshots: upserts, rebinding, cascades, bookmarks, notes, the text index.

Every operator returns the new state of a table.  `write_snapshot` makes a state durable: a new numbered folder, which
counts once its _SUCCESS file, written last, is there; a failed run leaves the old state in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.functions import text as T
from quireworks.session import stage  # noqa: F401


def upsert_by_uri(library: DataFrame, updates: DataFrame) -> DataFrame:
    """M1: new uris are inserted; known ones get title, format, size and last opened only.  The last update of a uri wins.

    New rows get ids behind the largest one, in order of uri.
    """
    last = updates.groupBy("uri").agg(F.max_by(F.struct("title", "format", "size_bytes", "opened_at"), F.struct("opened_at", "update_no")).alias("u"))
    joined = library.join(last, "uri", "left")
    keep = lambda c, u: F.coalesce(F.col(f"u.{u}"), F.col(c)).alias(c)
    known = joined.select("id", "uri", keep("title", "title"), keep("format", "format"), keep("size_bytes", "size_bytes"), keep("last_opened_at", "opened_at"), "created_at", "is_starred")
    fresh = last.join(library.select("uri"), "uri", "left_anti")
    top = library.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    numbered = _numbered(fresh, "uri")
    new = numbered.join(F.broadcast(top)).select(
        (F.col("top") + F.col("number")).alias("id"), "uri", "u.title", "u.format", "u.size_bytes", F.col("u.opened_at").alias("last_opened_at"),
        F.col("u.opened_at").alias("created_at"), F.lit(False).alias("is_starred"),
    )
    return known.unionByName(new)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    from quireworks.operators.catalog import ranked

    return ranked(df, F.asc(key)).withColumnRenamed("rank", "number")


def rebind_uri(library: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: a document takes a new uri only if it is free or its own; (library, refused requests).

    Of requests for the same uri the one of the smallest id wins, as one of them must.
    """
    owner = library.select(F.col("uri").alias("new_uri"), F.col("id").alias("owner"))
    judged = requests.join(owner, "new_uri", "left").join(library.select("id"), "id", "left_semi")
    free = F.col("owner").isNull() | (F.col("owner") == F.col("id"))
    first = F.row_number().over(W.partitionBy("new_uri").orderBy("id"))
    granted = judged.where(free).withColumn("r", first)
    accepted = granted.where("r = 1").select("id", "new_uri")
    refused = judged.where(~free).select("id", "new_uri").unionByName(granted.where("r > 1").select("id", "new_uri"))
    return library.join(accepted, "id", "left").withColumn("uri", F.coalesce("new_uri", "uri")).drop("new_uri"), refused


def set_column(library: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """M3: one column of the rows with these ids."""
    marked = library.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """M4: rows of the library and of every child table, gone by the same ids."""
    gone = ids.select("id").distinct()
    return {n: df.join(gone.select(F.col("id").alias("id" if n == "library" else "document_id")), "id" if n == "library" else "document_id", "left_anti") for n, df in tables.items()}


def replace_if_exists(doc_text: DataFrame, rows: DataFrame, parents: DataFrame) -> DataFrame:
    """M5: text rows replaced where the parent lives."""
    live = rows.join(parents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return doc_text.join(live.select("document_id"), "document_id", "left_anti").unionByName(live)


def save_progress(progress: DataFrame, samples: DataFrame, parents: DataFrame) -> DataFrame:
    """M6: the last sample of each living document replaces its row."""
    last = samples.groupBy("document_id").agg(F.max_by(F.struct("unit", "fraction", "zoom"), F.struct("ts", "event_id")).alias("s"))
    live = last.join(parents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", "s.unit", "s.fraction", "s.zoom")
    return progress.join(live.select("document_id"), "document_id", "left_anti").select("document_id", "unit", "fraction", "zoom").unionByName(live)


def _decide(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Candidates sorted by document and time: each against the spots accepted so far, at most `limit` of one document."""
    near = {1: 2 / T.LINES_PER_CHUNK, 2: 0.1}
    held, kept, n_kept = None, {}, 0
    for batch in batches:
        said = []
        for document, kind, unit, fraction in zip(*[batch.column(c).to_pylist() for c in ("document_id", "kind", "unit", "fraction")], strict=True):
            if document != held:
                held, kept, n_kept = document, {}, 0
            if kind in (0, 1, 2):
                spots = kept.setdefault((kind, unit), [])
                known = any(kind == 0 or abs(f - fraction) <= near[kind] for f in spots)
            else:  # offsets: near ones are up to 100 signs away
                spots = kept.setdefault((kind, None), [])
                known = any(abs(u - unit) <= 100 for u in spots)
            if known:
                said.append("ALREADY_BOOKMARKED")
            elif n_kept >= limit:
                said.append("LIMIT_REACHED")
            else:
                spots.append(fraction if kind in (0, 1, 2) else unit)
                n_kept += 1
                said.append("ADD")
        yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("candidate_id"), pa.array(said, pa.string())], ["document_id", "candidate_id", "decision"])


def bookmark_dedupe(candidates: DataFrame, limit: int = 200) -> DataFrame:
    """M7: candidates of one document in order: near an accepted one ALREADY_BOOKMARKED, beyond the limit LIMIT_REACHED, else ADD.

    Candidates are dealt by document and sorted by time; only the accepted spots of the one being read are held.
    """
    rows = candidates.select("document_id", F.col("candidate_id").cast("long").alias("candidate_id"), "ts", F.col("kind").cast("int").alias("kind"), F.col("unit").cast("long").alias("unit"), F.col("fraction").cast("double").alias("fraction"))
    ordered = rows.repartition("document_id").sortWithinPartitions("document_id", "ts", "candidate_id")
    kind = rows.schema["document_id"].dataType.simpleString()
    return ordered.mapInArrow(lambda it: _decide(it, limit), f"document_id {kind}, candidate_id long, decision string")


def restore_bookmark(bookmarks: DataFrame, undone: DataFrame, parents: DataFrame) -> DataFrame:
    """M8: undone rows come back unless their id exists or their document does not."""
    back = undone.join(parents.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(bookmarks.select("id"), "id", "left_anti")
    return bookmarks.unionByName(back)


def set_note(highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """M9: cleaned notes; a mark without one is a highlight (1), else a note (2)."""
    clean = F.nullif(F.left(F.trim(F.regexp_replace("note", r"\s+", " ")), F.lit(1000)), F.lit(""))
    joined = highlights.join(notes.select("id", clean.alias("note"), F.lit(True).alias("set")), "id", "left")
    kind = F.when(F.col("set"), F.when(F.col("note").isNull(), 1).otherwise(2)).otherwise(F.col("kind"))
    return joined.withColumn("kind", kind).drop("set")


def outline_cache_valid(outlines: DataFrame, library: DataFrame, mtimes: DataFrame, version: int) -> DataFrame:
    """A cached outline holds while size, time (known) and version are the same."""
    joined = outlines.join(library.select(F.col("id").alias("document_id"), "size_bytes"), "document_id").join(mtimes.select(F.col("id").alias("document_id"), "mtime"), "document_id", "left")
    same = (F.col("source_size") == F.col("size_bytes")) & (F.col("source_modified") != 0) & (F.col("source_modified") == F.coalesce("mtime", F.lit(0))) & (F.col("cache_version") == version)
    return joined.select("document_id", same.alias("valid"))


def save_to_library(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """What each incoming copy does: touch an exact duplicate of its title, re-point a row of its uri, or insert."""
    twins = library.groupBy("title", "size_bytes", "hash").agg(F.min("id").alias("twin"))
    at = library.select("uri", F.col("id").alias("same_uri"))
    joined = incoming.join(twins, ["title", "size_bytes", "hash"], "left").join(at, "uri", "left")
    action = F.when(F.col("twin").isNotNull(), "touch").when(F.col("same_uri").isNotNull(), "re-point").otherwise("insert")
    return joined.select("incoming_id", F.coalesce("twin", "same_uri").alias("id"), action.alias("action"))


def schema_v2(df: DataFrame) -> DataFrame:
    """The column the second schema has, 0 where it is missing."""
    return df if "source_modified" in df.columns else df.withColumn("source_modified", F.lit(0).cast("long"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """A table kept by replace_rows(), or None where there is none yet."""
    fs, at = _fs(spark, path)
    return spark.read.parquet(path).drop("bucket") if fs.exists(at) and len(fs.listStatus(at)) else None


def replace_rows(fresh: DataFrame, keys: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Replace all rows of the keys by the fresh ones in a table of hash buckets; only buckets of these keys are rewritten.

    New files of a bucket take the old ones' place when the write ends, so a failed write leaves the table as it was, and
    one that is repeated comes to the same end.
    """
    spark, bucket = fresh.sparkSession, _bucket(key, buckets)
    touched = [r["b"] for r in keys.select(bucket.alias("b")).distinct().collect()]
    new = fresh.withColumn("bucket", bucket)
    if read_rows(spark, path) is not None:
        known = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        new = known.join(keys.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
    kept = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    spread = new.repartition("bucket", F.pmod(F.xxhash64(*[c for c in new.columns if c != "bucket"]), F.lit(4)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - kept:
        fs, at = _fs(spark, f"{path}/bucket={b}")
        fs.delete(at, True)


def write_text_index(rows: DataFrame, parents: DataFrame, path: str, buckets: int = 64) -> int:
    """Replace text rows whose parent lives; returns how many were written."""
    live = rows.join(parents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    replace_rows(live, live.select("document_id"), "document_id", path, buckets)
    return live.count()


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest finished snapshot: Spark marks a folder finished by its _SUCCESS file, written last."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def write_snapshot(df: DataFrame, path: str) -> int:
    version = (current_version(df.sparkSession, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    return version
