"""Several tables that change together: copy-on-write of hash buckets under one manifest, which is replaced last."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.operators import upkeep
from quireworks.sources.manifests import Manifests, children, delete_path

#: Tables that hold what belongs to a document, and the column that says whose it is
CHILDREN = {"reading_progress": "document_id", "bookmarks": "document_id", "highlights": "document_id", "pdf_outlines": "document_id", "document_text": "document_id"}
#: Rows a bucket should not exceed by much; buckets are doubled when their mean does
ROWS = 1_000_000


class Store:
    """Tables at `path`, each in hash buckets of its key.

    The manifest names, for every table, its schema, its number of buckets and the folder of each bucket.  A change
    writes new folders for the buckets it touches, of all its tables, and then one manifest; until that has its name,
    readers see all tables as they were, and a change that failed half-way has changed nothing.  Of two changes that
    began from the same state, the second is refused.  Folders that no state names are deleted by vacuum().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/manifest")

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of now; the frame keeps reading that state while later ones are made."""
        return self._read(self.manifests.read()[1], table, buckets)

    def _read(self, state: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        kept = state[table]
        folders = [f"{self.path}/{folder}/bucket={b}" for b, folder in kept["folders"].items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(kept["schema"])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], kept["schema"])

    def create(self, tables: dict[str, tuple[DataFrame, str]], buckets: int = 16) -> None:
        """Make tables: {name: (rows, key column)}."""
        number, state = self.manifests.read()
        made = {}
        for name, (rows, key) in tables.items():
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            made[name] = {"key": key, "schema": schema, "buckets": buckets, "folders": {}}
            made[name]["folders"] = self._write(name, rows, made[name], list(range(buckets)))
        self.manifests.commit(number, state | made)

    def _bucket(self, kept: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(kept["key"]).cast("string")), F.lit(kept["buckets"])).cast("int")

    def _write(self, table: str, rows: DataFrame, kept: dict, touched: list[int]) -> dict[str, str]:
        """Write the rows of these buckets into a new folder: bucket to folder, without buckets that have no rows."""
        folder = f"{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket(kept))
        # a bucket is dealt over some tasks by its rows, so that no task holds all of a large one
        spread = dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4)))
        spread.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        there = {n[7:] for n in children(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")}
        return {str(b): folder for b in touched if str(b) in there}

    def change(self, changes: dict[str, tuple[DataFrame, DataFrame | None]]) -> int:
        """Replace rows in several tables at once: {table: (keys, fresh rows or None)}; returns the new state's number.

        All rows of the keys (a frame with the table's key column) go, the fresh ones, whose keys are among them, come.
        """
        number, state = self.manifests.read()
        after = dict(state)
        for table, (keys, fresh) in changes.items():
            kept = state[table]
            named = keys.select(F.col(kept["key"])).where(F.col(kept["key"]).isNotNull()).distinct()
            touched = sorted(r["b"] for r in named.select(self._bucket(kept).alias("b")).distinct().collect())  # as many as buckets
            rows = self._read(state, table, touched).join(named, kept["key"], "left_anti")
            columns = self._read(state, table, []).columns
            if fresh is not None:
                rows = rows.select(*columns).unionByName(fresh.select(*columns))
            untouched = {b: f for b, f in kept["folders"].items() if int(b) not in touched}
            after[table] = kept | {"folders": untouched | self._write(table, rows.select(*columns), kept, touched)}
        return self.manifests.commit(number, after)

    def grow(self, table: str, most: int = ROWS) -> bool:
        """Double a table's buckets until they hold at most so many rows in the mean; whether that was needed."""
        number, state = self.manifests.read()
        kept, rows = dict(state[table]), self._read(state, table)
        n = rows.count()
        if n <= most * kept["buckets"]:
            return False
        while n > most * kept["buckets"]:
            kept["buckets"] *= 2
        kept["folders"] = self._write(table, rows, kept, list(range(kept["buckets"])))
        self.manifests.commit(number, state | {table: kept})
        return True

    def vacuum(self) -> None:
        """Delete folders that the current state does not name; readers of earlier states must have ended."""
        state = self.manifests.read()[1]
        named = {f for kept in state.values() for f in kept["folders"].values()}
        for table in state:
            for name in children(self.spark, f"{self.path}/{table}"):
                if f"{table}/{name}" not in named:
                    delete_path(self.spark, f"{self.path}/{table}/{name}")


def delete_documents(store: Store, ids: DataFrame, owned: dict[str, str] | None = None) -> int:
    """M4 on kept tables: documents (column id) go together with what belongs to them."""
    def keys(column: str) -> DataFrame:
        return ids.select(F.col("id").alias(column))

    return store.change({"documents": (keys("id"), None)} | {t: (keys(c), None) for t, c in (owned or CHILDREN).items()})


def upsert_documents(store: Store, updates: DataFrame) -> int:
    """M1 on the kept table: only the buckets of changed and new documents are rewritten."""
    library = store.read("documents")
    known = library.join(updates.select("uri").distinct(), "uri", "left_semi")
    whole = upkeep.upsert_by_uri(library, updates)
    changed = whole.join(updates.select("uri").distinct(), "uri", "left_semi")
    changed, _ = upkeep.stage(changed, "upserts")
    return store.change({"documents": (known.select("id").unionByName(changed.select("id")), changed)})


def rebind_documents(store: Store, requests: DataFrame) -> tuple[int, DataFrame]:
    """M2 on the kept table: (new state, refused requests)."""
    library = store.read("documents")
    whole, refused = upkeep.rebind_uri(library, requests)
    moved = whole.join(requests.select("id").distinct(), "id", "left_semi")
    moved, _ = upkeep.stage(moved, "rebound")
    refused, _ = upkeep.stage(refused, "refused")
    return store.change({"documents": (moved.select("id"), moved)}), refused


def replace_texts(store: Store, rows: DataFrame) -> int:
    """M5 on kept tables: texts of documents that exist replace theirs, others are left out."""
    living = rows.join(store.read("documents").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return store.change({"document_text": (living.select("document_id"), living)})
