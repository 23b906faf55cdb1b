"""A full-text index that is kept up to date by small segments: new ones hide what older ones say about their documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.operators import search
from quireworks.sources.manifests import Manifests, children, delete_path

POSTINGS = "term string, doc_id long, tf long, len long, version long, head string"
DOCS = "doc_id long, version long, n_tokens long, text string"
#: Documents of later segments (two numbers each) that are sent to the rows they may hide; more are joined by a shuffle
HIDING = 1_000_000


class SegmentIndex:
    """Postings and texts of documents at `path`, changed by batches and searched without reading texts.

    A batch writes one segment: the postings of its documents, dealt by their terms' first signs, and one row for each
    document it touched, where it came (a removed one has no text: a tombstone).  Nothing older is rewritten.  A document's newest
    row counts, so a search drops postings whose document a later segment touched; only the segments behind the oldest
    are asked for that.  When `fan` segments of one tier stand in a row they are merged into one of the next tier, and
    what is hidden goes; so a document is rewritten once a tier, and there are at most `fan` segments a tier.  The
    manifest, written last, names the segments, the batches they hold, and the number and total length of the living
    documents, which each batch keeps up to date.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 4):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.manifests = Manifests(spark, f"{self.path}/manifest")

    def state(self) -> tuple[int, dict]:
        number, state = self.manifests.read()
        return number, state or {"segments": [], "n_docs": 0, "n_tokens": 0, "version": 0, "batch": -1}

    # --- reading ---

    def _docs(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{s['name']}/docs" for s in segments]
        return self.spark.read.schema(DOCS).parquet(*paths) if paths else self.spark.createDataFrame([], DOCS)

    def _newest(self, segments: list[dict]) -> DataFrame:
        """(doc_id, newest): the last version of each document that one of these segments touched."""
        return self._docs(segments).groupBy("doc_id").agg(F.max("version").alias("newest"))

    def _visible(self, rows: DataFrame, later: list[dict]) -> DataFrame:
        """Rows (with doc_id, version) that no row of a later segment hides."""
        if not later:
            return rows
        known = rows.join(search.few(self._newest(later), HIDING), "doc_id", "left")
        return known.where(F.col("newest").isNull() | (F.col("newest") <= F.col("version"))).drop("newest")

    def _postings(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{s['name']}/postings" for s in segments]
        return self.spark.read.schema(POSTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], POSTINGS)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """Postings of living documents: term, doc_id, tf, len; with terms (a query's, few), of the files that can hold one."""
        segments = self.state()[1]["segments"]
        rows = self._postings(segments)
        if terms is not None:
            rows = rows.where(search.head_filter(terms))
        return self._visible(rows, segments[1:]).select("term", "doc_id", "tf", "len")

    def texts(self) -> DataFrame:
        """Living documents: doc_id, text."""
        segments = self.state()[1]["segments"]
        return self._visible(self._docs(segments), segments[1:]).where("text is not null").select("doc_id", "text")

    def scored(self, queries: DataFrame) -> DataFrame:
        """search.scored() over the living documents; the corpus's size and mean length come from the manifest."""
        state, terms = self.state()[1], search.search_parse(queries)
        mean = max(int(state["n_tokens"] / state["n_docs"] + 0.5), 1) if state["n_docs"] else 1
        segments = state["segments"]
        # terms meet postings first, so that only postings that match are compared with what later segments say
        rows = self._postings(segments).where(search.head_filter(terms))
        matches = search.prefix_match(terms, rows, keep=("version",))
        living = self._visible(matches, segments[1:]).drop("version")
        return search.scored_with(terms, living, F.lit(state["n_docs"]).cast("long"), F.lit(mean).cast("long"))

    # --- writing ---

    def apply(self, rows: DataFrame, batch: int | None = None) -> None:
        """Replace documents: rows of doc_id, text; a null text removes the document.  One row a document.

        A batch whose number was already applied is left out, so a stream may send it again.  One writer at a time; a
        second one is refused.
        """
        number, state = self.state()
        if batch is not None and batch <= state["batch"]:
            return
        version, name = state["version"] + 1, f"segment-{uuid.uuid4().hex}"
        place = f"{self.path}/{name}"
        counted = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).cast("long").alias("version"), search.n_tokens(F.col("text")).alias("n_tokens"), "text")
        # texts are not shuffled; a later batch looks its documents up here by id, in the files' Bloom filters
        self._write_docs(counted, place)
        fresh = self.spark.read.schema(DOCS).parquet(f"{place}/docs")
        postings = search.postings_of(fresh.where("text is not null").select("doc_id", "text"))
        self._write_postings(postings.withColumn("version", F.lit(version).cast("long")), place)
        came = fresh.agg(F.count("n_tokens").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("touched")).first()
        before = self._before(fresh, came["touched"], state["segments"])
        state = state | {
            "segments": [*state["segments"], {"name": name, "tier": 0}], "version": version,
            "n_docs": state["n_docs"] + came["n"] - before["n"], "n_tokens": state["n_tokens"] + came["tokens"] - before["tokens"], "batch": state["batch"] if batch is None else batch,
        }
        self.manifests.commit(number, state)
        self.compact()

    def _before(self, fresh: DataFrame, touched: int, segments: list[dict], few: int = 1_000) -> dict:
        """How many of these documents were living, and their total length."""
        if not segments:
            return {"n": 0, "tokens": 0}
        known = self._docs(segments).drop("text")
        if touched <= few:  # as values they reach the files' statistics and Bloom filters
            known = known.where(F.col("doc_id").isin([r["doc_id"] for r in fresh.select("doc_id").collect()]))
        else:
            known = known.join(fresh.select("doc_id"), "doc_id", "left_semi")
        last = known.groupBy("doc_id").agg(F.max_by("n_tokens", "version").alias("n_tokens"))
        row = last.agg(F.count("n_tokens").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        return {"n": row["n"], "tokens": row["tokens"]}

    def _write_docs(self, docs: DataFrame, place: str) -> None:
        docs.write.option("parquet.bloom.filter.enabled#doc_id", "true").option("compression", "zstd").parquet(f"{place}/docs")

    def _write_postings(self, postings: DataFrame, place: str) -> None:
        """Files hold some first signs, in order of their terms, so that their dictionaries and pages tell whether they have
        a term.  Tasks are cut to one size once it is known, so what one sorts does not grow with the batch, and a common
        pair of signs is spread over files."""
        keyed = postings.select("term", "doc_id", "tf", "len", "version", search.head(F.col("term")).alias("head"))
        keyed.hint("rebalance", "head").sortWithinPartitions("term", "doc_id").write.option("compression", "zstd").parquet(f"{place}/postings")

    def compact(self) -> None:
        """Merge the youngest run of `fan` segments of one tier, again while there is one."""
        while True:
            number, state = self.state()
            segments = state["segments"]
            tier = segments[-1]["tier"] if segments else 0
            first = len(segments)
            while first and segments[first - 1]["tier"] == tier:
                first -= 1
            merged = segments[first:]
            if len(merged) < self.fan:
                return
            name = f"segment-{uuid.uuid4().hex}"
            place = f"{self.path}/{name}"
            newest = self._visible(self._docs(merged), merged[1:])
            if not first:  # nothing older is left that a tombstone would hide
                newest = newest.where("text is not null")
            self._write_docs(newest, place)
            self._write_postings(self._visible(self._postings(merged), merged[1:]).drop("head"), place)
            fresh = {"name": name, "tier": tier + 1}
            self.manifests.commit(number, state | {"segments": [*segments[:first], fresh]})

    def vacuum(self) -> None:
        """Delete segments that the current state does not name; readers of earlier states must have ended."""
        named = {s["name"] for s in self.state()[1]["segments"]}
        for name in children(self.spark, self.path):
            if name.startswith("segment-") and name not in named:
                delete_path(self.spark, f"{self.path}/{name}")
