"""Merkle manifest of a dataset: a content-addressed tree of digests and proofs read from it (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import discard_since, new_path, stage
from quireworks.operators.catalog import ranked
from quireworks.session import STAGED, discard

#: Children of a node, and the hex digits of a digest
FANOUT, DIGITS = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**changed: Column) -> Column:
    """H of a document's fields, each `-` if null, else its UTF-8 byte count, `:` and the value; `changed` replaces columns."""
    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(n) for n in FIELDS]), 256)


def _child(children: Column, place: Column) -> Column:
    return F.substring(children, place * DIGITS + 1, F.lit(DIGITS))


def _left(children: Column, place: Column) -> Column:
    return F.substring(children, F.lit(1), place * DIGITS)


def _right(children: Column, place: Column) -> Column:
    return F.substring(children, (place + 1) * DIGITS + 1, F.length(children))


def _height(n: Column, most: int = 16) -> Column:
    """Rounds of grouping until one of n nodes remains."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(1, most)), F.when(n > 1, 1).otherwise(0))


class Manifest:
    """The tree over a table, as tables at `path`: records (digest to the digests of its children, in order), leaves (each
    row with its place), trees (per source its ordinal, count and subroot), and the root.

    Rows are dealt into one tree per source (a null source is one of its own and comes first), in order of doc_id (null
    first); rows of equal doc_id are ordered by their digest, and rows equal in every field are leaves of their own with
    equal digests.  The subroots form the top tree.  A source with one row has that leaf as its subroot; one source alone
    has its subroot as the root; an empty table has no root and no rows.  Columns other than the five fields are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def records(self) -> DataFrame:
        return self._table("records")

    @property
    def leaves(self) -> DataFrame:
        return self._table("leaves")

    @property
    def trees(self) -> DataFrame:
        return self._table("trees")

    @property
    def root(self) -> str | None:
        row = self._table("root").first()
        return row and row["root"]

    def drop(self) -> None:
        discard(self.spark, self.path)

    @staticmethod
    def write(docs: DataFrame, path: str | None = None, carried: dict[str, Column] | None = None) -> Manifest:
        """Build the tree of docs; `carried` columns (of the docs) are kept beside each leaf."""
        spark, mark = docs.sparkSession, len(STAGED)
        made = Manifest(spark, path or new_path(spark, "manifest"))
        extra = carried or {}
        rows, _ = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest().alias("leaf"), *[c.alias(n) for n, c in extra.items()]), "leaf-digests")
        # rows equal in all that orders them are told apart by where they were written, so that a range can be cut anywhere
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        placed, _ = stage(ranked(rows, *[F.asc_nulls_first(c) for c in ("source", "doc_id", "leaf", "__row")]).drop("__row"), "leaf-places")
        sources = placed.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
        sources, _ = stage(ranked(sources, F.asc("first")).withColumn("tree", F.col("rank") - 1).drop("rank"), "sources")
        sides = placed.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        leaves = sides.select("tree", (F.col("rank") - F.col("first")).alias("place"), "doc_id", "leaf", *extra)
        leaves.write.option("compression", "zstd").parquet(f"{made.path}/leaves")
        nodes = made.leaves.join(F.broadcast(sources.select("tree", "n")) if sources.count() <= 100_000 else sources.select("tree", "n"), "tree")
        subroots = made._grow(nodes.select("tree", "place", F.col("leaf").alias("digest"), "n"))
        trees = sources.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select("tree", "source", "n", "subroot")
        trees.write.parquet(f"{made.path}/trees")
        n_trees = made.trees.count()
        top = made.trees.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"), F.lit(n_trees).cast("long").alias("n"))
        made._grow(top).select(F.col("digest").alias("root"), F.lit(n_trees).cast("long").alias("n_trees")).write.parquet(f"{made.path}/root")
        discard_since(spark, mark)
        return made

    def _grow(self, nodes: DataFrame) -> DataFrame:
        """Hash runs of nodes (tree, place, digest, n: nodes of the tree at this level) upward until each tree has one, writing
        every level's records; returns what remains of each tree: (tree, digest)."""
        nodes, _ = stage(nodes, "nodes")
        most, done = nodes.agg(F.max("n")).first()[0] or 0, nodes.where("n <= 1").select("tree", "digest")
        if most <= 1:
            nodes.select("digest", F.col("digest").alias("children")).limit(0).write.mode("append").parquet(f"{self.path}/records")
        while most > 1:
            up = nodes.where("n > 1").groupBy("tree", F.shiftright("place", FANOUT.bit_length() - 1).alias("place")).agg(
                F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"), F.first("n").alias("n")
            )
            up = up.select("tree", "place", F.array_join(F.col("run.digest"), "").alias("children"), F.ceil(F.col("n") / FANOUT).alias("n"))
            up, _ = stage(up.withColumn("digest", F.sha2("children", 256)), "runs")
            # equal runs are one record: the address is the content
            up.groupBy("digest").agg(F.first("children").alias("children")).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/records")
            nodes, most = up.select("tree", "place", "digest", "n"), -(-most // FANOUT)
            done = done.unionByName(nodes.where("n <= 1").select("tree", "digest"))
        return done

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """For requested leaves (columns tree, place and whatever else; all leaves by default) what the proof consists of:
        `path`, an array of (left, right) sibling digests from the leaf's run up to the root's.

        Requests are merged by the nodes they share: sixteen neighbours ask together, and each level looks up every
        record on some request's way once, beginning at the root and choosing a child by each digit of the ranks; the
        siblings passed by are collected in segments, which are reversed in the end.  No key is asked for by more rows
        than there are equal nodes.  Requests for places the tree does not have get no row.
        """
        asked = self.leaves if requests is None else requests
        trees = self.trees.select("tree", "n").withColumn("height", _height(F.col("n")))
        head = self._table("root").first()
        names = [c for c in asked.columns if c not in ("tree", "place")]
        if not head:
            return asked.limit(0).withColumn("path", F.lit(None).cast("array<struct<left:string,right:string>>"))
        top = int(self.spark.range(1).select(_height(F.lit(head["n_trees"]))).first()[0])
        # a bundle: the requests within one lowest run
        wanted = F.struct("place", *names)
        bundles = asked.join(trees.select("tree", "height"), "tree").groupBy("tree", F.when(F.col("height") > 0, F.shiftright("place", 4)).otherwise(F.lit(0)).alias("run"), "height").agg(F.collect_list(wanted).alias("asked"))
        bundles, _ = stage(bundles, "bundles")
        none = F.array().cast("array<struct<left:string,right:string>>")
        front = self.spark.range(1).select(F.lit(head["root"]).alias("digest"), F.lit(0).cast("long").alias("at"), none.alias("path"))
        # the top tree: at is the place of a node among those of its level
        for down in range(top - 1, -1, -1):
            on_way = bundles.select(F.shiftright("tree", 4 * down).alias("at")).distinct()
            front, _ = stage(self._descend(front).join(on_way, "at", "left_semi"), "descent")
        front = front.withColumnRenamed("at", "tree").join(trees, "tree").select("tree", F.lit(0).cast("long").alias("at"), "digest", "path", "height")
        # each tree down to the nodes above its leaves; trees of fewer levels arrive sooner
        arrived = front.where("height <= 1")
        most = trees.agg(F.max("height")).first()[0]
        for height in range(most, 1, -1):
            on_way = bundles.where(F.col("height") >= height).select("tree", F.shiftright("run", 4 * (height - 2)).alias("at")).distinct()
            going = front.where(F.col("height") == height)
            down = self._descend(going, "tree", "height").withColumn("height", F.col("height") - 1)
            down, _ = stage(down.join(on_way, ["tree", "at"], "left_semi"), "descent")
            arrived = arrived.unionByName(down.where("height <= 1"))
            front = front.where(F.col("height") < height).unionByName(down)
        last = arrived.join(self.records, "digest", "left").withColumnRenamed("at", "run")
        found = bundles.drop("height").join(last, ["tree", "run"])
        one = found.withColumn("one", F.explode("asked")).select("tree", "one.place", *[F.col(f"one.{n}").alias(n) for n in names], "height", "children", F.reverse("path").alias("above"))
        digit = F.col("place") % FANOUT
        low = F.array(F.struct(_left(F.col("children"), digit).alias("left"), _right(F.col("children"), digit).alias("right")))
        inside = F.when(F.col("height") > 0, digit * DIGITS < F.length("children")).otherwise(F.col("place") == 0)
        return one.where(inside).withColumn("path", F.concat(F.when(F.col("height") > 0, low).otherwise(none), "above")).drop("above", "children", "height")

    def _descend(self, front: DataFrame, *keep: str) -> DataFrame:
        """Each node of front (digest, at, path) replaced by its children, which collect the siblings beside them."""
        runs = front.join(self.records, "digest")
        places = F.sequence(F.lit(0), (F.length("children") / DIGITS).cast("int") - 1)
        each = runs.withColumn("digit", F.explode(places))
        children, digit = F.col("children"), F.col("digit")
        segment = F.struct(_left(children, digit).alias("left"), _right(children, digit).alias("right"))
        return each.select(*keep, (F.col("at") * FANOUT + digit).alias("at"), _child(children, digit).alias("digest"), F.concat("path", F.array(segment)).alias("path"))


def proof_digest(path: Column) -> Column:
    """H of a proof's siblings, level by level from the leaf's run to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered() -> Column:
    """A document's leaf after its text's A-Z were lower-cased."""
    return leaf_digest(text=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root recomputed after some texts were tampered with: those
    whose doc_id's CRC-32 is a multiple of five (null ids are not).  Nulls, ties and empty tables: see Manifest."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered())
    mark = len(STAGED)
    made = Manifest.write(docs, carried={"changed": changed})
    subroots = made.trees.select("tree", "subroot")
    root = F.lit(made.root)
    rows = made.proofs().join(subroots, "tree").withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    answer = rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
    answer, at = stage(answer, "proofs")
    made.drop()
    discard_since(docs.sparkSession, mark, at)
    return answer
