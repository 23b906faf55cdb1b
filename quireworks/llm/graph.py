"""Connected components by repeated contraction, every round a pair of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import discard, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the nodes of `edges` (two long columns) with the smallest id of their component: (node, component).

    Each round every node points to the neighbour (or itself) that comes first in an order that is drawn anew for the
    round, and edges are rewritten between the nodes pointed to, so chains and stars alike shrink by a constant factor
    and the number of rounds grows with the logarithm of the component size.  Nulls and self loops are ignored; an empty
    input gives an empty result.  A node with very many edges is reduced by partial aggregation before any shuffle.
    """
    spark = edges.sparkSession
    links, links_at = stage(
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges"
    )
    labels, labels_at, round_no = None, None, 0
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(round_no)).alias("h"), c.alias("to"))  # noqa: B023, E731
        chosen, chosen_at = stage(
            both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("m"), F.min(order(F.col("a"))).alias("own"))
            .select("node", F.least("m", "own")["to"].alias("to")),
            "choice",
        )
        side = lambda c, out: chosen.select(F.col("node").alias(c), F.col("to").alias(out))  # noqa: B023, E731
        fewer, fewer_at = stage(
            links.join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            nodes = chosen.select("node", F.col("to").alias("root"))
        else:
            nodes = labels.join(side("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh, fresh_at = stage(nodes, "labels")
        discard(spark, *[p for p in (links_at, labels_at, chosen_at) if p])
        links, links_at, labels, labels_at, round_no = fewer, fewer_at, fresh, fresh_at, round_no + 1
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    # read again by path, so that both sides of the join are plain exchanges and a huge component can be split
    small, _ = stage(least, "roots")
    return labels.join(small, "root").select("node", "component")
