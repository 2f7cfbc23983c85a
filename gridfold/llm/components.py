"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node of the edges (a, b: long).

    In each round every label joins the least label it has an edge to, twice over, and the edges between the labels that
    remain are the next round's graph; the number of labels with edges at least halves. The minimum is aggregated
    before it is shuffled, so a node with very many edges is no burden. The result reads tables of ``scratch``.
    """
    graph = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not graph.isEmpty():
        both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "parents")
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
        to = scratch.write(parent.join(above, "p").select(F.col("a").alias("old"), F.col("g").alias("new")), "labels")
        if labels is None:
            labels = to.select(F.col("old").alias("node"), F.col("new").alias("label"))
        else:
            labels = scratch.write(labels.join(to, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        a, b = (to.select(F.col("old").alias(x), F.col("new").alias(f"{x}_new")) for x in ("a", "b"))
        moved = graph.join(a, "a").join(b, "b").filter("a_new <> b_new")
        graph = scratch.write(moved.select(F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")).distinct(), "edges")
    if labels is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
