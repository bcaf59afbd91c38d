"""Connected components by repeated contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``: one label for all nodes of a component.

    Node ids should be scattered (``mix64``): every round sends each node to the least id of its
    closed neighbourhood and contracts the edges, so the number of nodes falls by a constant
    factor and rounds grow with the logarithm of the input. A hub's neighbours are never gathered
    in one place: a round is a partially aggregated minimum and two equi-joins. Each round is
    written to the shared folder. Self loops and repeated edges are allowed; no edges give no rows.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
        to = written(to, "hop")
        maps.append(to)
        left, right = to.toDF("a", "la"), to.toDF("b", "lb")
        edges = edges.join(left, "a").join(right, "b").where("la <> lb")
        edges = written(edges.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0]
    for to in maps[1:]:
        out = out.join(to.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return out
