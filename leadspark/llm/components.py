"""Connected components by alternating stars, as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.session import cut_lineage


def merged(side: DataFrame) -> DataFrame:
    """``side`` for a join by sorting: a loop of joins that each broadcast a small table fills the driver."""
    return side.hint("merge")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: links each neighbour to the smallest node around u."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(merged(least), "u")
    if large:
        linked = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def drawn_in(edges: DataFrame | None, links: DataFrame) -> DataFrame:
    """``edges`` (u, v with u > v) and new ``links`` (a, b), one round closer to stars around the smallest nodes.

    What is connected stays connected. The result is written to the checkpoint folder.
    """
    fresh = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges is not None:
        fresh = fresh.unionByName(edges)
    return cut_lineage(_stars(_stars(fresh, large=True), large=False).distinct())


def labels_of(edges: DataFrame) -> DataFrame:
    """(node, label): for each node that is not the smallest around it, a smaller one it is connected to."""
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def component_labels(links: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, label) of the nodes in ``links`` (a, b) or ``edges``; the label is the smallest node connected to it.

    The smallest nodes themselves are left out. Each round moves every node
    closer to the smallest one around it, so a chain of n links takes about
    log n rounds. The state of a round is one row per link. Loops and repeated
    links make no difference; no links give no rows.
    """
    edges = drawn_in(edges, links)
    before = None
    state = _state(edges)
    while before != state:
        edges = drawn_in(edges, links.limit(0))
        before, state = state, _state(edges)
    return labels_of(edges)
