"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.session import cut_lineage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``: one of the nodes it reaches, the same for all.

    Contraction: every node goes to the first among itself and its neighbours in an order by a hash
    that changes each round, links go along, and links within one node vanish, until none is left;
    then the steps of each node are followed. A round is a map-side combined minimum per node and
    two joins, written to the shared folder, so no node's links come together in one task. The
    number of rounds grows with the logarithm of the links, for chains as for stars. Empty links give an empty table; loops and repeated links do
    no harm.
    """
    edges = cut_lineage(
        links.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).distinct()
    )
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        first = both.groupBy("u").agg(F.min(ranked("v")).alias("m"))
        target = cut_lineage(first.select(F.col("u").alias("node"), F.least("m", ranked("u"))["id"].alias("to")))
        steps.append(target)
        edges = cut_lineage(
            edges.join(target.select(F.col("node").alias("u"), F.col("to").alias("x")), "u")
            .join(target.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
            .where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        )
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        label = label.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
    return cut_lineage(label)
