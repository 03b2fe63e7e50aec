"""Connected components of a graph given by its edges, as Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); root is the same in a component.

    Each round points every node to its least neighbour, follows pointers twice, and joins
    the edges to what they now point to; edges within a node vanish. The number of rounds
    grows with the logarithm of a component's size. Each round is written to the shared
    folder. Nulls, loops and repeated edges are ignored; without edges the result is empty.
    """
    edges = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "pointers"
        )
        for _ in range(2):
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = step.join(onward, "root").select("node", F.col("next").alias("root"))
        step = written(step, "pointers")
        if known is None:
            known = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = written(
                known.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots"
            )
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(
            edges.join(to_a, "a")
            .join(to_b, "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if known is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known
