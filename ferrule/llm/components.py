"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of labels that may be broadcast.
LABEL_BYTES = 8 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b), label being the component's least node."""
    return measured_components(edges)[0]


def measured_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """components(edges), and about their bytes.

    Each round takes the least label around a node, then the label of that label; both
    are written to the checkpoint folder. Every node is its own neighbour, so its label of
    the round before comes along. Aggregates are partial; labels are broadcast while they
    are small, else the join by neighbour is one whose hot keys adaptive execution splits.
    Rounds go on until no label changes; a round counts its changes as it is written.
    """
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])
    both, _ = common.cut_measured(edges.where("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels, size = common.cut_measured(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        seen = common.small_join(both, labels.withColumnRenamed("node", "b"), ["b"], "inner", limit=LABEL_BYTES, size=size)
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("next"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        least = common.small_join(least, jump, ["next"], "left", limit=LABEL_BYTES, size=size).select("node", F.least("next", F.coalesce("jumped", "next")).alias("label"), "was")
        least, size, seen = common.cut_measured(least, changed=F.count_if(F.col("label") != F.col("was")))
        labels = least.drop("was")
        if not seen["changed"]:
            return labels, size
