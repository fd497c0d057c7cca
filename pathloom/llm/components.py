"""Connected components of an edge table, by minimum labels with pointer jumping.

All steps are joins and map-side combined minima over edge rows; nothing is
gathered per node or on the driver. Each round is written to the shared folder,
so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import cut, drop


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Large-star and small-star by joins: every round sends each edge's ends to
    the smallest label seen beside them, then halves label chains.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("root")))
    tables = [label]
    while True:
        beside = both.join(label.select(F.col("node").alias("v"), F.col("root").alias("low")), "v").groupBy(F.col("u").alias("node")).agg(F.min("low").alias("low"))
        lower = label.join(beside, "node").select("node", "root", F.least("root", "low").alias("to"))
        # The old root learns its members' new labels too, then chains are halved.
        told = lower.where("to < root").groupBy(F.col("root").alias("node")).agg(F.min("to").alias("told"))
        hooked = lower.join(told, "node", "left").select("node", "root", F.least("to", F.coalesce("told", "to")).alias("to"))
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("above"))
        new = cut(hooked.join(up, "to", "left").select("node", "root", F.least("to", F.coalesce("above", "to")).alias("to")))
        drop(tables.pop())
        tables.append(new)
        label = new.select("node", F.col("to").alias("root"))
        if new.where("to < root").isEmpty():
            drop(both)
            return label
