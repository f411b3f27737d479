"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, measured


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node reachable.

    Labels fall to the least label among neighbours, then every label is replaced by its
    own label (pointer jumping), so a path of length d needs about log d rounds. Each
    round is one written table; no edge or label comes to the driver, which learns only
    whether anything changed. No edges give no rows. Edges with a null end are ignored.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    both = cut(ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        # A node's own label takes part, so the least one and the former come from one aggregate.
        own = labels.select("node", "component", F.col("component").alias("was"))
        lower = own.unionByName(near.withColumn("was", F.lit(None).cast(dict(labels.dtypes)["component"]))).groupBy("node").agg(F.min("component").alias("component"), F.min("was").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after, counts = measured(lower.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was"), "labels", changed=F.col("component") < F.col("was"))
        labels = after.select("node", "component")
        if not counts["changed"]:
            return labels
