"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (columns u and v of one orderable type);
    the label is the least node of the component. Each round is written to the shared
    folder; labels travel at least as far as twice the way of the round before."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stored(both.where("u != v").distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        .select("node", F.least("node", "low").alias("label")),
        "labels",
    )
    while True:
        told = labels.select(F.col("node").alias("v"), F.col("label").alias("low"))
        heard = both.join(told, "v").groupBy(F.col("u").alias("node")).agg(F.min("low").alias("low"))
        near = stored(
            labels.join(heard, "node").select("node", "label", F.least("label", "low").alias("next")), "near"
        )
        root = near.select(F.col("node").alias("at"), F.col("next").alias("far"))
        moved = stored(
            near.join(root, near["next"] == root["at"], "left")
            .select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")),
            "labels",
        )
        labels = moved.select("node", "label")
        if not moved.where("label != old").head(1):
            return labels
