"""Connected components of a table of links, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import free, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours, then the label of that label; a chain of
    n nodes needs about log n rounds. Labels are written between rounds; nothing goes to the driver
    but whether a label changed."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(far, "label").select("node", "old", F.least("label", "far").alias("label")))
        free(labels)
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            free(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc, label: the least doc of its component) once links (a, b) between docs are added. Only pairs of
    components that links connect anew go through propagation."""
    of = lambda name, as_: labels.select(F.col("doc").alias(name), F.col("label").alias(as_))
    new = links.select("a", "b").join(of("a", "la"), "a").join(of("b", "lb"), "b").filter("la <> lb")
    new = stored(new.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not new.limit(1).count():
        return labels
    found = components(new)
    out = stored(labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("doc", F.coalesce("least", "label").alias("label")))
    free(new, found)
    return out
