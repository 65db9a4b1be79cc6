"""Connected components of a table of links, as DataFrames throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    Each round a node takes the least label among itself and its neighbours, then the label of that
    label, so that distances halve. Labels and links stay distributed; the driver sees one count a round.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.union(both.select(F.col("other"), F.col("node"))).where("node <> other").distinct())
    label = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component"))
    while True:
        label = cut(label)
        near = both.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("m"))
        lower = label.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        lower = cut(lower)
        jump = lower.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        moved = lower.join(jump, "m", "left").select("node", F.col("component").alias("old"), F.least("m", F.coalesce("mm", "m")).alias("component"))
        moved = cut(moved)
        label = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return label


def lower_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b within one task, in place: labels are the least position of a group."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]
