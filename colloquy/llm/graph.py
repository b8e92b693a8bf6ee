"""Connected components of a graph given by its edges, fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) of each end of an edge (u, v).

    Each round every vertex learns the least label of its neighbours' labels,
    takes it, hands it to the root of its tree (so whole trees are hooked at
    once) and takes the label of its own label, so paths shorten by half. Rounds
    end only when no label changed: ends of an edge then have equal labels. Each
    round is a written table.
    """
    both = table(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = table(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    changed = not labels.isEmpty()
    while changed:
        up = labels.select(F.col("id").alias("up"), F.col("root").alias("above"))
        higher = table(labels.join(up, labels["root"] == up["up"]).select("id", "root", "above"), "higher")
        seen = both.join(higher, both["u"] == higher["id"]).groupBy(F.col("v").alias("near")).agg(F.min("above").alias("seen"))
        near = table(higher.join(seen, higher["id"] == seen["near"]).select("id", "root", F.least("above", "seen").alias("low")), "near")
        hooks = near.groupBy(F.col("root").alias("tree")).agg(F.min("low").alias("hook"))
        moved = near.join(hooks, near["id"] == hooks["tree"], "left").select("id", F.col("root").alias("was"), F.least("low", "hook").alias("root"))
        moved = table(moved, "labels")
        changed = moved.where("root <> was").limit(1).count() > 0
        labels = moved.select("id", "root")
    return labels
