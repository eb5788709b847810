"""Connected components by the smallest id reachable, without gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garoa.llm.shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges(a, b)``.

    Each round moves a node's label to the least label of its neighbours and
    then to that label's own label, so long chains shrink by doubling. Minima
    combine before the shuffle; a hub with many neighbours is never gathered.
    ``edges`` is read once a round, so it should be a checkpointed table. Joins
    are never broadcasts, whose size nothing here bounds.
    Self links are allowed; repeated links and both directions count once; null
    ends are ignored. No links give an empty table.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.hint("merge"), both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near.hint("merge"), labels.id == near.a, "left").select(
            "id", "component", F.least("component", "near").alias("to")
        )
        own = labels.select(F.col("id").alias("to"), F.col("component").alias("onward"))
        new = checkpointed(
            moved.join(own.hint("merge"), "to", "left").select(
                "id", F.least("to", "onward").alias("next"), F.col("component").alias("old")
            )
        )
        changed = new.where("next <> old").limit(1).count()
        labels = new.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
