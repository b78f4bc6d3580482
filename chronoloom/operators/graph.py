"""Connected components of links, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.sources.workspace import materialize

#: Directed links up to which one task finishes what the rounds have left.
LAST_LINKS = 10_000


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a, b).

    Rounds of contraction: every group joins its neighbour of lowest random priority, links are rewritten to groups, and
    links within a group vanish. A random order makes the rounds few (about the logarithm of the longest path) whatever
    the ids. Each round is written to the shared folder; hubs are summed by partial minima and never gathered. As soon as
    at most LAST_LINKS are left, one task joins their ends.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    live, steps = materialize(both, "links"), []
    for turn in range(max_rounds):
        if live.count() <= LAST_LINKS:
            break
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("o"), F.col(c).alias("v"))
        lowest = live.groupBy("a").agg(F.min(order("b")).alias("m"))
        steps.append(materialize(lowest.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("label")), "steps"))
        to_a, to_b = (steps[-1].select(F.col("node").alias(c), F.col("label").alias(f"{c}_to")) for c in ("a", "b"))
        moved = live.join(to_a, "a").join(to_b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        live = materialize(moved.where("a != b").distinct(), "links")
    else:
        raise RuntimeError("links did not contract")
    groups = _joined(live)
    for step in reversed(steps):  # each step's labels are the nodes of the next
        later = groups.select(F.col("node").alias("label"), F.col("label").alias("last"))
        groups = materialize(step.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
    smallest = groups.groupBy("label").agg(F.min("node").alias("component"))
    return materialize(groups.join(smallest, "label").select("node", "component"), "components")


def _joined(links: DataFrame) -> DataFrame:
    """node and label (one node of its group) of every node of a few links, in one task."""
    kind = links.schema["a"].dataType

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        schema = None
        for batch in batches:
            schema = pa.schema([pa.field("node", batch.schema.field(0).type), pa.field("label", batch.schema.field(0).type)])
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent[top(a)] = top(b)
        if schema is not None and parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), schema.types[0]), pa.array([top(x) for x in list(parent)], schema.types[1])], schema=schema)

    few = links.coalesce(1).mapInArrow(join, f"node {kind.simpleString()}, label {kind.simpleString()}")
    return materialize(few, "last-labels")
