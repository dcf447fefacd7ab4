"""Connected components of narrow edge lists by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut

#: Edges in a file of a round.
ROWS = 10_000
#: Edges up to which one task joins what is left: 16 MB, about 100 MB with what numpy needs beside.
AT_ONCE = 1 << 20


def joined_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges (u, v) of a partition: roots are hung below the least root they meet until none moves."""
    parts = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label, moved = np.arange(len(nodes)), True
    while moved:
        below, a, b = label.copy(), label[u], label[v]
        np.minimum.at(below, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(below, jumped := below[below]):
            below = jumped
        moved, label = not np.array_equal(below, label), below
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[label[i : i + (1 << 16)]])], ["node", "label"])


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, most_rounds: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links (a, b); nodes without links are absent.

    Each round is two joins on narrow rows whose large keys adaptive execution splits, and is checkpointed in the
    shared folder; a round that leaves the edges as they were ends it. Loops and repeated links do no harm.
    If ``most_rounds`` is given and runs out before that, it is an error. Without it, up to ``at_once`` edges between 64-bit
    integers are joined by one task: rounds over few edges cost the driver plans, code and tasks, and spare nobody anything.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # Rounds do not add edges, so small graphs need few files in each; the others keep the session's partitions.
    n_edges = edges.count()
    if most_rounds is None and n_edges <= at_once and {kind for _, kind in edges.dtypes} == {"bigint"}:
        return cut(edges.coalesce(1).mapInArrow(joined_at_once, "node long, label long"))
    width = max(1, -(-n_edges // ROWS))
    mark, rounds = None, 0
    while True:
        if rounds == most_rounds:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _smallest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct().coalesce(width))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
