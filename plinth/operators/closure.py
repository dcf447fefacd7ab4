"""Reflexive-transitive closures of edge lists, safe on cycles.

A hierarchy of a checked small size is closed while the plan is built and becomes a constant of it, so a role test
is an ``isin`` that reaches the scan. Larger or unknown edge lists run semi-naive rounds on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.storage import written

#: Edges up to which a hierarchy is closed at plan time.
SMALL = 10_000
#: Nodes of a chain in a block: a task pairs a block with all later ones of its chain.
BLOCK = 1024


class Hierarchy:
    """Edges (sub, super) of a vocabulary-sized hierarchy."""

    def __init__(self, edges: Iterable[tuple[str, str]]):
        self.below: dict[str, set[str]] = {}
        self.nodes: set[str] = set()
        for sub, sup in edges:
            self.below.setdefault(sup, set()).add(sub)
            self.nodes |= {sub, sup}

    @classmethod
    def of(cls, edges: DataFrame, most: int = SMALL) -> "Hierarchy":
        """Reads at most ``most`` edges of columns (sub, super); more are an error, for which ``closure`` is there."""
        rows = edges.select("sub", "super").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} edges; use closure()")
        return cls((r["sub"], r["super"]) for r in rows)

    def descendants(self, target: str) -> list[str]:
        """``target`` and everything under it, also where it has no edge at all."""
        seen, todo = {target}, [target]
        while todo:
            for sub in self.below.get(todo.pop(), ()):
                if sub not in seen:
                    seen.add(sub)
                    todo.append(sub)
        return sorted(seen)

    def under(self, column: Column, target: str) -> Column:
        return column.isin(self.descendants(target))

    def pairs(self, spark: SparkSession, reflexive: bool = True) -> DataFrame:
        rows = [(sub, sup) for sup in sorted(self.nodes) for sub in self.descendants(sup) if reflexive or sub != sup]
        return spark.createDataFrame(rows, "sub string, super string")


def closure(edges: DataFrame, *, reflexive: bool = True, most_hops: int | None = None, every: int = 3) -> DataFrame:
    """(sub, super, hops): reachable pairs of the edges (sub, super) with the least number of hops.

    Semi-naive: each round extends only the pairs that the last one found, so cycles end it. Results are written to
    the shared folder every ``every`` rounds to keep lineage short. Null ends are ignored. With ``reflexive``, each
    node that has an edge reaches itself in 0 hops; a cycle's pairs (x, x) are only there with it.
    """
    steps = edges.filter("sub is not null and super is not null and sub <> super").select("sub", "super").distinct()
    steps = written(steps, "closure-edges")
    seen = steps.withColumn("hops", F.lit(1))
    last, hops = seen, 1
    while most_hops is None or hops < most_hops:
        hops += 1
        step = last.select("sub", F.col("super").alias("via")).join(steps.select(F.col("sub").alias("via"), "super"), "via").select("sub", "super").filter("sub <> super").distinct()
        new = written(step.join(seen, ["sub", "super"], "left_anti").withColumn("hops", F.lit(hops)), "closure-round")
        if new.isEmpty():
            break
        seen, last = seen.unionByName(new), new
        if hops % every == 0:
            seen = written(seen, "closure-seen")
    if reflexive:
        nodes = steps.select(F.col("sub").alias("x")).union(steps.select("super")).distinct()
        seen = seen.unionByName(nodes.select(F.col("x").alias("sub"), F.col("x").alias("super"), F.lit(0).alias("hops")))
    return seen


def closure_by_doubling(edges: DataFrame) -> DataFrame:
    """(sub, super, hops): what ``closure`` gives without ``reflexive``, for long chains: rounds grow with the logarithm of the hops.

    Before a round the pairs of at most ``far`` hops are known. One of at most twice that has on its shortest path a node
    exactly ``far`` hops away, so only pairs of that length are extended, by all known ones. Cycles end it.
    """
    steps = edges.filter("sub is not null and super is not null and sub <> super").select("sub", "super").distinct()
    seen, far = written(steps.withColumn("hops", F.lit(1)), "closure-seen"), 1
    while True:
        ends = seen.filter(F.col("hops") == far).select("sub", F.col("super").alias("via"))
        if ends.isEmpty():
            return seen
        step = ends.join(seen.select(F.col("sub").alias("via"), "super", (F.col("hops") + far).alias("hops")), "via").filter("sub <> super")
        new = step.groupBy("sub", "super").agg(F.min("hops").alias("hops")).join(seen, ["sub", "super"], "left_anti")
        new = written(new.select("sub", "super", "hops"), "closure-round")
        if new.isEmpty():
            return seen
        seen, far = seen.unionByName(new), 2 * far


def closure_of_chains(rows: DataFrame, chain: str, node: str, *order: str, block: int = BLOCK) -> DataFrame:
    """(sub, super, hops): what ``closure_by_doubling`` gives for the edges from each node of a chain to the next one in ``order``.

    In a chain whose nodes are nowhere else a pair's hops are the distance of its places. Such chains are dealt in blocks,
    each to the later ones of its chain, and pairs come out where the blocks meet: rows are moved a few times each, and
    pairs never. Chains with a null node, or one that stands twice, may branch or close, so their edges go through
    ``closure_by_doubling``; they share no node with the others.
    """
    placed = rows.select(F.col(chain).alias("chain"), F.col(node).alias("node"), (F.row_number().over(Window.partitionBy(chain).orderBy(*order)) - 1).alias("at"))
    placed = written(placed, "chain-places")
    again = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or node is null").select("node")
    mixed = written(placed.join(again, placed["node"].eqNullSafe(again["node"]), "left_semi").select("chain").distinct(), "chain-mixed")
    simple = placed
    if not mixed.isEmpty():
        same = placed["chain"].eqNullSafe(mixed["chain"])
        simple = placed.join(mixed, same, "left_anti")
        after = F.lead("node").over(Window.partitionBy("chain").orderBy("at"))
        others = closure_by_doubling(placed.join(mixed, same, "left_semi").select(F.col("node").alias("sub"), after.alias("super")))
    blocks = simple.groupBy("chain", F.floor(F.col("at") / block).cast("int").alias("block"))
    blocks = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("nodes"))
    ends = blocks.select(F.col("chain").alias("of"), F.col("block").alias("end"), F.col("nodes").alias("supers"), F.explode(F.sequence(F.lit(0), "block")).alias("begin"))
    met = blocks.join(ends, F.col("chain").eqNullSafe(F.col("of")) & (F.col("block") == F.col("begin")))
    met = met.select("nodes", "supers", ((F.col("end") - F.col("begin")) * block).alias("apart"))
    met = met.select("nodes", "apart", F.posexplode("supers").alias("j", "super")).select("super", "apart", "j", F.posexplode("nodes").alias("i", "sub"))
    pairs = met.select("sub", "super", (F.col("apart") + F.col("j") - F.col("i")).alias("hops")).filter("hops > 0")
    return pairs if simple is placed else pairs.unionByName(others)


def closure_sql(spark: SparkSession, edges: DataFrame, most_hops: int = 50) -> DataFrame:
    """(sub, super) of a small acyclic or cyclic hierarchy as one recursive query; the path guards against cycles."""
    edges.select("sub", "super").createOrReplaceTempView("_pl_edges")
    return spark.sql(f"""
        WITH RECURSIVE walk(sub, super, path) AS (
            SELECT sub, super, array(sub, super) FROM _pl_edges
            UNION ALL
            SELECT w.sub, e.super, concat(w.path, array(e.super)) FROM walk w JOIN _pl_edges e ON e.sub = w.super
            WHERE NOT array_contains(w.path, e.super) AND size(w.path) < {int(most_hops)})
        SELECT sub, super FROM walk UNION SELECT sub, sub FROM _pl_edges UNION SELECT super, super FROM _pl_edges""")


def reach(edges: DataFrame, targets: DataFrame, *, most_hops: int | None = None) -> DataFrame:
    """(s, hops): the nodes from which a target can be reached along the edges (sub, super), targets included, with the least number of hops.

    Search from the targets only, all at once: a row a node, however many targets and ways there are, where ``closure``
    has a row a pair. Each round extends what the last one found and is written, so cycles end it; there are as many rounds
    as the farthest node has hops. Null ends and targets are ignored; a target without an edge reaches itself.
    """
    steps = written(edges.filter("sub is not null and super is not null and sub <> super").select("sub", "super").distinct(), "reach-edges")
    seen = written(targets.select("s").filter("s is not null").distinct().withColumn("hops", F.lit(0)), "reach-targets")
    last, hops = seen, 0
    while most_hops is None or hops < most_hops:
        hops += 1
        step = steps.join(last.select(F.col("s").alias("super")), "super").select(F.col("sub").alias("s")).distinct()
        last = written(step.join(seen, "s", "left_anti").withColumn("hops", F.lit(hops)), "reach-round")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
        if hops % 8 == 0:
            seen = written(seen, "reach-seen")
    return seen
