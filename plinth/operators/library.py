"""A library of motifs, matched in one plan whose size does not grow with the library.

What the nodes of all motifs ask of their elements (a role, a category, a class) becomes a table of tags, closed over the
hierarchies while the plan is built. Elements get their tags once, edges meet their elements' tags once, and one join with
the nodes, a row a node and tag, says which element may stand at which node of which motif. Solutions are joins of that one
table on (motif, step).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.storage import written
from plinth.operators.closure import Hierarchy
from plinth.operators.motifs import Motif, Node
from plinth.sources.graph import Graph


@dataclass(frozen=True)
class Wanted:
    """A tag that a node asks for: ``relation`` of the graph, up to the ``name`` by its hierarchy."""

    relation: str
    name: str

    @property
    def tag(self) -> str:
        return f"{self.relation}:{self.name}"


def wanted(node: Node, strict: bool) -> list[Wanted]:
    found = [Wanted("plays", node.role)]
    found += [Wanted("contains", node.category)] if node.category else []
    return found + ([Wanted("types", node.expected_class)] if strict and node.expected_class else [])


def _tagged(graph: Graph, tags: set[Wanted]) -> DataFrame:
    """(s, tag): the elements that have each tag, themselves or by what is under it."""
    hierarchies: dict[str, tuple[Hierarchy, str]] = {"plays": (graph.roles, graph.role_base), "contains": (graph.categories, graph.role_base), "types": (graph.classes, graph.class_base)}
    parts = []
    for relation in sorted({t.relation for t in tags}):
        hierarchy, base = hierarchies[relation]
        rows = sorted((below, t.tag) for t in tags if t.relation == relation for below in hierarchy.descendants(base + t.name))
        under = graph.use.sparkSession.createDataFrame(rows, "o string, tag string")
        parts.append(getattr(graph, relation).select("s", "o").join(under, "o").select("s", "tag"))
    return reduce(DataFrame.unionByName, parts).distinct()


def node_bindings(graph: Graph, motifs: tuple[Motif, ...], strict: bool = False) -> DataFrame:
    """(motif, node, step, element): the elements that may stand at each node, for steps that have them; whether other nodes have any is open."""
    spec, tags = [], set()
    for motif in motifs:
        for node in motif.nodes:
            asked = wanted(node, strict)
            tags.update(asked)
            spec += [(motif.name, node.column, node.edge or "self", t.tag, len(asked)) for t in asked]
    tagged = written(_tagged(graph, tags), "library-tags")
    edge = lambda name: getattr(graph, name).select(F.col("s").alias("step"), F.lit(name).alias("edge"), F.col("o").alias("s")).distinct()
    around = reduce(DataFrame.unionByName, [edge(name) for name in sorted({s[2] for s in spec} - {"self"})]).join(tagged, "s").select("step", "edge", F.col("s").alias("element"), "tag")
    itself = tagged.select(F.col("s").alias("step"), F.lit("self").alias("edge"), F.col("s").alias("element"), "tag")
    nodes = graph.use.sparkSession.createDataFrame(spec, "motif string, node string, edge string, tag string, need int")
    met = around.unionByName(itself).join(nodes, ["edge", "tag"]).groupBy("motif", "node", "step", "element", "need").agg(F.count_distinct("tag").alias("n"))
    return met.filter("n = need").select("motif", "node", "step", "element")


def library_solutions(graph: Graph, motifs: tuple[Motif, ...], strict: bool = False) -> DataFrame:
    """(motif, step and the other columns of its nodes): the solutions of all motifs, as ``motifs.solutions`` gives them one by one.

    Motifs must have different names and, to share a table, the same columns; nodes of a star only. An empty library is an error.
    """
    shapes = {tuple(n.column for n in m.nodes) for m in motifs}
    if len(shapes) != 1 or len({m.name for m in motifs}) != len(motifs):
        raise ValueError("motifs of a library have different names and the same columns")
    bound = written(node_bindings(graph, motifs, strict), "library-nodes")
    (columns,) = shapes
    at = lambda column: bound.filter(F.col("node") == column).select("motif", "step", *([F.col("element").alias(column)] if column != "step" else []))
    return reduce(lambda a, b: a.join(b, ["motif", "step"]), [at(c) for c in columns]).select("motif", *columns)
