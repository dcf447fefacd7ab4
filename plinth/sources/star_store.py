"""Graph store for star queries: edges with what is known of their objects, co-located by subject.

A motif is a star around a step, and asks for roles, classes and categories of what the step uses and produces. The
store holds an edge as (s, p, o) with these sets of its object, found by one join when it is written, and for each element
a row of its own with its own sets. Rows are divided by predicate and bucketed by subject, so that a star query
reads the predicates that it asks for, tests nodes inside the scan, and joins on the step without moving a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.storage import shared_dir
from plinth.operators.motifs import Motif, Node
from plinth.sources.graph import Graph

#: The predicate of an element's own row, whose object is null.
SELF = "self"
SETS = ("roles", "classes", "categories")


def tagged_elements(graph: Graph) -> DataFrame:
    """(s, roles, classes, categories): the sets of each element that has any; they are of vocabulary size."""
    told = None
    for name, relation in zip(SETS, (graph.plays, graph.types, graph.contains), strict=True):
        if relation is not None:
            own = relation.filter("s is not null").select("s", *(F.col("o").alias(n) if n == name else F.lit(None).cast("string").alias(n) for n in SETS))
            told = own if told is None else told.unionByName(own)
    return told.groupBy("s").agg(*(F.collect_set(n).alias(n) for n in SETS))


def star_rows(graph: Graph) -> DataFrame:
    """(s, p, o, roles, classes, categories): distinct use and produce edges with their object's sets, and own rows.

    Edges with a null end are left out, as no join would find them; objects of which nothing is known have empty sets. An
    object that very many edges share meets one row, so that adaptive execution may split its edges over tasks.
    """
    elements = tagged_elements(graph)
    edge = lambda name, relation: relation.filter("s is not null and o is not null").select("s", F.lit(name).alias("p"), "o")
    edges = edge("use", graph.use).unionByName(edge("produce", graph.produce)).distinct()
    found = edges.join(elements.withColumnRenamed("s", "o"), "o", "left")
    none = F.array().cast("array<string>")
    known = found.select("s", "p", "o", *(F.coalesce(n, none).alias(n) for n in SETS))
    return known.unionByName(elements.select("s", F.lit(SELF).alias("p"), F.lit(None).cast("string").alias("o"), *SETS))


def write_stars(graph: Graph, name: str | None = None, *, buckets: int | None = None) -> str:
    """Writes the store as a table of the catalogue, in the shared folder, and returns its name.

    One file a predicate and bucket: rows are dealt by the same hash as buckets are. ``buckets`` are the session's shuffle
    partitions if not given.
    """
    rows = star_rows(graph)
    spark: SparkSession = rows.sparkSession
    name = name or f"plinth_stars_{uuid.uuid4().hex}"
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    writer = rows.repartition(n, "s").write.partitionBy("p").bucketBy(n, "s").sortBy("s").mode("overwrite")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def _asked(graph: Graph, node: Node, strict: bool) -> Column:
    """The node's test on a row's sets; hierarchies are constants of the plan."""
    among = lambda column, names: F.arrays_overlap(column, F.lit(names))
    test = among("roles", graph.roles.descendants(graph.role_base + node.role))
    if node.category:
        test &= among("categories", graph.categories.descendants(graph.role_base + node.category))
    if strict and node.expected_class:
        test &= among("classes", graph.classes.descendants(graph.class_base + node.expected_class))
    return test


def star_solutions(store: DataFrame, graph: Graph, motif: Motif, strict: bool = False) -> DataFrame:
    """What ``motifs.solutions`` gives, from a store; of ``graph`` only hierarchies and bases are read.

    A subject, predicate and object is one row of the store, so that solutions are distinct without a check.
    """

    def bound(node: Node) -> DataFrame:
        rows = store.filter((F.col("p") == (node.edge or SELF)) & _asked(graph, node, strict))
        return rows.select(F.col("s").alias("step"), *([F.col("o").alias(node.column)] if node.edge else []))

    out = bound(next(n for n in motif.nodes if n.edge is None))
    for node in motif.nodes:
        if node.edge:
            out = out.join(bound(node), "step")
    return out.select(F.lit(motif.name).alias("motif"), *(n.column for n in motif.nodes))
