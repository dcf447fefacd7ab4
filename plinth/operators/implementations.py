"""Stored implementations of motifs: query texts, declared in the graph, that run over its relations.

A motif is linked to an implementation, which has a language and a path. The language here is Spark SQL: the text names the
graph's relations in braces and the vocabulary's bases as parameters, and Spark plans it like any other query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.closure import Hierarchy
from plinth.plans.vocabulary import LABEL, TYPE, Vocabulary
from plinth.sources.graph import Graph, edges
from plinth.sources.reports import read_text

LANGUAGE = "Spark SQL"
#: Folder of the texts that come with the library, by name.
STORED = os.path.join(os.path.dirname(__file__), "stored")


def declared(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(motif, implementation, language, path) of the triples, linked from either side; language and path are null where there is none."""
    rp = vocabulary.p
    linked = edges(triples, rp("implementedBy")).toDF("motif", "implementation").unionByName(edges(triples, rp("implementsMotif")).toDF("implementation", "motif")).distinct()
    of = lambda name, column: edges(triples, rp(name)).toDF("implementation", column)
    return linked.join(of("implementationLanguage", "language"), "implementation", "left").join(of("implementationPath", "path"), "implementation", "left").select("motif", "implementation", "language", "path")


def reflexive(hierarchy: Hierarchy, played: DataFrame) -> DataFrame:
    """(sub, super): the closed hierarchy, and each name of ``played`` (o) with itself."""
    return hierarchy.pairs(played.sparkSession).unionByName(played.select(F.col("o").alias("sub"), F.col("o").alias("super"))).distinct()


def run_text(graph: Graph, text: str, vocabulary: Vocabulary = Vocabulary(), **more: DataFrame) -> DataFrame:
    """The result of a stored query text over the graph; ``more`` are relations that the text names besides the graph's.

    The text may name use, produce, plays, contains, inform, types, roles and categories, and the parameters core, rp, pat,
    generated, type, label. It sees names of roles and categories as the graph has them. What it does not name is not read.
    """
    have = {"use": graph.use, "produce": graph.produce, "plays": graph.plays, "contains": graph.contains, "inform": graph.inform, "types": graph.types, **more}
    if "{roles}" in text:
        have["roles"] = reflexive(graph.roles, graph.plays)
    if "{categories}" in text:
        have["categories"] = reflexive(graph.categories, graph.contains)
    named = {name: relation.distinct() for name, relation in have.items() if "{" + name + "}" in text}
    args = {"core": vocabulary.core, "rp": vocabulary.pattern, "pat": vocabulary.catalogue, "generated": vocabulary.generated, "type": TYPE, "label": LABEL}
    return graph.use.sparkSession.sql(text, args={k: v for k, v in args.items() if f":{k}" in text}, **named)


def stored_text(spark: SparkSession, path: str) -> str:
    """The text at a path; a bare name is one of the library's own."""
    if "/" not in path:
        with open(os.path.join(STORED, path), encoding="utf-8") as f:
            return f.read()
    return read_text(spark, path)


def run_declared(graph: Graph, triples: DataFrame, motif: str, vocabulary: Vocabulary = Vocabulary(), **more: DataFrame) -> DataFrame:
    """Runs the implementation that the triples declare for ``motif``; none, several, or one in another language is an error."""
    rows = declared(triples, vocabulary).filter(F.col("motif") == motif).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{motif} has {'no' if not rows else 'more than one'} implementation")
    if rows[0]["language"] != LANGUAGE or not rows[0]["path"]:
        raise ValueError(f"{rows[0]['implementation']} is in {rows[0]['language']}, not in {LANGUAGE}, or has no path")
    return run_text(graph, stored_text(triples.sparkSession, rows[0]["path"]), vocabulary, **more)
