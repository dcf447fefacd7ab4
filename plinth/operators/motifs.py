"""Graph motifs as specifications that compile to joins.

A motif is a star around a step: roles of the step and of what it uses and produces. Roles are tested with semi-joins,
so the number of roles an element plays never multiplies rows, and all joins are on the step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import encode_for_uri
from plinth.plans.vocabulary import LABEL, TYPE, Vocabulary
from plinth.sources.graph import Graph


@dataclass(frozen=True)
class Node:
    """column: its name in solutions; pattern: in the catalogue; edge: 'use', 'produce' or None for the step itself."""

    column: str
    pattern: str
    role: str
    edge: str | None = None
    category: str | None = None
    expected_class: str | None = None


@dataclass(frozen=True)
class Motif:
    name: str
    label: str
    suffix: str
    nodes: tuple[Node, ...]


#: Names, labels, roles and IRI suffixes of the two built-in motifs.
VECTOR_IR = Motif(
    "VectorBasedInformationRetrievalMotif", "Vector-based information retrieval motif match", "-vector-ir",
    (
        Node("step", "VectorIR_RetrievalStepNode", "RetrievalStep", expected_class="Process"),
        Node("query", "VectorIR_QueryNode", "UserInput", "use", expected_class="Data"),
        Node("source", "VectorIR_VectorStoreNode", "VectorStore", "use", expected_class="Data"),
        Node("result", "VectorIR_RetrievedResultNode", "RetrievedContext", "produce", expected_class="Data"),
    ),
)
LLM_IR = Motif(
    "LLMBasedInformationRetrievalMotif", "LLM-based information retrieval motif match", "-llm-ir",
    (
        Node("step", "LLMIR_RetrievalStepNode", "LLMBasedInformationRetrievalStep", expected_class="Process"),
        Node("query", "LLMIR_QueryNode", "UserInput", "use", expected_class="Data"),
        Node("source", "LLMIR_ModelNode", "GenerativeModel", "use", expected_class="Model"),
        Node("result", "LLMIR_AnswerNode", "UserFacingOutput", "produce", expected_class="Data"),
    ),
)
MOTIFS = (VECTOR_IR, LLM_IR)
#: Last part of a binding's IRI, by column.
BINDING_PATHS = {"query": "query", "step": "retrieval-step", "source": "source-or-model", "result": "result"}


def node_elements(graph: Graph, node: Node, strict: bool) -> DataFrame:
    """(s): elements that the node may bind."""
    out = graph.with_role(node.role)
    if node.category:
        out = out.join(graph.with_category(node.category), "s", "left_semi")
    if strict and node.expected_class:
        out = out.join(graph.with_class(node.expected_class), "s", "left_semi")
    return out


def solutions(graph: Graph, motif: Motif, strict: bool = False) -> DataFrame:
    """(motif, step, query, source, result): distinct solutions; two nodes may bind one element if its roles allow it.

    ``strict`` also asks for the expected classes, through their sub-classes.
    """
    step = next(n for n in motif.nodes if n.edge is None)
    out = node_elements(graph, step, strict).select(F.col("s").alias("step"))
    for node in motif.nodes:
        if node.edge:
            relation = getattr(graph, node.edge).select(F.col("s").alias("step"), F.col("o").alias("s"))
            bound = relation.join(node_elements(graph, node, strict), "s", "left_semi")
            out = out.join(bound.select("step", F.col("s").alias(node.column)), "step")
    return out.select(F.lit(motif.name).alias("motif"), *(n.column for n in motif.nodes)).distinct()


def match_iri(step, suffix: str, vocabulary: Vocabulary):
    return F.concat(F.lit(vocabulary.generated + "motif-match/"), encode_for_uri(step), F.lit(suffix))


def bindings(found: DataFrame, motif: Motif, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(match_iri, motif, binding_iri, pattern_node, node, element): one match a step, its nodes bound to sets of elements.

    A step without an IRI, which is a blank node, gets no match.
    """
    with_iri = found.filter(~F.col("step").startswith("_:")).withColumn("match_iri", match_iri(F.col("step"), motif.suffix, vocabulary))
    parts = F.array(*(F.struct(F.lit(BINDING_PATHS[n.column]).alias("path"), F.lit(vocabulary.pat(n.pattern)).alias("pattern_node"), F.lit(n.column).alias("node"), F.col(n.column).alias("element")) for n in motif.nodes))
    flat = with_iri.select("match_iri", "motif", F.explode(parts).alias("b"))
    return flat.select("match_iri", "motif", F.concat("match_iri", F.lit("/binding/"), "b.path").alias("binding_iri"), "b.pattern_node", "b.node", "b.element").distinct()


def match_triples(found: DataFrame, motif: Motif, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(s, p, o): triples of matches and bindings, as a set."""
    rp = vocabulary.p
    bound = bindings(found, motif, vocabulary)
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    match, binding = F.col("match_iri"), F.col("binding_iri")
    triples = F.array(
        t(match, TYPE, F.lit(rp("MotifMatch"))), t(match, LABEL, F.lit(motif.label)), t(match, rp("matchesMotif"), F.lit(vocabulary.pat(motif.name))), t(match, rp("hasNodeBinding"), binding),
        t(binding, TYPE, F.lit(rp("NodeBinding"))), t(binding, rp("bindsPatternNode"), F.col("pattern_node")), t(binding, rp("matchedElement"), F.col("element")),
    )
    return bound.select(F.explode(triples).alias("t")).select("t.*").filter("s is not null and o is not null").distinct()


def evidence_edges(graph: Graph, found: DataFrame) -> DataFrame:
    """(step, p, o): the use and produce edges that the solutions rest on."""
    flat = found.select("step", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for p, c in (("use", "query"), ("use", "source"), ("produce", "result"))))).alias("e"))
    return flat.select("step", "e.*").distinct()
