"""Interpretation of motif matches as candidate risk findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.storage import written
from plinth.functions.text import encode_for_uri
from plinth.operators.motifs import LLM_IR, VECTOR_IR, Motif, match_iri
from plinth.plans.vocabulary import DESCRIPTION, LABEL, TYPE, Vocabulary
from plinth.sources.graph import Graph


@dataclass(frozen=True)
class Interpretation:
    motif: Motif
    mechanism: str
    label: str
    description: str
    suffix: str
    taxonomy: tuple[str, ...]
    controls: tuple[str, ...]
    evidence: tuple[str, ...]


#: Mechanisms, texts, suffixes, taxonomy entries, controls and evidence of the two interpretations.
LEAKAGE = Interpretation(
    VECTOR_IR, "SensitiveDataRetrievalExposure", "Candidate Information Leakage from vector-based retrieval",
    "A vector store containing sensitive information is used by a retrieval step, and the retrieved context may flow into user-facing output.",
    "-information-leakage",
    ("atlas:exposing-personal-information", "owasp:llm02-sensitive-information-disclosure", "mit:privacy-and-data-protection"),
    ("mitctrl:data-minimization", "mitctrl:sensitive-data-filtering", "mitctrl:access-control"),
    ("source", "step", "result"),
)
CONFABULATION = Interpretation(
    LLM_IR, "DirectLLMAnsweringWithoutGrounding", "Candidate Confabulation from LLM-based information retrieval",
    "An LLM-based information retrieval step produces a user-facing answer without an explicit knowledge source represented in the matched architecture.",
    "-confabulation",
    ("atlas:incorrect-output", "atlas:hallucination", "mit:information-integrity"),
    ("mitctrl:grounding", "mitctrl:retrieval-augmentation", "mitctrl:output-verification"),
    ("query", "step", "result"),
)
INTERPRETATIONS = (LEAKAGE, CONFABULATION)


def exposed(graph: Graph, most_hops: int = 2) -> DataFrame:
    """(s, hops): elements that are user-facing (0), or reach user-facing output over a generation step (1), with other steps before it (2 and more).

    An element has a row for each number of hops it is exposed by; levels that find nothing add nothing. Each level is
    written, so that the plan does not nest one in the next.
    """
    facing = graph.with_role("UserFacingOutput")
    produced = graph.produce.select(F.col("s").alias("step"), F.col("o").alias("s"))
    used = graph.use.select(F.col("s").alias("step"), F.col("o").alias("s"))
    out = facing.withColumn("hops", F.lit(0))
    last = produced.join(facing, "s", "left_semi").select("step").join(graph.with_role("GenerationStep").withColumnRenamed("s", "step"), "step", "left_semi")
    for hops in range(1, most_hops + 1):
        elements = written(used.join(last, "step", "left_semi").select("s").distinct(), "exposed")
        out = out.unionByName(elements.withColumn("hops", F.lit(hops)))
        last = produced.join(elements, "s", "left_semi").select("step")
    return out


def collapsed_nodes(found: DataFrame, columns: tuple[str, ...]) -> list[DataFrame]:
    """(step, column) of each column: what a match binds once solutions of one step are collapsed."""
    return [found.select("step", c).distinct() for c in columns]


def leakage(graph: Graph, found: DataFrame, vocabulary: Vocabulary = Vocabulary(), most_hops: int = 2) -> DataFrame:
    """(finding_iri, match_iri, step, source, result, hops): matches whose sensitive store flows into user-facing output.

    ``hops`` lists the ways, as in '0,2'. Sources and results are those of the collapsed match, so each sensitive
    source goes with each exposed result of its step.
    """
    sources, results = collapsed_nodes(found, ("source", "result"))
    sensitive = sources.join(graph.with_category("SensitiveInformation").withColumnRenamed("s", "source"), "source", "left_semi")
    ways = results.join(exposed(graph, most_hops).withColumnRenamed("s", "result"), "result").groupBy("step", "result")
    shown = ways.agg(F.array_join(F.array_sort(F.collect_set(F.col("hops").cast("string"))), ",").alias("hops"))
    return _finding(sensitive.join(shown, "step"), LEAKAGE, vocabulary).select("finding_iri", "match_iri", "step", "source", "result", "hops")


def confabulation(graph: Graph, found: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(finding_iri, match_iri, step, query, result): matches whose step uses no knowledge source of any kind."""
    grounded = graph.use.select(F.col("s").alias("step"), F.col("o").alias("s")).join(graph.with_role("KnowledgeSource"), "s", "left_semi").select("step")
    queries, results = collapsed_nodes(found, ("query", "result"))
    free = queries.join(grounded, "step", "left_anti").join(results, "step")
    return _finding(free, CONFABULATION, vocabulary).select("finding_iri", "match_iri", "step", "query", "result")


def _finding(rows: DataFrame, what: Interpretation, vocabulary: Vocabulary) -> DataFrame:
    named = rows.filter(~F.col("step").startswith("_:")).withColumn("match_iri", match_iri(F.col("step"), what.motif.suffix, vocabulary))
    return named.withColumn("finding_iri", F.concat(F.lit(vocabulary.generated + "risk-finding/"), encode_for_uri(F.col("match_iri")), F.lit(what.suffix)))


def finding_triples(findings: DataFrame, what: Interpretation, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(s, p, o) of the findings, as a set; multiple values are unions, never a product of taxonomy and controls."""
    rp = vocabulary.p
    t = lambda p, o: F.struct(F.col("finding_iri").alias("s"), F.lit(p).alias("p"), (o if not isinstance(o, str) else F.lit(o)).alias("o"))
    fixed = [
        t(TYPE, rp("RiskFinding")), t(LABEL, what.label), t(DESCRIPTION, what.description), t(rp("generatedFromMatch"), F.col("match_iri")),
        t(rp("generatedByMotif"), vocabulary.pat(what.motif.name)), t(rp("hasInterpretedMechanism"), vocabulary.pat(what.mechanism)), t(rp("findingStatus"), "candidate"),
    ]
    many = [t(rp("hasEvidenceElement"), F.col(c)) for c in what.evidence]
    many += [t(rp("hasCandidateRiskTaxonomyEntry"), vocabulary.entry(e)) for e in what.taxonomy] + [t(rp("hasSuggestedControl"), vocabulary.entry(e)) for e in what.controls]
    return findings.select(F.explode(F.array(*fixed, *many)).alias("t")).select("t.*").distinct()


def finding_records(findings: DataFrame, what: Interpretation, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row a finding, with sorted arrays evidence, taxonomy and controls."""
    literal = lambda entries: F.lit(sorted(vocabulary.entry(e) for e in entries))
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(*what.evidence)))))
    grouped = findings.groupBy("finding_iri", "match_iri").agg(evidence.alias("evidence"))
    return grouped.select(
        "finding_iri", "match_iri", F.lit(vocabulary.pat(what.motif.name)).alias("motif"), F.lit(vocabulary.pat(what.mechanism)).alias("mechanism"), F.lit(what.label).alias("label"),
        F.lit(what.description).alias("description"), F.lit("candidate").alias("status"), "evidence", literal(what.taxonomy).alias("taxonomy"), literal(what.controls).alias("controls"),
        F.lit(None).cast("decimal(5,4)").alias("confidence"),
    )
