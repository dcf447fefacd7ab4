"""Declared patterns, property paths, conditions and interpretations."""

import pytest

from plinth.operators import patterns
from plinth.sources import turtle
from plinth.sources.graph import graph_of
from tests.graphs import TWO_HOPS

CATALOGUE = """
@prefix pat: <http://example.org/patterns#> .
@prefix tax: <http://example.org/taxonomy#> .
pat:Chain a rp:GraphMotif ; rp:hasPatternNode pat:n1 , pat:n2 , pat:n3 ; rp:hasPatternEdge pat:e1 , pat:e2 ; rp:hasCondition pat:k1 , pat:k2 ; rp:hasInterpretation pat:i1 .
pat:n1 rp:variableName "step" ; rp:expectedRole rp:RetrievalStep ; rp:expectedClass c:Transform .
pat:n2 rp:variableName "item" ; rp:expectedRole rp:RetrievedContext .
pat:n3 rp:variableName "next" .
pat:e1 rp:sourcePatternNode pat:n1 ; rp:patternPredicate c:produce ; rp:targetPatternNode pat:n2 .
pat:e2 rp:sourcePatternNode pat:n3 ; rp:patternPredicate c:use ; rp:targetPatternNode pat:n2 .
pat:k1 rp:pathExpression "step.use/containsDataCategory/subDataCategoryOf* http://example.org/risk-pattern#SensitiveInformation" .
pat:k2 rp:conditionExpression "absent next playsRole http://example.org/risk-pattern#GenerationStep" .
pat:i2 rp:interpretsMotif pat:Chain ; rp:interpretedAsMechanism pat:m2 .
pat:i1 rp:interpretedAsMechanism pat:m1 ; rp:mayIndicateRisk tax:a , tax:b ; rp:suggestedControl tax:c .
"""


@pytest.fixture
def triples(spark, tmp_path):
    path = tmp_path / "g.ttl"
    path.write_text(TWO_HOPS + CATALOGUE, encoding="utf-8")
    return turtle.read_turtle(spark, [str(path)], "arch")


def test_declared_pattern(spark, triples):
    (pattern,) = patterns.declared_patterns(triples)
    assert pattern.nodes["step"] == patterns.PatternNode("RetrievalStep", None, "Transform") and len(pattern.edges) == 2 and len(pattern.conditions) == 2
    g, relation = graph_of(triples), patterns.relations_in(triples)
    rows = patterns.matches(g, pattern, relation).collect()
    assert [tuple(v.split("#")[1] for v in r) for r in rows] == [("retrieve", "context", "rerank")]
    assert patterns.matches(g, pattern, relation, strict=True).count() == 1


@pytest.mark.parametrize("kind,least,most,n", [("count", 3, None, 1), ("count", 1, 1, 2), ("count", 4, None, 0), ("exists", 1, None, 3), ("absent", 1, None, 0)])
def test_conditions(spark, triples, kind, least, most, n):
    relation = patterns.relations_in(triples)
    steps = relation("produce").select("s").distinct()
    assert patterns.satisfied(patterns.Condition(kind, "x", "use", None, least, most), relation, steps).count() == n


def edges(spark):
    rows = {"p": [("a", "b"), ("b", "c"), ("c", "a")], "q": [("c", "d"), ("d", "d")]}
    return lambda name: spark.createDataFrame(rows[name], "s string, o string")


@pytest.mark.parametrize("path,pairs", [
    ("p/q", {("b", "d")}), ("^p", {("b", "a"), ("c", "b"), ("a", "c")}), ("p|q", {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")}),
    ("p/q?", {("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")}), ("(p/q)+", {("b", "d")}), ("q+", {("c", "d"), ("d", "d")}), ("p/p*", {(x, y) for x in "abc" for y in "abc"}),
    ("q*", {("c", "c"), ("c", "d"), ("d", "d")}), ("p*/q", {("a", "d"), ("b", "d"), ("c", "d"), ("d", "d")}),
])
def test_paths(spark, path, pairs):
    assert {tuple(r) for r in patterns.Path(path, edges(spark)).pairs().collect()} == pairs


@pytest.mark.parametrize("path", ["", "p/", "(p", "p)", "p//q", "*"])
def test_bad_paths(spark, path):
    with pytest.raises(ValueError):
        patterns.Path(path, edges(spark)).pairs()


def test_interpretations(spark, triples):
    table = patterns.declared_interpretations(triples)
    found = spark.createDataFrame([("m", "http://example.org/patterns#Chain"), ("n", "http://example.org/patterns#Other")], "match_iri string, motif string")
    rows = {r["interpretation"].split("#")[1]: r for r in patterns.interpreted(found, table).collect()}
    assert set(rows) == {"i1", "i2"} and len(rows["i1"]["risks"]) == 2 and rows["i2"]["controls"] == []


def test_difference(spark):
    a, b = (spark.createDataFrame(x, "s string, o string") for x in ([("1", "2"), ("1", "2"), ("3", "4")], [("1", "2"), ("5", "6")]))
    assert {tuple(r) for r in patterns.difference(a, b).collect()} == {("left", "3", "4"), ("right", "5", "6")}
