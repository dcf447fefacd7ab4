"""Motifs and findings on small graphs: the worked example and its variants."""

import random

import pytest

from plinth.operators import motifs, risk
from plinth.operators.closure import Hierarchy, closure, closure_by_doubling, closure_of_chains, closure_sql
from plinth.sources import turtle
from plinth.sources.graph import graph_of, merged, read_triples, with_superproperties, write_triples
from tests.graphs import LLM, PREFIXES, TWO_HOPS


def load(spark, tmp_path, text):
    path = tmp_path / "g.ttl"
    path.write_text(text, encoding="utf-8")
    return graph_of(turtle.read_turtle(spark, [str(path)], "arch"))


def results(spark, tmp_path, text):
    g = load(spark, tmp_path, text)
    v, m = (motifs.solutions(g, x) for x in (motifs.VECTOR_IR, motifs.LLM_IR))
    return g, v, m, risk.leakage(g, v), risk.confabulation(g, m)


def test_worked_example(spark, tmp_path):
    g, v, m, leak, confab = results(spark, tmp_path, TWO_HOPS)
    assert [r["source"].split("#")[1] for r in v.collect()] == ["store"]
    assert motifs.match_triples(v, motifs.VECTOR_IR).count() == 19
    assert m.count() == 0 and confab.count() == 0
    rows = leak.collect()
    assert [r["hops"] for r in rows] == ["2"]
    assert rows[0]["match_iri"].endswith("motif-match/http%3A%2F%2Fexample.org%2Fshop%23retrieve-vector-ir")
    assert "%253A" in rows[0]["finding_iri"]
    assert risk.finding_triples(leak, risk.LEAKAGE).count() == 16
    record = risk.finding_records(leak, risk.LEAKAGE).collect()[0]
    assert len(record["evidence"]) == len(record["taxonomy"]) == len(record["controls"]) == 3


VARIANTS = {
    "no sensitive category": (TWO_HOPS.replace("containsDataCategory :PrivatePrices", "containsDataCategory rp:ProductInformation"), 1, 0, None),
    "result is user-facing": (TWO_HOPS + ":context rp:playsRole rp:UserFacingOutput .", 1, 1, "0,2"),
    "generation uses the result": (TWO_HOPS + ":prompt c:use :context .", 1, 1, "1,2"),
    "three hops": (TWO_HOPS.replace("c:use :better ; c:produce :summary", "c:use :best ; c:produce :summary") + ":more c:use :better ; c:produce :best .", 1, 0, None),
    "consumer generates nothing": (TWO_HOPS.replace("rp:GenerationStep", "rp:SomethingElse"), 1, 0, None),
    "two stores, one sensitive": (TWO_HOPS + ":retrieve c:use :other . :other rp:playsRole rp:VectorStore .", 2, 1, "2"),
    "duplicates": (TWO_HOPS + TWO_HOPS.split("rp:SensitiveInformation .\n")[-1], 1, 1, "2"),
    "cycle": (TWO_HOPS + ":retrieve c:inform :rerank . :rerank c:inform :retrieve . :rerank c:produce :question .", 1, 1, "2"),
    "two sub-roles": (TWO_HOPS + ":retrieve rp:playsRole rp:VectorBasedRetrievalStep .", 1, 1, "2"),
    "blank step": (TWO_HOPS.replace(":retrieve ", "_:r "), 1, 0, None),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_leakage_variants(spark, tmp_path, name):
    text, n_solutions, n_findings, hops = VARIANTS[name]
    _, v, _, leak, _ = results(spark, tmp_path, text)
    assert v.count() == n_solutions
    rows = leak.collect()
    assert len(rows) == n_findings and all(r["hops"] == hops for r in rows)


def test_blank_step_has_no_match(spark, tmp_path):
    _, v, *_ = results(spark, tmp_path, VARIANTS["blank step"][0])
    assert motifs.match_triples(v, motifs.VECTOR_IR).count() == 0


def test_confabulation_needs_no_source(spark, tmp_path):
    _, _, m, _, confab = results(spark, tmp_path, LLM)
    assert (m.count(), confab.count()) == (1, 1)
    _, v, m, _, confab = results(spark, tmp_path, LLM + ":ask c:use :s . :s rp:playsRole rp:VectorStore .")
    assert (v.count(), m.count(), confab.count()) == (0, 1, 0)


def test_step_in_both_motifs(spark, tmp_path):
    text = LLM + ":ask c:use :s ; c:produce :ctx . :s rp:playsRole rp:VectorStore . :ctx rp:playsRole rp:RetrievedContext ."
    _, v, m, *_ = results(spark, tmp_path, text)
    assert (v.count(), m.count()) == (1, 1)


def test_strict_classes(spark, tmp_path):
    text = TWO_HOPS + "c:Transform rdfs:subClassOf c:Process . :question a c:Data . :context a c:Data ."
    g = load(spark, tmp_path, text)
    assert motifs.solutions(g, motifs.VECTOR_IR, strict=True).count() == 0
    g = load(spark, tmp_path, text + " :store a c:Data .")
    assert motifs.solutions(g, motifs.VECTOR_IR, strict=True).count() == 1


def test_empty_graph(spark, tmp_path):
    _, v, m, leak, confab = results(spark, tmp_path, PREFIXES)
    assert v.count() == m.count() == leak.count() == confab.count() == 0


def test_hierarchy_is_reflexive_and_safe_on_cycles():
    h = Hierarchy([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("x", "x")])
    assert h.descendants("unknown") == ["unknown"]
    assert h.descendants("a") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "f"), ("f", "g")], [("a", "b"), ("b", "a"), ("b", "c"), ("q", "q")], []])
def test_closures_agree(spark, edges):
    df = spark.createDataFrame(edges, "sub string, super string")
    found = {(r["sub"], r["super"]) for r in closure(df).collect()}
    proper = [e for e in edges if e[0] != e[1]]
    assert found == {(s, t) for t in {x for e in proper for x in e} for s in Hierarchy(proper).descendants(t)}
    assert {(r["sub"], r["super"]) for r in closure_sql(spark, df.filter("sub <> super")).collect()} == found


def test_doubling_finds_least_hops(spark):
    rng = random.Random(5)
    for n in (0, 1, 30, 60):
        edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(n)] + [(f"n{i}", f"n{i + 1}") for i in range(n // 3)] + [("n9", "n0"), (None, "n1")]
        df = spark.createDataFrame(edges, "sub string, super string")
        shown = lambda found: sorted(tuple(r) for r in found.select("sub", "super", "hops").collect())
        assert shown(closure_by_doubling(df)) == shown(closure(df, reflexive=False))


def test_turtle_syntax(spark, tmp_path):
    text = '''@prefix a-b: <http://x/#> . @base <http://base/> .
# a comment
a-b:x a a-b:T-1 ; a-b:says "hi"@en , """two
"lines" here"""@en-GB ; a-b:n 3 , 4.5, true ;
  a-b:sub [ a a-b:U ; a-b:of ( a-b:p <rel> ) ] ; a-b:typed "5"^^a-b:num .
_:b1 a-b:esc "tab\\t\\u00e9" .
[ a-b:only a-b:this ] .
a-b:last a-b:is a-b:end .'''
    path = tmp_path / "t.ttl"
    path.write_text(text)
    rows = turtle.read_turtle(spark, [str(path)], "g").collect()
    o = {(r["p"].split("#")[1], r["o"], r["lang"], r["dt"]) for r in rows if r["o_kind"] == "literal"}
    assert ("says", "hi", "en", None) in o and ("says", 'two\n"lines" here', "en-gb", None) in o
    assert ("esc", "tab\té", None, None) in o and ("typed", "5", None, "http://x/#num") in o
    assert len(rows) == 17 and any(r["o"] == "http://base/rel" for r in rows)


def test_ntriples_round_trip(spark, tmp_path):
    path = tmp_path / "t.ttl"
    path.write_text(TWO_HOPS + ':q rdfs:label "a \\"quote\\"\\n\\\\"@en ; rdfs:note "1"^^<http://x#d> .')
    triples = turtle.read_turtle(spark, [str(path)], "g")
    turtle.write_ntriples(triples, str(tmp_path / "nt"))
    again = turtle.read_ntriples(spark, [str(tmp_path / "nt")], "g")
    assert set(again.collect()) == set(triples.collect())
    write_triples(triples, str(tmp_path / "pq"))
    assert set(read_triples(spark, str(tmp_path / "pq")).collect()) == set(triples.collect())
    assert merged(triples, again).count() == triples.count()


def test_superproperties(spark):
    df = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    out = with_superproperties(df, Hierarchy([("p", "q"), ("q", "r")]))
    assert sorted(r["p"] for r in out.collect()) == ["p", "q", "r"]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_chains_close_as_their_edges_do(spark, block):
    rows = [(c, 100 * c + i, i) for c, n in ((1, 1), (2, 4), (3, 11)) for i in range(n)]
    rows += [(4, 900, 0), (4, 901, 1), (4, 902, 2), (5, 902, 0), (5, 900, 1), (6, 950, 0), (6, 950, 1), (6, 951, 2), (7, 960, 0), (7, None, 1), (7, 961, 2), (7, 962, 3), (None, 970, 0), (None, 971, 1)]
    df = spark.createDataFrame(rows, "c long, node long, at long")
    edges = [(a[1], b[1]) for c in {r[0] for r in rows} for a, b in zip(*[[r for r in rows if r[0] == c][k:] for k in (0, 1)], strict=False)]
    shown = lambda d: sorted(map(tuple, d.select("sub", "super", "hops").collect()))
    found = closure_of_chains(df, "c", "node", "at", block=block)
    assert shown(found) == shown(closure_by_doubling(spark.createDataFrame(edges, "sub long, super long")))
    assert shown(closure_of_chains(df.limit(0), "c", "node", "at", block=block)) == []
