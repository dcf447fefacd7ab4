"""The store for star queries: its plans move nothing, its solutions are those of the joins."""

import uuid

import pytest

from plinth.operators import motifs
from plinth.operators.motifs import Motif, Node
from plinth.plans.graph_view import graph_view
from plinth.sources import star_store
from plinth.sources.graph import Graph

CATEGORY = Motif("C", "C", "-c", (Node("step", "step", "RetrievalStep"), Node("source", "source", "VectorStore", "use", category="Information", expected_class="Data")))
SETTING = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def stored(spark, sf):
    graph = graph_view(spark, sf)
    return graph, spark.table(star_store.write_stars(graph, buckets=6))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("motif", [*motifs.MOTIFS, CATEGORY], ids=lambda m: m.name)
def test_solutions_are_those_of_the_joins(stored, motif, strict):
    graph, store = stored
    got = sorted(map(tuple, star_store.star_solutions(store, graph, motif, strict).collect()))
    assert got == sorted(map(tuple, motifs.solutions(graph, motif, strict).collect()))
    assert got and len(got) == len(set(got))


def test_star_joins_move_nothing_and_read_their_predicates(spark, stored):
    graph, store = stored
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "-1")
    try:
        plan = star_store.star_solutions(store, graph, motifs.VECTOR_IR)._jdf.queryExecution().executedPlan().toString()
        plain = motifs.solutions(graph, motifs.VECTOR_IR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(SETTING, before)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Exchange" in plain
    assert plan.count("PartitionFilters: [isnotnull(p#") == 4
    assert "arrays_overlap" in plan


def test_nulls_repeats_unknown_objects_and_nothing(spark):
    edges = lambda rows: spark.createDataFrame(rows, "s string, o string")
    use = edges([("a", "q"), ("a", "q"), ("a", "v"), (None, "v"), ("a", None), ("a", "unknown"), ("b", "q"), ("b", "v")])
    produce = edges([("a", "r"), ("b", "r"), ("a", "other")])
    plays = edges([("a", "RetrievalStep"), ("a", "RetrievalStep"), ("a", "GenerationStep"), ("b", None), (None, "UserInput"), ("q", "UserInput"), ("v", "VectorStore"), ("v", "UserInput"), ("r", "RetrievedContext")])
    graph = Graph(use=use, produce=produce, plays=plays, contains=edges([]), types=edges([("q", "Data")]))
    store = spark.table(star_store.write_stars(graph, f"stars_{uuid.uuid4().hex}", buckets=3))
    name = motifs.VECTOR_IR.name
    assert sorted(map(tuple, star_store.star_solutions(store, graph, motifs.VECTOR_IR).collect())) == [(name, "a", "q", "v", "r"), (name, "a", "v", "v", "r")]
    assert star_store.star_solutions(store, graph, motifs.VECTOR_IR, strict=True).count() == 0
    rows = {(r["s"], r["p"], r["o"]): r for r in store.collect()}
    assert rows["a", "use", "unknown"]["roles"] == [] and rows["v", "self", None]["roles"] and len(rows) == store.count()
    empty = Graph(use=edges([]), produce=edges([]), plays=edges([]), contains=edges([]), types=edges([]))
    assert star_store.star_solutions(spark.table(star_store.write_stars(empty)), empty, motifs.VECTOR_IR).count() == 0
