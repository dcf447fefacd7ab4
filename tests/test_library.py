"""Motif libraries, stored implementations, search from targets, splittable CSV, and the life of findings."""

import csv
import random
from dataclasses import replace

import pytest


from plinth import registry
from plinth.operators import implementations, library, lifecycle, motifs
from plinth.operators.closure import reach
from plinth.plans import graph_view as gv
from plinth.plans.vocabulary import Vocabulary
from plinth.sources import reports as io
from plinth.sources.csv_records import read_csv_records

V = Vocabulary()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_library_finds_what_its_motifs_find(spark, sf):
    g = gv.graph_view(spark, sf).written("use", "produce", "plays", "contains", "types")
    strict = replace(motifs.VECTOR_IR, name="Sensitive", nodes=tuple(replace(n, category="SensitiveInformation") if n.column == "source" else n for n in motifs.VECTOR_IR.nodes))
    every = (motifs.VECTOR_IR, motifs.LLM_IR, strict, *registry.LIBRARY[:3])
    for checked in (False, True):
        one_by_one = [r for m in every for r in rows(motifs.solutions(g, m, checked))]
        assert rows(library.library_solutions(g, every, checked)) == sorted(one_by_one) and one_by_one


def test_a_library_reads_the_graph_once_however_large(spark, sf):
    g = gv.graph_view(spark, sf).written("use", "produce", "plays", "contains")
    shown = lambda ms: library.library_solutions(g, ms)._jdf.queryExecution().optimizedPlan().toString()
    counted = [[shown(ms).count(what) for what in ("Relation [", "Join ", "Aggregate ")] for ms in (registry.LIBRARY[:1], registry.LIBRARY)]
    assert counted[0] == counted[1]


def test_motifs_of_a_library_share_columns(spark, sf):
    g = gv.graph_view(spark, sf)
    other = replace(motifs.LLM_IR, nodes=motifs.LLM_IR.nodes[:3])
    for wrong in ((motifs.VECTOR_IR, other), (motifs.LLM_IR, motifs.LLM_IR), ()):
        with pytest.raises(ValueError, match="columns"):
            library.library_solutions(g, wrong)


def declaration(spark, language=implementations.LANGUAGE, path="motif_matches.sql", n=1):
    motif = V.pat("M")
    out = [(motif, V.p("implementedBy"), f"i{k}") for k in range(n)]
    out += [(f"i{k}", V.p(p), o) for k in range(n) for p, o in (("implementsMotif", motif), ("implementationLanguage", language), ("implementationPath", path)) if o]
    return motif, spark.createDataFrame(out, "s string, p string, o string")


def test_declared_implementations_run(spark, sf, tmp_path):
    g = gv.graph_view(spark, sf)
    (tmp_path / "own.sql").write_text("SELECT concat(:rp, x.s) AS s, count(*) AS n\nFROM {use} x JOIN {more} m ON m.o = x.o GROUP BY x.s")
    motif, triples = declaration(spark, path=str(tmp_path / "own.sql"))
    more = g.use.select("o").distinct().limit(3).persist()
    found = rows(implementations.run_declared(g, triples, motif, more=more))
    kept = {r["o"] for r in more.collect()}
    want = {}
    for s, o in {(r["s"], r["o"]) for r in g.use.collect()}:
        if o in kept:
            want[V.pattern + s] = want.get(V.pattern + s, 0) + 1
    assert found == sorted(want.items())


@pytest.mark.parametrize(("given", "why"), [({"language": "SPARQL"}, "is in SPARQL"), ({"path": None}, "no path"), ({"n": 2}, "more than one"), ({"n": 0}, "no implementation")])
def test_what_cannot_run_is_an_error(spark, sf, given, why):
    g = gv.graph_view(spark, sf)
    motif, triples = declaration(spark, **given) if given.get("n", 1) else (V.pat("M"), spark.createDataFrame([("a", "b", "c")], "s string, p string, o string"))
    with pytest.raises(ValueError, match=why):
        implementations.run_declared(g, triples, motif)


def test_reach_ends_on_cycles_and_takes_the_shortest_way(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("x", "a"), ("b", "t"), ("y", "z"), ("z", "y"), ("q", "q"), (None, "t"), ("t", None)]
    edges = spark.createDataFrame(pairs, "sub string, super string")
    targets = spark.createDataFrame([("t",), ("alone",), (None,), ("t",)], "s string")
    assert rows(reach(edges, targets)) == [("a", 2), ("alone", 0), ("b", 1), ("c", 1), ("t", 0), ("x", 3)]
    assert rows(reach(edges, targets, most_hops=1)) == [("alone", 0), ("b", 1), ("c", 1), ("t", 0)]
    assert reach(edges.limit(0), targets.limit(0)).count() == 0
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(19)], "sub string, super string")
    assert rows(reach(chain, spark.createDataFrame([("n0",)], "s string"))) == sorted((f"n{i}", i) for i in range(20))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_csv_is_read_by_many_tasks_a_file(spark, tmp_path, seed):
    rng, want, tmp_path = random.Random(seed), [], tmp_path / "a b é"
    tmp_path.mkdir()
    for f in range(3):
        pieces = ["a", '"', "\n", "\r", ",", " ", "é漢", "x y", "\r\n", '""', "\n\n\n"]
        own = [[str(len(want) + i), "".join(rng.choices(pieces, k=rng.randrange(1, 80))), rng.choice(["", "z", " w "])] for i in range(70)]
        with open(tmp_path / f"p{f}.csv", "w", newline="", encoding="utf8") as out:
            w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
            w.writerow(["id", "a `b`", "k"] + ["x" * 2000] * (f == 1))
            w.writerows(own[:30])
            out.write("\n \n")
            w.writerows(own[30:])
        want += own
    (tmp_path / "p9.csv").write_text("id,a `b`,k\n")
    conf = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
        found = sorted(read_csv_records(spark, str(tmp_path)).collect(), key=lambda r: r["row_id"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["row_id"] for r in found] == list(range(len(want)))
    assert [[r["id"], r["a `b`"], r["k"] or ""] for r in found] == want


def test_csv_readers_agree(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,text\n1,"two\nlines, and ""quotes"""\n2,NA\n3,\n\n4,"last"')
    whole, split = (sorted(map(tuple, io.read_reports(spark, str(tmp_path / "r.csv"), whole_files=w).collect())) for w in (True, False))
    assert whole == split and len(split) == 4
    (tmp_path / "none.csv").write_text("id,text\n")
    assert io.read_reports(spark, str(tmp_path / "none.csv"), whole_files=False).count() == 0


def test_life_of_findings(spark):
    found = lambda *names: spark.createDataFrame([(n,) for n in names], "finding_iri string")
    state = lifecycle.merged(spark.createDataFrame([], lifecycle.STATE_SQL), found("a", "b", "c", "d", "d", None), "2024-01-01 00:00:00")
    decide = spark.createDataFrame([("a", "confirmed"), ("b", "rejected"), ("c", "mitigated"), ("x", "reviewed"), ("d", "reviewed"), ("d", "confirmed")], "finding_iri string, status string")
    state, refused = lifecycle.reviewed(state, decide, "2024-01-02 00:00:00")
    assert rows(refused) == [("c", "mitigated", "candidate may not become mitigated"), ("d", "confirmed", "several decisions"), ("d", "reviewed", "several decisions"), ("x", "reviewed", "no such finding")]
    state = lifecycle.merged(state, found("a", "e"), "2024-01-03 00:00:00")
    shown = {r["finding_iri"]: (r["status"], r["runs"], [h["status"] for h in r["history"]]) for r in state.collect()}
    assert shown == {
        "a": ("confirmed", 2, ["candidate", "confirmed"]), "b": ("rejected", 1, ["candidate", "rejected"]), "c": ("retired", 1, ["candidate", "retired"]),
        "d": ("retired", 1, ["candidate", "retired"]), "e": ("candidate", 1, ["candidate"]),
    }
    again = {r["finding_iri"]: (r["status"], str(r["first_seen"])[:10], str(r["last_seen"])[:10]) for r in lifecycle.merged(state, found("c"), "2024-01-04 00:00:00").collect()}
    assert again["c"] == ("candidate", "2024-01-01", "2024-01-04") and again["a"][0] == "retired" and again["b"] == ("rejected", "2024-01-01", "2024-01-01")


def test_confidence_grows_with_ways_and_falls_with_hops(spark):
    leaks = spark.createDataFrame([("near", "s", "r", "0"), ("far", "s", "r", "2"), ("both", "s", "r", "0,2"), *[("many", f"s{i}", "r", "0") for i in range(40)]], "finding_iri string, source string, result string, hops string")
    found = {r["finding_iri"]: float(r["confidence"]) for r in lifecycle.leakage_confidence(leaks).collect()}
    assert found == {"near": 0.8, "far": 0.2667, "both": 0.8533, "many": 0.9999}
