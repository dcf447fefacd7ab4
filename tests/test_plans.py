"""Plans that must not repeat work, and inputs and settings around them."""

import logging

import pytest
from pyspark.sql import functions as F

from plinth import cli, registry
from plinth.functions.storage import shared_dir
from plinth.functions.text import collapsed, stripped
from plinth.operators import incidents
from plinth.plans.settings import Settings
from plinth.sources import reports as io
from plinth.sources import turtle
from plinth.streaming import reports as streaming
from tests.graphs import TWO_HOPS


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name,most", [("relevance_gate_stub", 2), ("extraction_normalized", 2), ("relevant_counts", 2), ("finding_triples", 19), ("finding_records", 19), ("finding_leakage", 12), ("motif_bindings", 19)])
def test_sources_are_scanned_once(spark, sf, name, most):
    plan = registry.QUERIES[name](spark, sf)
    assert scans(plan) <= most


def test_models_are_asked_once_a_report(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"r{i}", "a search engine" if i % 2 else "none") for i in range(20)], "row_id long, report_id string, text string").repartition(3)
    asked = spark.sparkContext.accumulator(0)

    def client():
        def call(prompt, stage, report_id):
            asked.add(1)
            return '{"is_relevant": true}'

        return call

    records = incidents.extract(incidents.relevance_gate(incidents.normalised(raw), client), client).filter("meta.is_relevant")
    assert records.select("meta.report_id", "relevance_level").count() == 10
    assert records.collect() and asked.value in (20, 40)  # each action asks once a stage; the count may need no answer


def test_white_space(spark):
    rows = ["  a  b\t\tc d \n", " ", "", "a b", "\x1cx　", "a" + " " * 1_000_000 + "b"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select(stripped(F.col("x")).alias("s"), collapsed(F.col("x")).alias("c")).collect()
    assert [r["s"] for r in got] == [x.strip() for x in rows]
    assert [r["c"] for r in got] == [" a b c d ", " ", "", "a b", " x ", "a b"]


def test_rows_of_many_files_are_numbered_without_gaps(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("report_id"), F.lit("t").alias("text")).write.csv(str(tmp_path / "r"), header=True)
    rows = io.read_reports(spark, str(tmp_path / "r")).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000)) and [r["row_id"] for r in rows] == sorted(r["row_id"] for r in rows)
    (tmp_path / "none.csv").write_text("report_id,text\n")
    assert io.read_reports(spark, str(tmp_path / "none.csv")).count() == 0


def test_lines_that_are_no_statement_are_an_error(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<http://x/a> <http://x/p> <http://x/b> .\nnonsense here\n")
    with pytest.raises(Exception, match="no statement"):
        turtle.read_ntriples(spark, [str(tmp_path / "g.nt")], "g").collect()
    assert turtle.read_ntriples(spark, [str(tmp_path / "g.nt")], "g", skip_bad=True).count() == 1


def test_a_stream_batch_asks_only_for_what_the_cache_has_not(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"report_id": "r0", "text": "search"}\n{"report_id": "r1", "text": "search too"}\n')
    schema = spark.createDataFrame([], "report_id string, text string").schema

    def run(answer, n):
        def client():
            def call(prompt, stage, report_id):
                if answer is None:
                    raise RuntimeError("must not be asked")
                return answer

            return call

        stream = streaming.report_stream(spark, str(tmp_path / "in"), schema)
        streaming.run_stream(stream, client, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"), cache=str(tmp_path / "cache")).awaitTermination(120)
        return {r["meta"]["report_id"]: (r["meta"]["is_relevant"], r["system_profile"]["domain"]) for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()}

    first = run('{"is_relevant": true, "system_profile": {"domain": "news"}}', 1)
    assert first == run(None, 2) == {"r0": (True, "news"), "r1": (True, "news")}


def test_settings_of_a_file_and_bases_of_the_command_line(spark, tmp_path, monkeypatch, caplog):
    (tmp_path / "env").write_text('# own\nexport PLINTH_MODEL="m"\nPLINTH_MOST_REPORTS=7\n\nPLINTH_ENDPOINT=http://x\n')
    found = Settings.of(spark, str(tmp_path / "env"))
    assert (found.model, found.most_reports, found.endpoint) == ("m", 7, "http://x")
    monkeypatch.setenv("PLINTH_MODEL", "other")
    assert Settings.of(spark, str(tmp_path / "env")).model == "other"
    (tmp_path / "g.ttl").write_text(TWO_HOPS.replace("http://example.org/core#", "http://mine/core#").replace("http://example.org/risk-pattern#", "http://mine/rp/"))
    bases = ["--core", "http://mine/core#", "--pattern", "http://mine/rp/", "--taxonomy", "owasp=http://mine/owasp#"]
    with caplog.at_level(logging.INFO, logger="plinth"):
        assert cli.main(["assess", "--graph", str(tmp_path / "g.ttl"), "--out", str(tmp_path / "out"), *bases]) == 0
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 16 and any("http://mine/owasp#" in x for x in lines) and any("http://mine/rp/RiskFinding" in x for x in lines)
    assert "n_triples" in caplog.text


def test_shared_results_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())


def test_whole_texts_of_files_and_folders(spark, tmp_path):
    for name, text in (("b.txt", "second\nline"), ("a.txt", "first"), ("c.txt", "")):
        (tmp_path / name).write_text(text)
    assert io.read_text(spark, str(tmp_path / "b.txt")) == "second\nline" and io.read_text(spark, str(tmp_path / "c.txt")) == ""
    assert io.read_text(spark, str(tmp_path)) == "first\nsecond\nline"
    with pytest.raises(ValueError, match="more than 10 bytes"):
        io.read_text(spark, str(tmp_path), most_bytes=10)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_text(spark, str(tmp_path / "none"))
