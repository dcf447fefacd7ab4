"""Reports, prefilter, gate, extraction, cache and stream."""

import json

import pytest

from plinth.functions.text import cache_key, encode_for_uri, stripped
from plinth.operators import incidents
from plinth.sources import reports as io
from plinth.streaming import reports as streaming
from pyspark.sql import functions as F


def report_rows(spark, n=1, text="a search engine"):
    raw = spark.createDataFrame([(i, f"r{i}", "T", text) for i in range(n)], "row_id long, report_id string, title string, text string")
    return incidents.normalised(raw)


def answering(*answers):
    def make():
        def call(prompt, stage, report_id):
            answer = answers[int(report_id[1:]) % len(answers)]
            if isinstance(answer, Exception):
                raise answer
            return answer

        return call

    return make


def test_csv_and_normalisation(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('id,title,summary,body,extra\n 7 ,"Two\nlines ""q""",NA,nan,x\n,  ,None,text,y\n', encoding="utf-8")
    rows = incidents.normalised(io.read_reports(spark, str(path))).orderBy("row_id").collect()
    assert [r["report_id"] for r in rows] == ["7", "row_1"]
    assert rows[0]["full_text"] == 'TITLE: Two\nlines "q"' and rows[0]["description"] == ""
    assert rows[1]["title"] == "" and rows[1]["full_text"] == "BODY: text" and rows[1]["url"] == ""


def test_long_text_is_cut_by_code_points(spark):
    r = report_rows(spark, text="\U0001f600" * 9000).collect()[0]
    assert len(r["full_text"]) == 8000


def test_no_known_column(spark):
    r = incidents.normalised(spark.createDataFrame([(0, "x")], "row_id long, other string")).collect()[0]
    assert (r["report_id"], r["full_text"], r["title"]) == ("row_0", "", "")


@pytest.mark.parametrize("text,hit", [("cold storage", True), ("semantic \n  search", True), ("QATAR", True), ("nothing here", False)])
def test_prefilter_is_a_substring_test(spark, text, hit):
    assert report_rows(spark, text=text).select(incidents.has_hint()).collect()[0][0] is hit


def test_reduced_terms_are_equivalent():
    few = incidents.reduced(incidents.RETRIEVAL_HINTS)
    assert len(incidents.RETRIEVAL_HINTS) == 40 and len(few) == 22
    assert all(any(f in t for f in few) for t in incidents.RETRIEVAL_HINTS)


@pytest.mark.parametrize("text,value", [('{"a": 1}', {"a": 1}), ("x ```json\n{\"a\": 2}\n``` y", {"a": 2}), ('so {"a": 3} it', {"a": 3}), ("[1]", [1]), ("", None), ('{"a":', None), ('{"a": 1} and {"b": 2}', None), ('{"a": NaN, "a": 4}', {"a": 4})])
def test_json_in_answers(text, value):
    assert incidents.json_in(text) == value


@pytest.mark.parametrize("value,truth", [("true", True), ('"false"', True), ("0", False), ('""', False), ("[]", False)])
def test_truth_follows_python(value, truth):
    assert incidents.gate_of(json.loads('{"is_relevant": ' + value + "}"))["is_relevant"] is truth


def test_gate_and_extraction(spark):
    reports = report_rows(spark, 4)
    answers = ['{"is_relevant": true, "matched_modes": ["a", null, 2], "meta": {"title": ""}, "evidence": [1], "system_profile": {"ai_task": "t", "stakeholders": ["Unknown", "u"]}, "risk_assessment": {"confidence": " "}}', "junk", RuntimeError("boom"), '{"is_relevant": 0}']
    gated = incidents.relevance_gate(reports, answering(*answers))
    rows = {r["row_id"]: r for r in incidents.extract(gated, answering(*answers)).collect()}
    assert [rows[i]["meta"]["is_relevant"] for i in range(4)] == [True, False, False, False]
    assert rows[0]["meta"]["title"] == "" and rows[0]["meta"]["report_id"] == "r0"
    assert rows[0]["system_profile"]["ai_task"] == ["t"] and rows[0]["system_profile"]["stakeholders"] == ["u"]
    assert rows[0]["risk_assessment"]["confidence"] == "unknown" and rows[0]["evidence"]["risk_evidence"] == []
    assert rows[0]["matched_modes"] == ["a", "None", "2"]
    assert rows[1]["meta"]["relevance_reason"] == "LLM response could not be parsed" and rows[1]["system_profile"] is None
    assert rows[2]["meta"]["relevance_reason"] == "pipeline_error: boom"
    filled = {r["row_id"]: r for r in incidents.extract(gated, answering(*answers), filled=True).collect()}
    assert filled[1]["risk_assessment"]["confidence"] == "low" and filled[1]["system_profile"]["ai_task"] == []


def test_extraction_stage_may_fail_alone(spark):
    gated = incidents.relevance_gate(report_rows(spark), answering('{"is_relevant": true, "relevance_level": "direct"}'))
    row = incidents.extract(gated, answering(RuntimeError("late"))).collect()[0]
    assert row["meta"]["relevance_reason"] == "pipeline_error: late" and row["relevance_level"] == "direct" and not row["meta"]["is_relevant"]


def test_cache_spares_calls_and_skips_failures(spark):
    reports = report_rows(spark, 3)
    first = incidents.ask(reports, "relevance", answering('{"is_relevant": true}', "junk", RuntimeError("x")))
    cache = incidents.cache_rows(first, "2024-01-01 00:00:00")
    assert cache.count() == 1 and incidents.cache_rows(first, "2024-01-01 00:00:00", keep_failures=True).count() == 2
    again = {r["row_id"]: r for r in incidents.ask(reports, "relevance", answering(RuntimeError("y")), cache=cache).collect()}
    assert again[0]["cached"] and again[0]["failure"] is None and again[1]["failure"] == "y"


def test_key_modes():
    a, b = "p" * 3000 + "1", "p" * 3000 + "2"
    assert incidents.key_of("s", "r", a, True) == incidents.key_of("s", "r", b, True)
    assert incidents.key_of("s", "r", a) != incidents.key_of("s", "r", b)


def test_json_sink(spark, tmp_path):
    gated = incidents.relevance_gate(report_rows(spark, 2, "é nothing"), answering("unused"))
    n = io.write_record_array(incidents.extract(gated, answering("unused")), str(tmp_path / "o.json"))
    data = json.loads((tmp_path / "o.json").read_text(encoding="utf-8"))
    assert n == 2 and data[0]["system_profile"] == {} and data[1]["meta"]["report_id"] == "r1"
    assert list(data[0]) == ["meta", "system_profile", "risk_assessment", "risk_pattern", "evidence", "matched_modes", "relevance_level", "detected_system_behavior"]


def test_scalars(spark):
    rows = [("a b*c~d+é",), (" x\x1c",), ("  A  b ",)]
    df = spark.createDataFrame(rows, "x string")
    got = df.select(encode_for_uri(F.col("x")), stripped(F.col("x")), cache_key(F.col("x"), F.lit("Z"))).collect()
    assert got[0][0] == "a%20b%2Ac~d%2B%C3%A9" and got[1][1] == "x"
    import hashlib

    assert got[2][2] == hashlib.md5(b"a b||z").hexdigest()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"report_id": "r0", "text": "search"}\n{"report_id": "r1", "text": "none"}\n{"report_id": "r0", "text": "search again"}\n')
    schema = spark.createDataFrame([], "report_id string, text string").schema
    stream = streaming.report_stream(spark, str(tmp_path / "in"), schema)
    streaming.run_stream(stream, answering('{"is_relevant": true}'), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = {r["meta"]["report_id"]: r["meta"]["is_relevant"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"r0": True, "r1": False}


def test_cache_folder(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert io.read_cache(spark, path).count() == 0
    answers = incidents.ask(report_rows(spark, 2), "relevance", answering('{"is_relevant": true}', '{"is_relevant": false}'))
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        io.append_cache(answers, path, at)
    cache = io.read_cache(spark, path)
    assert cache.count() == 4 and incidents.latest(cache).count() == 2
    assert all(r["cached"] for r in incidents.ask(report_rows(spark, 2), "relevance", answering("unused"), cache=cache).collect())


def test_settings(spark, monkeypatch):
    from plinth.plans.settings import Settings

    monkeypatch.setenv("PLINTH_MODEL", "m")
    monkeypatch.setenv("PLINTH_MOST_REPORTS", "all")
    found = Settings.of(spark)
    assert found.model == "m" and found.most_reports is None
    with pytest.raises(ValueError, match="endpoint"):
        found.client()
    assert callable(Settings("http://x", "m").client()())


def test_command_line(spark, tmp_path, capsys):
    from plinth import cli
    from tests.graphs import TWO_HOPS

    assert cli.main(["info"]) == 0 and "finding_leakage" in capsys.readouterr().out
    (tmp_path / "g.ttl").write_text(TWO_HOPS)
    for command, n in (("match", 19), ("assess", 16)):
        assert cli.main([command, "--graph", str(tmp_path / "g.ttl"), "--out", str(tmp_path / command)]) == 0
        assert spark.read.text(str(tmp_path / command)).count() == n


def test_workers_hold_few_rows_and_only_those_that_are_asked(spark):
    reports = report_rows(spark, 3000).coalesce(1)
    gated = reports.withColumn("is_relevant", F.col("row_id") % 3 == 0).withColumn("relevance_level", F.lit("direct")).withColumn("relevance_reason", F.lit("why")).withColumn("matched_modes", F.array(F.lit("m")))
    gated = gated.withColumn("detected_system_behavior", F.lit("b")).withColumn("error", F.when(F.col("row_id") % 3 == 1, F.lit("down")))
    seen = spark.sparkContext.accumulator(0)

    def make():
        import gc

        def call(prompt, stage, report_id):
            if report_id == "r2997":  # the last row that is asked about
                seen.add(sum(1 for x in gc.get_objects() if isinstance(x, dict) and "meta" in x and "relevance_level" in x))
            return "{}"

        return call

    for filled in (False, True):
        rows = incidents.extract(gated, make, filled=filled).orderBy("row_id").collect()
        assert [r["meta"]["relevance_reason"] for r in rows[:3]] == ["why", "pipeline_error: down", "why"] and len(rows) == 3000
        assert [r["meta"]["is_relevant"] for r in rows[:3]] == [True, False, False] and rows[2]["matched_modes"] == ["m"]
        assert all((r["evidence"] == (([], [], []) if filled else None)) for r in rows[1:3]) and (not filled or rows[1]["risk_assessment"]["confidence"] == "low")
    assert seen.value <= 2 * 2 * incidents.WORKED
