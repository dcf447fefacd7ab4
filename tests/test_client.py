"""The HTTP client against a server of our own; the cache's folders; fences in long answers."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from plinth.operators import incidents
from plinth.sources import reports as io


@pytest.fixture
def server():
    """A server that fails as told, and counts connections and what runs at the same time."""
    seen = {"connections": 0, "calls": 0, "now": 0, "most": 0, "fail": [], "wait": 0.0, "bodies": []}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            super().setup()
            with lock:
                seen["connections"] += 1

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                seen["calls"] += 1
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                seen["bodies"].append((self.path, body))
                status = seen["fail"].pop(0) if seen["fail"] else 200
            time.sleep(seen["wait"])
            with lock:
                seen["now"] -= 1
            if status == 0:
                self.close_connection = True
                return
            raw = json.dumps({"response": f" answer to {body['prompt']} "}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}/", seen
    held.shutdown()


def test_one_connection_serves_all_calls(server):
    at, seen = server
    call = incidents.http_client(at, "m", top_k=3)
    assert [call(f"p{i}", "relevance", "r") for i in range(5)] == [f"answer to p{i}" for i in range(5)]
    assert seen["connections"] == 1 and seen["calls"] == 5
    assert seen["bodies"][0] == ("/api/generate", {"model": "m", "prompt": "p0", "stream": False, "options": {"temperature": 0.0, "top_k": 3}})


def test_busy_servers_and_lost_connections_are_tried_again(server):
    at, seen = server
    call = incidents.http_client(at, "m", tries=4, wait=0.01)
    seen["fail"] = [503, 429, 0]
    assert call("p", "s", "r") == "answer to p" and seen["calls"] == 4
    seen["fail"] = [500] * 9
    with pytest.raises(RuntimeError, match="HTTP 500"):
        call("p", "s", "r")
    assert seen["calls"] == 8
    seen["fail"] = [404]
    with pytest.raises(RuntimeError, match="HTTP 404"):
        call("p", "s", "r")
    assert seen["calls"] == 9


def test_calls_at_once_are_bounded_and_keep_their_places(spark, server):
    at, seen = server
    seen["wait"] = 0.05
    raw = spark.createDataFrame([(i, f"r{i}", f"text {i}") for i in range(24)], "row_id long, report_id string, text string").coalesce(1)
    answers = incidents.ask(incidents.normalised(raw), "relevance", lambda: incidents.http_client(at, "m"), at_once=4).collect()
    assert all(f"text {r['row_id']}" in json.loads(r["value"])["_raw_text"] for r in answers) and len(answers) == 24
    assert 2 <= seen["most"] <= 4 and seen["connections"] <= 4 and seen["calls"] == 24


def test_a_probe_reads_only_the_folders_it_asks_for(spark, tmp_path):
    rows = spark.range(600).select(F.lit("relevance").alias("stage"), F.md5(F.col("id").cast("string")).alias("key"), F.lit("{}").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    io.write_cache(rows, str(tmp_path / "c"))
    io.write_cache(rows.withColumn("ts", F.lit("2024-01-02").cast("timestamp")).withColumn("value", F.lit('{"b": 1}')), str(tmp_path / "c"), "append")
    asked = rows.limit(2).select("key").persist()
    found = io.read_cache(spark, str(tmp_path / "c"), asked)
    prefixes = {r["key"][:2] for r in asked.collect()}
    assert {r["key"][:2] for r in found.collect()} == prefixes
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters")[1].split("]")[0]
    io.compact_cache(spark, str(tmp_path / "c"), str(tmp_path / "d"))
    small = io.read_cache(spark, str(tmp_path / "d"))
    assert small.count() == 600 and small.filter("value = '{}'").count() == 0


def test_reports_without_a_key_are_spread(spark):
    raw = spark.createDataFrame([(i, f"r{i}", "a search engine" if i % 50 == 0 else f"none {i}") for i in range(2000)], "row_id long, report_id string, text string")
    reports = incidents.normalised(raw)
    cache = spark.createDataFrame([("relevance", "k", "{}", None)], "stage string, key string, value string, ts timestamp")
    joined, _ = incidents._with_cached(reports, incidents.has_hint(), "relevance", cache, lambda: incidents._Asker("relevance", lambda: None, False, "", None))
    held = [r["count"] for r in joined.repartition(8, "_pl_meet").groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 8 and max(held) < 2 * 2000 / 8


def test_fences_take_no_longer_than_their_text():
    fast = "```json\n{" * 40_000
    began = time.time()
    with pytest.raises(ValueError):
        incidents.fenced(fast)
    assert incidents.fenced("```\nx\n```json {\"a\": 1}\n``` and ```") == '{"a": 1}'
    assert incidents.fenced("``` {\"a\": \"```\"} ```") == '{"a": "```"}' and incidents.fenced("```{}```") == "{}"
    assert time.time() - began < 5


@pytest.mark.parametrize("text", ["```{}{{} ", "json\n```{json{\n}x", "x```{\n}}{}x", "````xx `json```{```{}\n"])
def test_an_object_that_no_fence_ends_is_none(text):
    with pytest.raises(ValueError, match="fenced"):
        incidents.fenced(text)


def test_progress_is_logged_while_a_stage_runs(spark, server, caplog):
    from plinth.functions.progress import Progress

    at, seen = server
    seen["wait"] = 0.1
    raw = spark.createDataFrame([(i, f"r{i}", f"text {i}") for i in range(40)], "row_id long, report_id string, text string").repartition(8)

    def client():
        inner = incidents.http_client(at, "m")

        def call(prompt, stage, report_id):
            if report_id == "r7":
                raise RuntimeError("no")
            return inner(prompt, stage, report_id)

        return call

    with caplog.at_level("INFO", logger="plinth.functions.progress"), Progress(spark, "answers", 40, every=0.2) as progress:
        incidents.ask(incidents.normalised(raw), "relevance", client, counters=progress.counters).write.format("noop").mode("overwrite").save()
    lines = [r.getMessage() for r in caplog.records]
    assert lines[-1].startswith("[40/40] answers, 1 failed") and len(lines) >= 2
