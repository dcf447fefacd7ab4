"""The pipeline's stages, one after the other and each on its own input, and runs of every registered query."""

import collections
import importlib

import numpy as np
import pytest

from plinth.llm.queries import QUERIES, documents
from tests.llm.test_native import WORD, wanted
from tests.llm.test_python import joined_by_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    pipeline, docs, out = importlib.import_module("corpus_pipeline"), documents(spark, sf), {}
    out["input"] = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(steps):
    assert list(steps)[1:] == ["quality classifier", "line dedup", "n-gram Jaccard join", "source mixing", "packing"]
    assert all(df.columns == COLUMNS for df in list(steps.values())[:-1])


def test_quality_stage(spark, sf, steps):
    scored = {r["doc_id"] for r in QUERIES["op7_subword_quality"](spark, sf).filter("predicted = 1").collect()}
    assert set(rows_of(steps["quality classifier"])) == scored
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & scored) >= 0.98 * len(good & set(rows_of(steps["input"])))


def test_line_stage(steps):
    before, after = rows_of(steps["quality classifier"]), rows_of(steps["line dedup"])
    sites = collections.defaultdict(set)
    for r in before.values():
        for line in r["text"].split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add(r["source"])
    assert set(before) == set(after)
    for i, r in before.items():
        kept = [x for x in r["text"].split("\n") if len(sites[x.strip(" \t\n\x0b\x0c\r")]) < 10 or len(WORD.findall(x)) < 3]
        assert after[i]["text"] == "\n".join(kept) and after[i]["n_chars"] == len(after[i]["text"])


def test_near_duplicate_stage(steps):
    before = rows_of(steps["line dedup"])
    stay = {doc for doc, _, component in joined_by_force([(i, r["text"]) for i, r in before.items()]) if doc == component}
    after = rows_of(steps["n-gram Jaccard join"])
    assert set(after) == stay and all(after[i] == before[i] for i in stay)


def test_mixing_stage(steps):
    before = rows_of(steps["n-gram Jaccard join"])
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before.values():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    times = collections.Counter()
    for r in steps["source mixing"].collect():
        words = WORD.findall(r["text"])
        assert words == WORD.findall(before[r["doc_id"]]["text"])[: len(words)]
        taken[r["source"]] += len(words)
        times[r["doc_id"]] += len(words)
    goal = wanted(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 16 for s in goal)
    assert all(n <= 3 * len(WORD.findall(before[i]["text"])) for i, n in times.items())


def test_packing_stage(steps):
    docs, pieces = steps["source mixing"].collect(), steps["packing"].collect()
    want = collections.Counter(r["doc_id"] for r in docs)
    ends = collections.Counter(p["doc_id"] for p in pieces if p["start"] + p["length"] == p["doc_tokens"])
    assert ends == want and sum(p["length"] for p in pieces if p["start"] == 0) > 0
    assert all(np.frombuffer(p["ids"], "<u4")[-1] == 1 for p in pieces if p["start"] + p["length"] == p["doc_tokens"])


def test_run_is_the_stages(spark, sf, steps):
    import __spark_entry__ as entry

    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, sf).select(*cols).collect())) == sorted(map(tuple, steps["packing"].select(*cols).collect()))


def test_stages_take_an_empty_table(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = documents(spark, sf).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_nulls_and_repeats(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(1, "Some words in a row here. And more of them.", "en", "a", 1), (1, "Some words in a row here. And more of them.", "en", "a", 1), (None, None, None, None, None), (3, "", None, "a", 0), (None, "x y z", "en", None, 5)]
    docs = spark.createDataFrame(rows, documents(spark, sf).schema)
    quality, lines, near, mixed, packed = (stage(spark, docs, sf).collect() for _, stage in pipeline.STAGES)
    given = {tuple(r) for r in rows}
    assert {tuple(r) for r in quality} <= given
    # n_chars follows the text from the line stage on.
    sized = sorted([(i, t, None if t is None else len(t)) for i, t, *_ in rows], key=str)
    assert sorted([(r["doc_id"], r["text"], r["n_chars"]) for r in lines], key=str) == sized
    assert sorted([r["doc_id"] for r in near], key=str) == [1, 3, None, None]
    assert mixed and all(r["text"] and set(r["text"].split()) <= {w for x in rows for w in (x[1] or "").split()} for r in mixed)
    assert sum(r["start"] == 0 for r in packed) == len(rows) and sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


@pytest.mark.parametrize("name", QUERIES)
def test_every_query_runs_without_a_limit(spark, sf, name):
    got, docs = QUERIES[name](spark, sf), documents(spark, sf)
    # What the rows are about: sources, vectors, or documents, all of them.
    keys, whole = {"op11_source_divergence": (["lang", "source"], docs), "op12_embedding_whitening": (["vec_id"], spark.read.parquet(f"{sf}/embeddings.parquet"))}.get(name, (["doc_id"], docs))
    assert got.select(*keys).distinct().count() == whole.select(*keys).distinct().count()
