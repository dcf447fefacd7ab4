"""Registered queries against their SQL oracles, and what is known of the graph view."""

import glob
import os
from urllib.parse import quote

import duckdb
import pytest

from plinth import registry


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shaped(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_against_oracle(spark, sf, duck, name):
    mine, other = shaped(registry.QUERIES[name](spark, sf).toPandas()), shaped(duck.sql(registry.ORACLES[name]).df())
    assert mine.equals(other)


def test_known_counts(spark, sf):
    count = lambda q, *cols: registry.QUERIES[q](spark, sf).select(*cols).distinct().count()
    assert count("motif_vector_ir_solutions", "step") == 20 and count("motif_llm_ir_solutions", "step") == 14
    assert count("finding_leakage", "step") == 3 and count("finding_confabulation", "step") == 4


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_iri_encoding_covers_whole_texts(spark, tmp_path):
    texts = ["a" * 200 + " é~*+/ " + "b" * 300 + "漢 😀%", "x y" * 1000 + "\n&", "", None]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["encoded"] for r in registry.QUERIES["iri_encoding"](spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else quote(f"web *~+/en:{t}", safe="") for i, t in enumerate(texts)}


def test_inform_reachability_reaches_the_end_of_a_chain(spark, tmp_path):
    lengths = {1: 1, 2: 4, 3: 9, 4: 70}
    rows = [(100 * user + i, user, i // 2) for user, n in lengths.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long").write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in registry.QUERIES["inform_reachability"](spark, str(tmp_path)).select("sub", "super", "hops").collect()]
    assert sorted(found) == sorted((100 * user + i, 100 * user + j, j - i) for user, n in lengths.items() for j in range(n) for i in range(j))


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_inform_reachability_moves_events_and_not_pairs(spark, tmp_path):
    rows = [(100 * user + i, user, i) for user in range(40) for i in range(80)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long").write.parquet(f"{tmp_path}/events.parquet")
    before = shuffled_rows(spark)
    found = registry.QUERIES["inform_reachability"](spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40 * 80 * 79 // 2
    assert shuffled_rows(spark) - before < 6 * len(rows)
