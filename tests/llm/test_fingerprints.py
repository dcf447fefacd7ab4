"""Fingerprints against sets of paragraphs compared directly."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plinth.llm import fingerprints as fp
from plinth.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def paragraphs(text):
    found = re.findall(fp.PARAGRAPH, text)
    assert "".join(found) == text
    return set(found)


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    """(n_chars, edited sha, near edited, near next) of texts in their order."""
    out = []
    for i, text in enumerate(texts):
        after, tail = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, after)))
    return out


def test_query_against_brute_force(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op13_lookup_fingerprints"](spark, sf)
    assert found.columns == COLUMNS and [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "string", "string", "string", "double", "double"]
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
    for r, (n, sha, edited, after) in zip(rows, expected([t for _, t in docs]), strict=True):
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha) and abs(r["near_edited"] - edited) < 1e-12 and abs(r["near_next"] - after) < 1e-12
    shown = {}
    for (_, text), r in zip(docs, rows, strict=True):
        assert shown.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(shown.values())) > 0.9 * len(shown)
    long_ones = [r for r in rows if r["n_chars"] > 1000]
    assert sum(r["near_edited"] > 0.4 for r in long_ones) > 0.9 * len(long_ones)


def test_order_over_ranges_and_cases(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(["Ein Satz. ", "漢字 ja\n", "x" * 300, "\n\n\n", "Wort ", "😀! "]) for _ in range(rng.randrange(40)))
    by_id = {i * 7: text() for i in range(60)} | {1000: None, 1001: "", -5: "minus. " * 400, 2000: "a\n" * 5000}
    rows = [(i, t, "clash", 1) for i, t in by_id.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kind int").repartition(4)
    want = dict(zip(sorted(by_id), expected([by_id[i] or "" for i in sorted(by_id)]), strict=True))
    found = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fp.fingerprint_edits(docs, n_ranges=7).collect()}
    assert found.keys() == want.keys()
    assert all(found[i][:2] == want[i][:2] and all(abs(x - y) < 1e-12 for x, y in zip(found[i][2:], want[i][2:], strict=True)) for i in want)


def test_null_and_repeated_ids(spark):
    rows = [(None, "first. text\nhere"), (3, "same text. again"), (3, "same text. again"), (3, "same text. again"), (9, "last\none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["near_next"], r["n_chars"]) for r in fp.fingerprint_edits(docs, n_ranges=3).collect())
    assert [r[0] for r in found] == [-1, 3, 3, 3, 9] and sorted(r[1] for r in found) == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_one_row_and_none(spark):
    schema = "doc_id long, text string"
    one = fp.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(("shared_bits", "sent"), [(0, 0), (30, 1 << 18)])
def test_differences_come_out_whole(spark, monkeypatch, shared_bits, sent):
    """Digests that agree in their first bits fail at many sizes before they come out."""
    rng = random.Random(shared_bits)
    draw = lambda n: [(rng.getrandbits(64 - shared_bits) | (5 << (64 - shared_bits) if shared_bits else 0)) - (1 << 63) for _ in range(n)]
    rows = []
    for row in range(12):
        both = draw(rng.randrange(200))
        rows.append((row, both + draw(rng.choice([0, 1, 5, 300])), both + draw(rng.choice([0, 2, 40])), both[:3]))
    rows += [(50, [], [], []), (51, [1 << 20], [], [1 << 20]), (52, [], [1 << 20, 2 << 20], [3 << 20])]
    digest = lambda c: F.array_distinct(F.transform(c, fp.checked)).alias(c)
    table = spark.createDataFrame(rows, "row long, a array<long>, b array<long>, c array<long>").select("row", *map(digest, "abc")).persist()
    want = {(r["row"], k): (sorted(set(r["a"]) - set(r[o])), sorted(set(r[o]) - set(r["a"]))) for r in table.collect() for k, o in enumerate("bc")}
    monkeypatch.setattr(fp, "MOST_SENT", sent)
    found = fp.differences(table, "a", ("b", "c"), with_digests=True).collect()
    assert {(r["row"], r["kind"]): (sorted(r["left"]), sorted(r["right"])) for r in found} == want
    assert all((r["n_left"], r["n_right"]) == (len(r["left"]), len(r["right"])) for r in found)
    table.unpersist()


def test_fingerprints_alone_show_small_differences(spark):
    """Two fingerprints give back the digests that differ, and say so where there are too many."""
    lines = [f"Line number {i} of a longer text." for i in range(400)]
    texts = ["\n".join(lines), "\n".join([*lines[:200], "Another one.", *lines[201:]]), "\n".join(lines[:100])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", F.posexplode(fp.digests(F.col("text"))).alias("i", "d"), F.lit(1).cast("long").alias("sign"))
    shown = {r["id"]: r["t"] for r in fp.tables(df, ["id"], 0).select("id", fp.shown(fp.table()).alias("t")).collect()}
    sets = {i: {r["d"] for r in df.filter(F.col("id") == i).collect()} for i in range(3)}
    pairs = spark.createDataFrame([(shown[0], shown[1]), (shown[0], shown[0]), (shown[0], shown[2])], "a string, b string")
    one, none, many = [r["p"] for r in pairs.select(fp.compared(F.col("a"), F.col("b")).alias("p")).collect()]
    assert one["ok"] and set(one["left"]) == sets[0] - sets[1] and set(one["right"]) == sets[1] - sets[0]
    assert none["ok"] and not none["left"] and not none["right"] and not many["ok"]


def test_no_exchange_between_digests_and_tables(spark, tmp_path):
    """A pair's digests are dealt once, by row; its tables, and what comes out of them, are made where they are."""
    entries = spark.range(100).selectExpr("id % 7 as row", "id as d", "1L as sign").repartition(4, "row")
    summed = fp.tables(entries.withColumn("first", F.col("d") % 2), ["row", "first"], 0).groupBy("row").agg(F.sum("n0"))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
