"""Long lines, other scripts, ties, vocabularies: cases beside the brute-force tests."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plinth.llm import common, exact_dedup, line_dedup, mixing, packing, quality_rules, substring_dedup
from plinth.llm.queries import tokenizer_path


def test_a_line_of_inner_spaces_takes_no_longer(spark):
    line = "a b c" + " " * 1_000_000 + "d"
    rows = [(i, f"{line}\nown {i}", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    line_dedup.drop_spread_lines(df.withColumn("text", F.lit("a b c")), min_sites=3).collect()
    began = time.time()
    out = line_dedup.drop_spread_lines(df, min_sites=3).collect()
    assert time.time() - began < 25 and sorted(r["text"] for r in out) == ["own 0", "own 1", "own 2"]


@pytest.mark.parametrize("line", ["यह एक पूरा वाक्य है और इसमें कई शब्द हैं।", "هذه جملة كاملة وفيها كلمات كثيرة جدا أليس كذلك؟", "یہ ایک مکمل جملہ ہے اور اس میں کئی الفاظ ہیں۔", "这 是 一个 完整 的 句子 里面 有 很多 词。", "Սա ամբողջական նախադասություն է որն ունի շատ բառեր այստեղ։"])
def test_sentences_of_other_scripts_are_complete(spark, line):
    df = spark.createDataFrame([(line,), (line[:-1],)], "x string")
    assert [r[0] for r in df.select(quality_rules.line_fails(F.col("x"))).collect()] == [False, True]


def test_phrases_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "Alle Rechte vorbehalten.\nDas ist ein ganz normaler Satz.")], "doc_id long, text string")
    clean = lambda **options: quality_rules.clean_lines(df, least_words=1, **options).collect()[0]["cleaned_text"]
    assert clean().startswith("Alle") and clean(phrases=("alle rechte vorbehalten",)) == "Das ist ein ganz normaler Satz."
    assert clean(phrases=()) == clean()


def test_mixing_breaks_ties_by_text(spark):
    rows = [(None, f"word{i} same size", "s") for i in range(60)] + [(5, f"other{i} same size", "s") for i in range(60)] + [(i, "x y z", "t") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shown = lambda df: sorted(map(str, mixing.mixed_documents(df, weights=(1, 9), shards=3).collect()))
    first = shown(docs.repartition(2))
    assert first == shown(docs.repartition(9, "text")) and len(first) < 900


def test_ranges_are_even_in_bytes(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abc", k=rng.choice([5, 50, 3000])))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size = (F.octet_length("text") + 64).cast("long")
    key = exact_dedup._key(F.col("text"), F.col("doc_id"), 48)
    splitters = exact_dedup.sample_splitters(docs.select(key.alias("key"), size.alias("size")).select("key.*", "size"), 20, 64, 7)
    at = exact_dedup._place(key, splitters)["pid"]
    held = [r["b"] for r in docs.groupBy(at.alias("p")).agg(F.sum(size).alias("b")).collect()]
    assert len(held) == 20 and max(held) <= 2 * sum(held) / len(held)
    plan = exact_dedup.exact_groups(docs, n_ranges=20)._jdf.queryExecution().executedPlan().toString()
    assert "shuffle_partition_id" in plan.lower() or "shufflepartitionid" in plan.lower() or "repartition" in plan.lower()


def test_encoder_equals_the_tokenizer_on_all_characters():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    rng = random.Random(7)
    texts += ["".join(rng.choices("aB 1'\t\n.é漢😀‍́  st", k=40)) for _ in range(3000)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert list(fast(text)) == want.ids


@pytest.mark.parametrize("space", [" " * 1_000_000, "\n" * 2_000_000, " \n\t" * 700_000, " " * 99_999])
def test_very_long_white_space_has_the_ids_of_the_tokenizer(space):
    from tokenizers import Tokenizer

    text = f"some words{space}and more"
    assert list(packing.encoder(tokenizer_path())(text)) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_packing_takes_a_million_line_ends(spark):
    docs = spark.createDataFrame([(1, "a" + "\n" * 1_200_000 + "b"), (2, "short"), (3, " " * 1_000_001)], "doc_id long, text string")
    pieces = packing.pack_documents(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(pieces) == 3 and all(r["n"] == r["of"] for r in pieces)


def test_shared_results_need_a_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "yarn", "getConf": staticmethod(lambda: Session.conf), "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_repeated_rows_of_one_file_are_dealt_apart(spark, tmp_path):
    """A third of all rows may be one row: no part holds more of them than its share."""
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(7, text)] * 4000 + [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for i in range(10, 2010)] + [(9, text)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    parts = docs.groupBy(F.pmod(F.xxhash64("doc_id", "text", *substring_dedup._split(docs)), F.lit(16)).alias("p")).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 1.3 * len(rows) / 16
    out = substring_dedup.dedup_substrings(docs, part_bytes=1 << 14, most_part_bytes=1 << 16)
    kept = {(r["doc_id"], r["n_removed"]): r["n"] for r in out.filter("doc_id < 10").groupBy("doc_id", "n_removed").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {(7, 0): 4000, (9, 60): 1}
