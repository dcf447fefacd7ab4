"""Operators built of column expressions: PII, mixing, line spread, line-first rules, content sort."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plinth.llm import exact_dedup, line_dedup, mixing, pii, quality_rules
from plinth.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_content_sort_against_brute_force(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    groups = collections.defaultdict(list)
    for r in docs:
        groups[r["text"]].append(r["doc_id"])
    rows = {r["doc_id"]: r for r in QUERIES["op10_content_sort"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        own, got = groups[r["text"]], rows[r["doc_id"]]
        assert (got["keep_id"], got["group_size"], got["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert got["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_content_sort_cuts_hot_groups(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 50}") for i in range(600)] + [(None, "same text"), (None, None), (7, "rep"), (7, "rep"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep, best in (("largest", max), ("smallest", min)):
        out = exact_dedup.exact_groups(docs, keep=keep, n_ranges=16).collect()
        assert len(out) == len(rows)
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
        for r in out:
            ids = groups[r["text_sha256"]]
            known = [i for i in ids if i is not None]
            assert r["group_size"] == len(ids) and r["keep_id"] == (best(known) if known else None)
        kept = collections.Counter(r["text_sha256"] for r in out if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(groups)
    placed = exact_dedup.sample_splitters(docs.select(exact_dedup._key(F.col("text"), F.col("doc_id"), 48).alias("k")).filter("k.k is not null").select("k.*"), 16, 64, 7)
    assert len([s for s in placed if s[0] == "same text"]) >= 3  # the hot text is spread over several ranges


def test_content_sort_keeps_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "doc_id long, text string, keep_id string, `_pl_text` int")
    assert [tuple(r) for r in exact_dedup.exact_dedup(df).collect()] == [(1, "a", "x", 5)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(df, keep="first")


def wanted(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    heft = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left, all_heft = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(heft[s] for s in names if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else left * heft[s] / all_heft for s in names}
        more = {s for s in names if out[s] > 3 * sizes[s] + 1e-9} - full
        if not more:
            return out
        full |= more


@pytest.mark.parametrize("shards", [None, 3])
def test_mixing(spark, shards):
    rows = [(i, " ".join(["w"] * (i % 90 + 1)), "big") for i in range(400)] + [(1000 + i, "a b c d", "small") for i in range(5)] + [(2000, None, None), (2001, " \t", None), (2002, "q " * 300, None), (2002, "q " * 300, None), (None, "z", "other")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    out = mixing.mix_sources(docs, shards=shards).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal = wanted(dict(sizes))
    assert len(out) == len(rows) and sum(goal.values()) == pytest.approx(sum(sizes.values()))
    taken = collections.Counter()
    for r in out:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 16 * (shards or 1)
    again = mixing.mix_sources(docs.repartition(7), shards=shards).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixing_over_documents(spark, sf):
    rows = QUERIES["op2_source_mixing"](spark, sf).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal, taken = wanted(dict(sizes)), collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 16 for s in goal)


def test_mixed_documents_repeat_and_cut(spark):
    docs = spark.createDataFrame([(1, "a b  c", "s1", 9), (2, "d e f g h i j k l m n o p q r s t u v w x y z", "s2", 8)], DOCS + ", taken int")
    docs = docs.withColumnRenamed("taken", "extra")
    out = mixing.mixed_documents(docs, block_tokens=1)
    assert out.columns == docs.columns
    words = collections.Counter(r["doc_id"] for r in out.collect() for _ in r["text"].split())
    planned = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, block_tokens=1).collect()}
    assert dict(words) == {k: v for k, v in planned.items() if v}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def seats(claims, n):
    given = [0] * len(claims)
    for _ in range(n):
        i = max(range(len(claims)), key=lambda k: (claims[k] / (2 * given[k] + 1), -k))
        given[i] += 1
    return given


@pytest.mark.parametrize("claims,n", [([53.0, 24.0, 23.0], 7), ([1.0, 1.0, 1.0], 2), ([1000.0, 1.0, 1.0, 1.0, 1.0], 10), ([0.0, 5.0], 3), ([0.3, 0.0], 5), ([7.0], 4), ([90.0, 6.0, 4.0], 0)])
def test_apportionment_by_highest_quotients(spark, claims, n):
    df = spark.createDataFrame([(0, i, c, n) for i, c in enumerate(claims)], "g int, i int, claim double, seats long")
    got = [r["got"] for r in mixing.apportion(df, ["g"], ["i"], "claim", "seats", "got").orderBy("i").collect()]
    assert got == seats(claims, n)


def test_line_spread_exactly(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "source").collect()
    sites = collections.defaultdict(set)
    for r in docs:
        for line in r["text"].split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add(r["source"])
    for least in (2, 4):
        gone = {x for x, s in sites.items() if len(s) >= least and len(WORD.findall(x)) >= 3}
        out = {r["doc_id"]: r for r in line_dedup.drop_spread_lines(documents(spark, sf), min_sites=least).collect()}
        for r in docs:
            lines = r["text"].split("\n")
            kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in gone]
            assert out[r["doc_id"]]["text"] == "\n".join(kept) and out[r["doc_id"]]["n_removed"] == len(lines) - len(kept)


def test_line_spread_estimates_far_from_the_threshold(spark):
    lines = spark.range(3000).select(F.when(F.col("id") < 2000, "many").otherwise("few").alias("h"), (F.col("id") % 700).cast("string").alias("site"))
    few = lines.filter("h = 'few'").withColumn("site", (F.col("site") % 5).cast("string"))
    found = line_dedup.spread_lines(lines.filter("h = 'many'").unionByName(few), min_sites=100)
    assert [r["h"] for r in found.collect()] == ["many"]


def test_line_spread_cases(spark):
    rows = [(1, "a b c\nown one", "x"), (2, "  a b c \nown two\na b c", "y"), (2, "  a b c \nown two\na b c", "y"), (3, None, None), (4, "", "z"), (5, "a b c", None), (None, "a b c\nq", "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)).withColumn("doc", F.lit("clash"))
    out = line_dedup.drop_spread_lines(df, min_sites=3)
    assert out.columns == [*df.columns, "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "own one", 1), (2, "own two", 2), (2, "own two", 2), (3, None, 0), (4, "", 0), (5, "", 1), (None, "q", 1)], key=str)
    assert line_dedup.drop_spread_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_spread_lines(df.withColumn("n_removed", F.lit(1)))


def base_counts(text):
    words = WORD.findall(text)
    seen, covered = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in QUERIES["op6_line_first_rules"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        n, *rest = base_counts(r["text"] or "")
        got = rows[r["doc_id"]]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (n, *rest)
        assert got["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n) and not (got["base_failed"] and got["kept"])


def test_labelled_quality_is_respected(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op6_line_first_rules"](spark, sf).join(labels, "doc_id").filter("not base_failed")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("kept").count() >= 0.99 * good.count() and bad.filter("kept").count() <= 0.05 * bad.count()


CLEAN = "The first sentence has some words in it.\nAnother line says something else about nothing much."


@pytest.mark.parametrize("line,fails", [
    ("Home | About | Contact | Login", True), ("All rights reserved.", True), ("WOW!! BUY!! NOW!! TODAY!! HERE!!", True), ("a### b$$$ c*** d&&&", True),
    ("this line has many words but never comes to an end here", True), ("Short heading", False), ("He said: this is fine, really.", False), ("", False), ("a | b says one bar in a longer line of prose.", False),
])
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(quality_rules.line_fails(F.col("x"))).collect()[0][0] is fails


def test_rule_cases(spark):
    rows = [(1, None), (2, ""), (3, CLEAN), (3, CLEAN), (None, "\n".join([CLEAN, "Home | About | Contact | Login"])), (5, "a b c d e f g h " * 2000), (6, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    out = quality_rules.clean_lines(df, least_words=5).collect()
    assert [r["kept"] for r in out] == [False, False, True, True, True, False, False]
    assert out[4]["cleaned_text"] == CLEAN and out[5]["n_repeat_words"] == 16000 and out[0]["n_words"] == 0
    assert quality_rules.clean_lines(df.limit(0)).count() == 0


def test_permutation_is_a_bijection(spark):
    for domain in (1, 2, 97, 1000):
        got = [r[0] for r in spark.range(domain).select(pii.permuted(F.col("id"), domain, "k", "t")).collect()]
        assert sorted(got) == list(range(domain))
    a, b = (spark.range(50).select(pii.permuted(F.col("id"), 10**15, key, "t")).collect() for key in "ab")
    assert a != b


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


PII_ROWS = [
    (1, "call +1 (434) 555-2368 or +14345552368, mail some.one@mail3.example.com."), (2, "4111 1111 1111 1111, 4111-1111-1111-1111 but 4111111111111112"),
    (3, "67.190.110.215 and 300.1.1.1"), (4, "123-45-6789 666-45-6789"), (5, "2024-02-29 29.02.2024 2/29/2024 2023-02-29"), (6, "DE89 3704 0044 0532 0130 00 DE88370400440532013000"),
    (7, None), (8, ""), (8, ""), (9, "plain text, v2.0 of 12 May"), (None, "again 4111111111111111"), (10, "x " * 50000 + "434-555-2368"),
]


def test_phones_in_pairs_of_digits(spark):
    same, other = ["+33 6 12 34 56 78", "+33-6-12-34-56-78", "+33612345678"], ["+34 612 34 56 78", "+49 30 12 34 56 78"]
    kept = ["+33 6 12 34", "x+33 6 12 34 56 78", "+999 999 12 34 56 78 90"]
    df = spark.createDataFrame([(i, f"call {t}.") for i, t in enumerate(same + other + kept)], "doc_id long, text string")
    out = [r["text"][5:-1] for r in pii.pseudonymise(df, key="k").orderBy("doc_id").collect()]
    assert out[5:] == kept
    for text, new in zip(same + other, out, strict=False):
        assert new != text and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text)
    assert len({re.sub("[^0-9]", "", new) for new in out[:3]}) == 1


def test_pseudonyms(spark):
    df = spark.createDataFrame(PII_ROWS, "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df, key="k").collect()]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10}), mail ([a-z]+)\.([a-z]+)@", out[0])
    assert phone and phone[1] + phone[2] + phone[3] == phone[4] != "4345552368" and phone[1][0] > "1" and "some.one" not in out[0]
    assert out[-1].endswith(f" {phone[1]}-{phone[2]}-{phone[3]}")
    cards = re.fullmatch(r"((?:\d{4} ){3}\d{4}), ((?:\d{4}-){3}\d{4}) but 4111111111111112", out[1])
    plain = cards[1].replace(" ", "")
    assert luhn(plain) and plain == cards[2].replace("-", "") and out[10] == f"again {plain}" and plain != "4111111111111111"
    assert "67.190.110.215" not in out[2] and "300.1.1.1" in out[2] and all(int(o) < 256 for o in out[2].split()[0].split("."))
    assert out[3].endswith(" 666-45-6789") and "123-45-6789" not in out[3]
    y, m, d = re.match(r"(\d{4})-(\d{2})-(\d{2}) ", out[4]).groups()
    assert out[4] == f"{y}-{m}-{d} {d}.{m}.{y} {int(m)}/{int(d)}/{y} 2023-02-29"
    iban = out[5][:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "DE88370400440532013000" in out[5]
    assert out[6] is None and out[7] == out[8] == "" and out[9] == PII_ROWS[9][1]
    assert pii.pseudonymise(df, key="other").collect()[0]["text"] != out[0]
    assert pii.pseudonymise(df.limit(0), key="k").count() == 0


def test_pseudonyms_leave_no_address(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    out = {r["doc_id"]: r for r in QUERIES["op1_pii_feistel"](spark, sf).collect()}
    shapes = [r"[\w.]+@[\w.]+\w", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"]
    hit = 0
    for i, text in docs.items():
        for shape in shapes:
            for found in re.findall(shape, text):
                hit += 1
                assert found not in out[i]["text"]
        if not re.search("[0-9@]", text):
            assert out[i]["text"] == text and out[i]["n_pii"] == 0
    assert hit > 0


def test_settled_tables_can_be_dropped(spark):
    from plinth.llm import common

    df = common.settle(spark.range(3), "test")
    assert df.count() == 3 and common.SETTLED
    common.drop_settled(spark)
    assert not common.SETTLED
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.groupBy().count().collect()
