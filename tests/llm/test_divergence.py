"""Source divergence against a brute-force version in plain integers."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs, cells, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for text, lang, source in ((t or "", lg or "", s or "") for t, lg, s in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        cells[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (lg, t), n in docs.items() if lg == lang and n >= min_docs), key=str.encode)
        of = {s: [cells[lang, s][t] for t in kept] for lg, s in groups if lg == lang}
        share = lambda counts: [1 + 10**9 * (c + 1) // (sum(counts) + len(kept)) for c in counts]
        p, q = {s: share(c) for s, c in of.items()}, share([sum(c) for c in zip(*of.values(), strict=True)])
        for s in of:
            pairs = [(x, sum((a - b) * (a - b) // b for a, b in zip(p[s], p[x], strict=True))) for x in of if x != s]
            terms = [(t, (a - b) * (a - b) // b) for t, a, b, n in zip(kept, p[s], q, of[s], strict=True) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(n, sources, rng):
    words = ["Der", "der", "été", "Élan", "x", "it's", "naïve-ness", "漢字", "a1b", "😀", *(f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz")]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(30)))
    return [(text(), rng.choice(["de", "de", "de", "en", None]), rng.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize(("terms", "sources"), [(4096, 64), (5, 2), (3, 1)])
def test_against_brute_force(spark, terms, sources):
    rng = random.Random(terms)
    rows = rows_of(300, ["s1", "s2", "s3", "s4", "s5", None, ""], rng)
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("seldom words", "fr", "other"), (None, None, None)] + [("again again", "de", "copy")] * 5
    schema = "text string, lang string, source string, n int, term string, rank int"
    docs = spark.createDataFrame([(*r, 1, "clash", 7) for r in rows], schema).repartition(3)
    found = sd.source_divergence(docs, terms_per_tile=terms, sources_per_tile=sources)
    assert [f.dataType.simpleString() for f in found.schema] == ["string"] * 4 + ["bigint", "int"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_heaps_are_merged_over_tiles(spark):
    rows = rows_of(200, ["s1", "s2", "s3"], random.Random(5))
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = sd.source_divergence(docs, top_terms=4, terms_per_tile=6, min_docs=1)
    assert sorted(map(tuple, found.collect())) == brute(rows, 1, 4)


def test_empty_table(spark):
    assert sd.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_very_long_texts_are_split_at_separators(monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 7)
    text = "Some lengthyWORD " * 50 + "ÀÉ漢" * 40 + " end"
    parts = list(sd.term_slices(text.encode()))
    assert len(parts) > 20 and [t.decode() for p in parts for t in p] == TERM.findall(text.translate(LOWER))


def test_counts_are_given_off_early(spark, monkeypatch):
    batches = pa.RecordBatch.from_arrays([["a", "a"], ["s", "s"], pa.array([b"x y z", b"x w"])], ["lang", "source", "text"])
    monkeypatch.setattr(sd, "MOST_HELD", 2)
    total = collections.Counter()
    for out in sd._count(iter([batches])):
        for r in out.to_pylist():
            total[r["term"]] += r["n"]
    assert total == {None: 0, b"x": 2, b"y": 1, b"z": 1, b"w": 1}


def test_shares_are_exact():
    rng = random.Random(1)
    wholes = [rng.randrange(1, 9 * 10**15) for _ in range(200)] + [1, 9 * 10**15 - 1]
    counts = [rng.randrange(0, w) for w in wholes]
    assert sd.shares(np.array(counts), np.array(wholes)).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(counts, wholes, strict=True)]
