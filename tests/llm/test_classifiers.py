"""The scores of both classifiers against plain forward passes, and features against their definition."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import language_id, quality_classifier
from plinth.llm import wordhash as wh

TEXTS = ["Some good words, and more good words!", "x", "", None, " \t\n", "été à Öl 漢字かな 😀 😀 fin", "no no no no no", "a\tb\nc  d", "word " * 3000]


def bags_of(texts, parts, labels=None):
    batch = pa.RecordBatch.from_arrays([pa.array(labels or ["0"] * len(texts)), pa.array(texts, pa.string())], ["label", "text"])
    return wh.Bags(pa.Table.from_batches(list(wh.bagged(parts)([batch]))))


def plain_features(text):
    """Names of the features, by part: words, pairs, and n-grams of 3 and 5 without white space but at their ends."""
    text = re.sub("[\t-\r]", " ", text or "")
    words = text.split(" ")
    words = [w for w in words if w]
    parts = [words, ["again" if a == b else (a, b) for a, b in zip(words, words[1:])]]
    return parts + [[g for i in range(len(text) - n + 1) if " " not in (g := text[i : i + n])[1:-1]] for n in (3, 5)]


def test_quality_features_are_what_they_say():
    shape = quality_classifier.Shape(bits=30)
    for text in TEXTS:
        parts, data = plain_features(text), np.frombuffer((text or "").encode(), np.uint8)
        found = quality_classifier._features(data, np.array([0, len(data)]), shape)
        for names, (buckets, begins, ends) in zip(parts, found, strict=True):
            own = buckets[begins[0] : max(ends[0], begins[0])].tolist()
            assert len(own) == len(names) and len(set(zip(own, map(str, names)))) == len(set(own)) == len(set(names))


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_quality_score_is_the_softmax_of_the_average(monkeypatch, chunk):
    monkeypatch.setattr(wh, "CHUNK_BYTES", chunk)
    shape = quality_classifier.Shape(bits=12, width=4)
    parts = lambda data, offs: quality_classifier._features(data, offs, shape)
    model = quality_classifier.train(bags_of(TEXTS[:2] * 10, parts), np.array([1, 0] * 10), shape)
    got = quality_classifier.score(pa.array(TEXTS, pa.string()), *model.folded(), shape)
    for text, score in zip(TEXTS, got):
        data = np.frombuffer((text or "").encode(), np.uint8)
        buckets = [b for found, begins, ends in parts(data, np.array([0, len(data)])) for b in found[begins[0] : max(ends[0], begins[0])]]
        hidden = np.mean([model.vectors[b] for b in buckets], axis=0) if buckets else np.zeros(4)
        logits = model.layer @ hidden + model.bias
        assert score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-5)


def test_bags_hold_the_features():
    parts = lambda data, offs: quality_classifier._features(data, offs, quality_classifier.Shape(bits=12))
    bags = bags_of(TEXTS, parts)
    for text, (own, share) in zip(TEXTS, (bags[i] for i in range(len(bags)))):
        data = np.frombuffer((text or "").encode(), np.uint8)
        count = collections.Counter(b for found, begins, ends in parts(data, np.array([0, len(data)])) for b in found[begins[0] : max(ends[0], begins[0])].tolist())
        assert own.tolist() == sorted(count) and share.tolist() == pytest.approx([count[b] / max(1, sum(count.values())) for b in sorted(count)], rel=1e-3)


LANGS = {"en": "the house and the garden", "de": "das haus und der garten", "nl": "het huis en de tuin", "fr": "la maison et le jardin", "xx": "zzq qqz zqz"}


def test_language_margins_and_choice():
    labels = [lang for lang in LANGS for _ in range(12)]
    model = language_id.Hierarchy(list(LANGS)).fit(bags_of([LANGS[x] for x in labels], language_id._parts, labels), labels)
    assert model.machines == [(None, "germanic", None), (None, "romance", None), (None, "xx", None), ("germanic", "de", "en"), ("germanic", "de", "nl"), ("germanic", "en", "nl")]
    texts = [*LANGS.values(), "haus the", "Été 漢字", "la casa " * 500]
    margins, (chosen, scores) = model.margins(pa.array(texts)), model.predict(pa.array(texts))
    for text, own, lang, score in zip(texts, margins, chosen, scores):
        data = np.frombuffer(text.encode(), np.uint8)
        buckets = [b for found, begins, ends in language_id._parts(data, np.array([0, len(data)])) for b in found[begins[0] : ends[0]]]
        assert own == pytest.approx(language_id.SCALE * np.mean([model.weights[b] for b in buckets], axis=0) + model.offsets, abs=1e-3)
        sure = 1 / (1 + np.exp(-2 * own))
        family, options = model.families[int(np.argmax(own[:3]))], model.members[model.families[int(np.argmax(own[:3]))]]
        wins = {x: sum(own[m] >= 0 if a == x else own[m] < 0 for m, (of, a, b) in enumerate(model.machines) if of == family and x in (a, b)) for x in options}
        if sorted(wins.values())[-1:] != sorted(wins.values())[-2:-1]:
            assert lang == max(options, key=wins.get)
        inner = [sure[m] if a == lang else 1 - sure[m] for m, (of, a, b) in enumerate(model.machines) if of == family and lang in (a, b)]
        assert score == pytest.approx(sure[:3].max() / sure[:3].sum() * (np.mean(inner) if inner else 1), abs=1e-6)
    assert chosen[:5] == list(LANGS)


def test_samples_are_bounded_under_repeats(spark):
    rows = [(8, "das haus", "de")] * 500 + [(7, "das haus und mehr", "de")] * 500 + [(i, f"the house {i}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bags = language_id.sampled_bags(language_id.learnable(df), {"de": 2, "en": 200}, 40).collect()
    assert collections.Counter(r["lang"] for r in bags) == {"de": 2, "en": 40}
    assert len({r["label"] for r in bags}) == 42
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert quality_classifier.labelled_bags(df, labels, quality_classifier.Shape(), label_col="quality", most_rows=50).count() == 50


def test_executors_train_the_machines_that_one_process_trains(spark):
    rows = [(i, f"{LANGS[lang]} {i} {i % 7}", lang) for i, lang in enumerate(x for x in LANGS for _ in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.fit_languages(df, rows_per_lang=15)
    bags = language_id.sampled_bags(language_id.learnable(df), dict.fromkeys(LANGS, 20), 15).toArrow().sort_by("label")
    plain = language_id.Hierarchy(list(LANGS)).fit(wh.Bags(bags), bags["lang"].to_pylist())
    assert model.machines == plain.machines and len(model.machines) > language_id.MACHINES_A_TASK
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.offsets, plain.offsets)


def test_stray_languages_are_an_error_or_left_out(spark):
    rows = [(i, "the house and the garden", "en") for i in range(40)] + [(100 + i, "das haus", "de") for i in range(40)] + [(1000 + i, "q", f"junk{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="least_rows or most_machines"):
        language_id.fit_languages(df, most_machines=20)
    assert language_id.fit_languages(df, most_machines=20, least_rows=5).langs == ["de", "en"]
    assert language_id.fit_languages(df.filter("lang = 'en'")).langs == ["en"]
    assert language_id.fit_languages(df.limit(0)).langs == []


def test_one_task_trains_the_quality_model(spark):
    df = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad bad ") + str(i)) for i in range(80)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    shape = quality_classifier.Shape(bits=10, width=4)
    bags = quality_classifier.labelled_bags(df, labels, shape, label_col="quality", most_rows=60)
    table, offset = quality_classifier.fit_quality(bags, shape)
    got = bags.toArrow().sort_by("label")
    plain, plain_offset = quality_classifier.train(wh.Bags(got), np.array([int(x.split(":")[0]) for x in got["label"].to_pylist()]), shape).folded()
    assert np.array_equal(table, plain) and offset == plain_offset
    none, even = quality_classifier.fit_quality(bags.limit(0), shape)
    assert not none.any() and even == 0
