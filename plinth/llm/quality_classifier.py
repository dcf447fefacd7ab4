"""Quality classifier on supervised subword embeddings.

Words, pairs of words in a row, and character n-grams of words with their borders are hashed to learned vectors; a
document is the average of its vectors, and a softmax layer judges it. Training is plain stochastic gradient descent in
numpy, in one task over the hashed features of a bounded sample of labelled rows. Since the layer is linear in an average,
scoring folds it into one number a bucket, which is all that the driver gets: executors look numbers up and average them,
batch by batch, over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plinth.llm import wordhash as wh


@dataclass(frozen=True)
class Shape:
    """bits: log2 of the buckets for words and for character n-grams each; sizes: of the n-grams, in characters."""

    bits: int = 17
    sizes: tuple[int, ...] = (3, 5)
    width: int = 8


def _features(data: np.ndarray, offs: np.ndarray, shape: Shape) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (buckets, begins, ends): spans of a text in each part. N-grams have no white space but at their ends.

    Pairs of equal words are one feature, so that stuttering texts are alike whatever word they repeat.
    """
    _, _, first = spans = wh.word_spans(data, offs)
    hashes = wh.word_hashes(data, *spans[:2])
    top = np.uint64((1 << shape.bits) - 1)
    pairs = np.where(hashes[1:] == hashes[:-1], np.uint64(0), wh.mix(hashes[:-1] * np.uint64(3) + hashes[1:])) if len(hashes) > 1 else np.zeros(0, np.uint64)
    parts = [((hashes & top).astype(np.int64), first[:-1], first[1:]), ((pairs & top).astype(np.int64), first[:-1], np.maximum(first[1:] - 1, first[:-1]))]
    codes, places = wh.characters(data, offs)
    solid = codes != 32
    for size in shape.sizes:
        buckets = wh.gram_buckets(codes, size, shape.bits).astype(np.int64) + (1 << shape.bits)
        inside = np.ones(len(buckets), bool)
        for i in range(1, size - 1):
            inside &= solid[i : i + len(buckets)]
        parts.append((buckets[inside], *wh.kept_spans(inside, *wh.within(places, size))))
    return parts


@dataclass(frozen=True)
class Model:
    """vectors: one a bucket; layer and bias: of the two labels."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """(one number a bucket, offset): the logit of label 1 is their average over a text plus the offset."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(bags: wh.Bags, labels: np.ndarray, shape: Shape = Shape(), *, epochs: int = 8, rate: float = 25.0, seed: int = 5) -> Model:
    """Without rows, or with one label only, the vectors are 0 and the bias gives the labels' smoothed share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros((2 << shape.bits, shape.width), np.float32), np.zeros((2, shape.width), np.float32), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (2 << shape.bits, shape.width)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, shape.width)).astype(np.float32)
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            own, weight = bags[i]
            pace = rate * (1 - steps / total)
            steps += 1
            hidden = weight @ vectors[own]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ layer
            layer -= pace * 0.02 * np.outer(p, hidden)
            bias -= pace * 0.002 * p
            vectors[own] -= pace * weight[:, None] * back
    return Model(vectors, layer, bias)


def score(texts: pa.Array, table: np.ndarray, offset: float, shape: Shape) -> np.ndarray:
    """Probability of label 1 for each text; a text without features gets the offset's."""
    out = np.empty(len(texts))
    for rows, data, offs in wh.chunks(texts):
        total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for buckets, begins, ends in _features(data, offs, shape):
            ends = np.maximum(ends, begins)
            total += wh.span_sums(table[buckets], begins, ends)
            n += ends - begins
        out[rows] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + offset, -30, 30)))
    return out


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts == part


def labelled_bags(docs: DataFrame, labels: DataFrame, shape: Shape, *, label_col: str, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``wh.BAG_SQL``: features of at most ``most_rows`` labelled ids outside the held-out part, drawn by hash.

    Bags are named 'label:hash:id'. Rows with a null id, label or text are left out; labels of one id that contradict each
    other are, too; of the texts of a repeated id the smallest counts. A row has at most 2^(bits + 1) features of 6 bytes,
    however long its text is.
    """
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("_pl_id")).agg(F.min(label_col).alias("_pl_low"), F.max(label_col).alias("_pl_high"))
    drawn = ids.filter("_pl_low = _pl_high").orderBy(F.xxhash64("_pl_id"), "_pl_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("_pl_id"), F.col(text_col).alias("_pl_text")).filter(F.col("_pl_text").isNotNull()).join(F.broadcast(drawn), "_pl_id")
    named = rows.groupBy("_pl_id").agg(F.min("_pl_text").alias("text"), F.first(F.col("_pl_low").cast("int")).alias("label"))
    label = F.concat_ws(":", F.col("label"), F.lpad(F.hex(F.xxhash64("_pl_id")), 16, "0"), F.col("_pl_id").cast("string"))
    return named.select(label.alias("label"), "text").mapInArrow(wh.bagged(lambda data, offs: _features(data, offs, shape)), wh.BAG_SQL)


def fit_quality(bags: DataFrame, shape: Shape = Shape()) -> tuple[np.ndarray, float]:
    """``Model.folded`` of a model that one task trains on ``labelled_bags``; the bags are what bounds it."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, wh.BAG_SCHEMA).sort_by("label")
        table, offset = train(wh.Bags(got), np.array([int(x.split(":")[0]) for x in got["label"].to_pylist()], np.int64), shape).folded()
        del got
        wh.returned_memory()
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([offset])], ["weights", "offset"])

    found = bags.repartition(1).mapInArrow(learn, "weights binary, offset double").collect()
    if not found:  # no task runs over an empty table
        return train(wh.Bags(wh.BAG_SCHEMA.empty_table()), np.zeros(0, np.int64), shape).folded()
    return np.frombuffer(found[0]["weights"], np.float32), found[0]["offset"]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    most_rows: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    score_out: str = "score",
    predicted_out: str = "predicted",
    shape: Shape = Shape(),
) -> DataFrame:
    """``docs`` with ``score_out`` (0 to 1, higher: label 1 likelier) and ``predicted_out`` (1 from ``threshold`` on).

    Learns from at most ``most_rows`` labelled ids outside the held-out fifth. Null and empty texts get the score
    of a text without features; very long texts count whole; repeated rows get equal scores; without labels all scores
    are 0.5; an empty table gives an empty result; output columns that exist already are an error.
    """
    if {score_out.lower(), predicted_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {score_out!r} and {predicted_out!r} must be new")
    table, offset = fit_quality(labelled_bags(docs, labels, shape, label_col=label_col, most_rows=most_rows, id_col=id_col, text_col=text_col), shape)
    model = docs.sparkSession.sparkContext.broadcast(table)  # 2^18 floats at any input size
    schema = StructType([*docs.schema.fields, StructField(score_out, DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(text_col), model.value, offset, shape)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, score_out])
        wh.returned_memory()

    return docs.mapInArrow(judge, schema).withColumn(predicted_out, (F.col(score_out) >= threshold).cast("int"))
