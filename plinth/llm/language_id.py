"""Language identification by hierarchical discrimination.

Linear support vector machines, one for each family against the rest, first choose the language family; then
one-versus-one machines choose among the closely related languages inside it, so that the machines grow with the number
of languages and not with its square. All share one pass over hashed byte n-grams and words of the text: a bucket holds
one weight for each machine. Training is subgradient descent on the hinge loss with an L2 term, in numpy, over the hashed
features of a bounded sample of each language. Machines are independent, so executors train them, a few machines a task;
the driver sees counts of languages and finished weights only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plinth.llm import wordhash as wh
from plinth.llm.quality_classifier import held_out

#: Families of related languages; any other language is a family of its own.
FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS, SIZES, SCALE = 16, (2, 3, 4), 40.0
#: The L2 term; epochs over a machine's rows; machines that one task trains one after the other.
SHRINK, EPOCHS, MACHINES_A_TASK = 1e-4, 6, 4
#: A machine with its weights in buckets, as executors return it.
TRAINED_SQL = "machine int, weights binary, offset double"
# ASCII letters count in lower case, other ASCII bytes as a space, bytes of other letters as they are.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)])
_CODES = (wh.constants(256, 41) >> np.uint64(32)).astype(np.uint32)[_FOLD]


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def trained(machine: tuple[str | None, str, str | None], bags: wh.Bags, labels: list[str], seed: int) -> tuple[np.ndarray, float]:
    """(weights, offset) of a machine; bags and labels of languages that it does not ask about are passed over."""
    family, a, b = machine
    rng, side = np.random.default_rng((3, seed)), labels if family else [family_of(x) for x in labels]
    rows = [i for i, x in enumerate(side) if b is None or x in (a, b)]
    # The weights are v * scale, so that shrinking all of them is one multiplication.
    v, scale, offset, steps, total = np.zeros(1 << BITS, np.float64), 1.0, 0.0, 0, EPOCHS * max(1, len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            own, share = bags[rows[i]]
            x, y = SCALE * share, 1.0 if side[rows[i]] == a else -1.0
            pace = 0.5 * (1 - steps / total)
            steps += 1
            margin = y * (scale * (v[own] @ x) + offset)
            scale *= 1 - pace * SHRINK
            if margin < 1:
                v[own] += pace * y / scale * x  # the buckets of a bag are distinct
                offset += 0.1 * pace * y
    return (v * scale).astype(np.float32), offset


class Hierarchy:
    """Machines: each family against the rest, then pairs of languages of one family; each has a column of weights and an offset."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        self.machines = [(None, family, None) for family in self.families] if len(self.families) > 1 else []
        self.machines += [(family, a, b) for family in self.families for a, b in combinations(self.members[family], 2)]
        self.weights = np.zeros((1 << BITS, len(self.machines)), np.float32)
        self.offsets = np.zeros(len(self.machines))

    def put(self, machine: int, weights: np.ndarray, offset: float) -> None:
        self.weights[:, machine], self.offsets[machine] = weights, offset

    def fit(self, bags: wh.Bags, labels: list[str]) -> "Hierarchy":
        """All machines trained here, one after the other."""
        for m, machine in enumerate(self.machines):
            self.put(m, *trained(machine, bags, labels, m))
        return self

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.machines)))
        for rows, data, offs in wh.chunks(texts):
            n, sums = np.zeros(len(offs) - 1), np.zeros((len(offs) - 1, len(self.machines)))
            for buckets, begins, ends in _parts(data, offs):
                ends = np.maximum(ends, begins)
                n += ends - begins
                for m in range(len(self.machines)):
                    sums[:, m] += wh.span_sums(self.weights[:, m][buckets], begins, ends)
            out[rows] = SCALE * sums / np.maximum(n, 1)[:, None] + self.offsets
        return out

    def _families(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The family with the largest margin, the first of equal ones, and its share of the families' probabilities."""
        if len(self.families) < 2:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        own = margins[:, : len(self.families)]
        p = 1 / (1 + np.exp(-np.clip(2 * own, -30, 30)))
        best = np.argmax(own, axis=1)
        return best, p[np.arange(len(best)), best] / p.sum(axis=1)

    def _choose(self, margins: np.ndarray, family: str, options: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most votes win, then the larger sum of margins, then the first; with the mean of the winner's probabilities."""
        votes, heft, sure = (np.zeros((len(margins), len(options))) for _ in range(3))
        for m, (of, a, b) in enumerate(self.machines):
            if of != family:
                continue
            i, j, d = options.index(a), options.index(b), margins[:, m]
            p = 1 / (1 + np.exp(-np.clip(2 * d, -30, 30)))
            votes[:, i] += d >= 0
            votes[:, j] += d < 0
            heft[:, i], heft[:, j] = heft[:, i] + d, heft[:, j] - d
            sure[:, i], sure[:, j] = sure[:, i] + p, sure[:, j] + 1 - p
        best = np.argmax(votes + 0.4 * np.tanh(heft), axis=1)
        share = sure[np.arange(len(best)), best] / (len(options) - 1) if len(options) > 1 else np.ones(len(best))
        return best, share

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        margins = self.margins(texts)
        family, p = self._families(margins)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for k, name in enumerate(self.families):
            rows = np.flatnonzero((family == k) & letters)
            if len(rows):
                best, share = self._choose(margins[rows], name, self.members[name])
                lang[rows] = np.array(self.members[name], object)[best]
                score[rows] = p[rows] * share
        return list(lang), score


def _parts(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    codes = _CODES[data]
    parts = [(wh.gram_buckets(codes, size, BITS), *wh.within(offs, size)) for size in SIZES]
    starts, ends, first = wh.word_spans(data, offs)
    words = (wh.word_hashes(data, starts, ends, lower=True) & np.uint64((1 << BITS) - 1)).astype(np.uint32)
    return [*parts, (words, first[:-1], first[1:])]


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_pl_lang, _pl_text, _pl_hash): rows with a language and a text outside the held-out third."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    return known.select(F.col(lang_col).cast("string").alias("_pl_lang"), F.col(text_col).alias("_pl_text"), F.xxhash64(id_col, text_col).alias("_pl_hash"))


def sampled_bags(known: DataFrame, counts: dict[str, int], rows_per_lang: int) -> DataFrame:
    """``wh.BAG_SQL`` and lang: features of ``rows_per_lang`` rows of each language in ``counts``; labels order them."""
    # The hash has to fall below a level at which a language is expected to yield somewhat more distinct rows than it may.
    shares = known.sparkSession.createDataFrame([(lang, min(1.0, 1.3 * rows_per_lang / max(1, n))) for lang, n in counts.items()], "_pl_lang string, share double")
    drawn = known.join(F.broadcast(shares), "_pl_lang").filter(F.pmod("_pl_hash", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    once = drawn.groupBy("_pl_lang", "_pl_hash").agg(F.min("_pl_text").alias("text"))
    within = F.row_number().over(Window.partitionBy("_pl_lang").orderBy(F.pmod("_pl_hash", F.lit(1_000_003)), "_pl_hash"))
    chosen = once.withColumn("place", within).filter(F.col("place") <= rows_per_lang)
    label = F.concat_ws(":", F.lpad("place", 9, "0"), F.col("_pl_lang"))
    bags = chosen.select(label.alias("label"), "text").mapInArrow(wh.bagged(_parts), wh.BAG_SQL)
    return bags.withColumn("lang", F.substring("label", 11, 2**31 - 1))


def fit_languages(
    docs: DataFrame, *, rows_per_lang: int = 1500, most_rows: int = 12_000, least_rows: int = 1, most_machines: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Hierarchy:
    """Learns every non-null language from at most ``rows_per_lang`` of its rows, drawn by hash outside the held-out third.

    All languages together get at most ``most_rows`` rows, or one each where there are more languages. Equal rows of one
    id count once. A row has at most 2^16 features of 6 bytes, however long its text is. Languages with fewer than about
    ``least_rows`` distinct rows are not learned (by default all are). Languages that need more than ``most_machines``
    machines, 256 KB each, are an error: a table with thousands of stray values has to be cleaned, or ``least_rows`` raised.
    """
    known = learnable(docs, id_col, text_col, lang_col)
    found = known.groupBy("_pl_lang").agg(F.approx_count_distinct("_pl_hash").alias("n")).filter(F.col("n") >= least_rows)
    # A language more than there are machines needs a machine more, but for the first.
    counts = {row["_pl_lang"]: row["n"] for row in found.limit(most_machines + 2).collect()}
    model = Hierarchy(sorted(counts)) if len(counts) <= most_machines + 1 else None
    if model is None or len(model.machines) > most_machines:
        raise ValueError(f"these languages need more than {most_machines} machines; raise least_rows or most_machines")
    if not model.machines:
        return model
    tasks = [range(i, min(i + MACHINES_A_TASK, len(model.machines))) for i in range(0, len(model.machines), MACHINES_A_TASK)]
    asks = lambda m, lang: model.machines[m][0] in (None, family_of(lang))
    needed = [(lang, t) for lang in model.langs for t, own in enumerate(tasks) if any(asks(m, lang) for m in own)]
    needed = docs.sparkSession.createDataFrame(needed, "lang string, task int")
    machines = model.machines

    def train(bags: pa.Table) -> pa.Table:
        own, bags = tasks[bags["task"][0].as_py()], bags.sort_by("label")
        rows, langs = wh.Bags(bags), bags["lang"].to_pylist()
        done = [(m, *trained(machines[m], rows, langs, m)) for m in own]
        return pa.table({"machine": pa.array([m for m, _, _ in done], pa.int32()), "weights": pa.array([w.tobytes() for _, w, _ in done], pa.binary()), "offset": pa.array([float(o) for _, _, o in done])})

    bags = sampled_bags(known, counts, max(1, min(rows_per_lang, most_rows // len(counts))))
    # So many partitions by name, as small ones would be put together and trained one after the other.
    dealt = bags.join(F.broadcast(needed), "lang").repartition(2 * len(tasks), "task")
    for row in dealt.groupBy("task").applyInArrow(train, TRAINED_SQL).collect():
        model.put(row["machine"], np.frombuffer(row["weights"], np.float32), row["offset"])
    return model


def identify_language(docs: DataFrame, model: Hierarchy, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and the product of the winners' probabilities (0 to 1).

    Null texts and texts without a letter are 'und' with score 0, and so is everything under a model that has
    learned nothing; very long texts count whole; repeated rows get equal results; an empty table gives an empty result;
    other columns pass; output columns that exist already are an error.
    """
    if {lang_out.lower(), score_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {lang_out!r} and {score_out!r} must be new")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, lang_out, score_out])
        wh.returned_memory()

    return docs.mapInArrow(judge, schema)
