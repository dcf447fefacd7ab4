"""Audit of how the sources of a language differ in their words.

Each input partition counts terms by (language, source) and gives off partial counts. Kept terms are dealt, by hash, into
blocks; the counts of a block in up to SOURCES sources are one dense int64 tile of groups by terms, in which all pairs of
groups are compared at once by broadcasting. A tile gives a partial pair matrix, whose entries are summed over the blocks,
and a heap of each group's strongest terms, which are merged. Languages with more sources have a tile for each pair of
source blocks; what a pair has in terms that neither block holds is the same for each of them and added at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import settle

#: Letters of ASCII and all bytes of other characters make terms; A-Z become a-z, all else separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and entries of counts that a partition holds before it gives them off.
SLICE, MOST_HELD = 1 << 22, 300_000
#: Terms and sources of a tile, and entries of what broadcasting makes at a time.
TERMS, SOURCES, ENTRIES = 4096, 64, 1 << 18
UNIT = 1_000_000_000
_CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_CELL_SQL = "lang string, source string, term binary, n long, docs long"
_TILE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64()), ("seen", pa.int64()), ("base", pa.int64()), ("v", pa.int64())])
_TILE_SQL = "lang string, source string, part string, item binary, value long, seen long, base long, v long"


def term_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice of the text at a time; no term is cut."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(TERM_BYTES).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.repeat(lang, len(terms) + 1), pa.repeat(source, len(terms) + 1), pa.array([None, *terms], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_CELL)

    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in term_slices(raw.as_py()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size > MOST_HELD:
                yield from given()
                held, size = {}, 0
    yield from given()


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / whole), by long division in base 1000: exact for wholes under 9 * 10^15."""
    out, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def pair_values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / q) of each row of ``p`` with each row of ``q``; what is broadcast at a time is bounded."""
    out, step = np.zeros((len(p), len(q)), np.int64), max(1, ENTRIES // max(1, q.size))
    for at in range(0, len(p), step):
        gap = p[at : at + step, None, :] - q[None, :, :]
        gap *= gap
        gap //= q[None, :, :]
        out[at : at + step] = gap.sum(axis=2)
    return out


def _tile(top_terms: int, sources: int):
    def tile(key: tuple, table: pa.Table) -> pa.Table:
        lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        heads = table.filter(pc.is_null(table["term"])).sort_by("idx")
        idx, whole = heads["idx"].to_numpy(), heads["n"].to_numpy()
        names, v, lang_n = heads["source"].to_pylist(), heads["v"][0].as_py(), heads["total"][0].as_py()
        cells = table.filter(pc.is_valid(table["term"]))
        coded = cells["term"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, column = coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]
        counts, totals = np.zeros((len(idx), len(order)), np.int64), np.zeros(len(order), np.int64)
        counts[np.searchsorted(idx, cells["idx"].to_numpy()), column] = cells["n"].to_numpy()
        totals[column] = cells["total"].to_numpy()
        p = shares(counts, (whole + v)[:, None]) if len(order) else counts
        none = shares(np.zeros(len(idx), np.int64), np.maximum(whole + v, 1))
        block, parts = idx // sources, []
        for mine, other in {(low, high), (high, low)}:
            a, b = np.flatnonzero(block == mine), np.flatnonzero(block == other)
            values, base = pair_values(p[a], p[b]), (none[a][:, None] - none[b][None, :]) ** 2 // none[b][None, :]
            i, j = np.nonzero(a[:, None] != b[None, :])
            parts.append([pa.repeat(lang, len(i)), pa.array([names[x] for x in a[i]], pa.string()), pa.repeat("pair", len(i)), pa.array([names[x].encode() for x in b[j]], pa.binary()), pa.array(values[i, j]), pa.repeat(pa.scalar(len(order), pa.int64()), len(i)), pa.array(base[i, j]), pa.repeat(pa.scalar(v, pa.int64()), len(i))])
        if low == high and len(order):
            q = shares(totals, np.array(lang_n + v))
            gap = p - q
            strength = np.where((counts > 0) & (gap > 0), gap * gap // q, -1)
            for i, row in enumerate(strength):
                best = np.argsort(-row, kind="stable")[:top_terms]
                best = best[row[best] >= 0]
                zero = pa.repeat(pa.scalar(0, pa.int64()), len(best))
                parts.append([pa.repeat(lang, len(best)), pa.repeat(names[i], len(best)), pa.repeat("term", len(best)), terms.take(pa.array(best)), pa.array(row[best]), zero, zero, zero])
        return pa.concat_tables([pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _TILE, strict=True)], schema=_TILE) for columns in parts] or [_TILE.empty_table()])

    return tile


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def source_divergence(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 3,
    top_terms: int = 200,
    terms_per_tile: int = TERMS,
    sources_per_tile: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other, and by which terms from the language.

    A language keeps the terms that at least ``min_docs`` of its rows have. p of a term in a group is its smoothed share in
    billionths; part 'pair' has for each other source of the language the sum over kept terms of floor((p - q)^2 / q) with
    the other's share as q, and all ranks; part 'term' has the terms that the group uses more than its language does, by the
    same measure with the language's share as q, and ranks up to ``top_terms``. Ranks begin at 1; ties go by the item's bytes.
    All is whole numbers: exact for groups of fewer than 9 * 10^15 terms and languages of fewer than 2 * 10^9 kept ones.

    Null texts, languages and sources are empty strings, which are values like any other; a group without terms has shares
    too, and a language without kept terms has pairs of value 0; a language of one source has no pairs; repeated rows are
    rows, each counted; very long texts are split slice by slice; an empty table gives an empty result; other columns are
    ignored. Memory of a task: MOST_HELD counts, or one tile. One task ranks the other sources of one group, and numbers the
    sources of one language, a narrow row each.
    """
    raw = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), _text(text_col).cast("binary").alias("text")).mapInArrow(_count, _CELL_SQL)
    cells = settle(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-cells")
    term = Window.partitionBy("lang", "term")
    named = cells.filter("term is not null").select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("_pl_docs"), (F.min("source").over(term) == F.col("source")).cast("long").alias("first"))
    kept = settle(named.filter(F.col("_pl_docs") >= min_docs).drop("_pl_docs"), "divergence-kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.sum("first").alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = cells.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["whole", "firsts"])
    groups = groups.select("lang", "source", "whole", F.sum("firsts").over(lang).alias("v"), F.sum("whole").over(lang).alias("lang_n"), F.count(F.lit(1)).over(lang).alias("n_sources"), (F.row_number().over(lang.orderBy("source")) - 1).cast("long").alias("idx"))
    groups = settle(groups, "divergence-groups")
    blocks = F.greatest(F.ceil(F.col("v") / terms_per_tile), F.lit(1))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "idx", "n_sources", "source", F.lit(None).cast("binary").alias("term"), F.col("whole").alias("n"), F.col("lang_n").alias("total"), "v")
    dealt = kept.join(groups.drop("whole", "lang_n"), ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "idx", "n_sources", F.lit(None).cast("string").alias("source"), "term", "n", "total", "v")
    own = F.floor(F.col("idx") / sources_per_tile)
    with_other = heads.unionByName(dealt).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_sources") - 1) / sources_per_tile))))
    tiles = with_other.withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")}).drop("other", "n_sources")
    found = settle(tiles.groupBy("lang", "block", "low", "high").applyInArrow(_tile(top_terms, sources_per_tile), _TILE_SQL), "divergence-tiles")

    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("base").alias("base"), F.max("v").alias("v"))
    pairs = pairs.withColumn("value", F.col("value") + (F.col("v") - F.col("seen")) * F.col("base"))
    rank = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(group).alias("rank"))
    out = rank(pairs).unionByName(rank(found.filter("part = 'term'")).filter(F.col("rank") <= top_terms))
    return out.withColumn("item", F.col("item").cast("string"))
