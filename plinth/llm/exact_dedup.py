"""Exact deduplication by content sort.

Splitters sampled from the content, weighed by bytes, divide the order (content prefix, content hash, hashed id) into
ranges of about equal size, as many as the bytes of the table ask for. One exchange deals each range to a task of its
own; inside a range an external sort puts equal texts side by side and the window operator compares neighbours on the
full text. Because the order ends in the hashed id, a text that holds a third of all rows is cut into many ranges
instead of landing in one task. A text can lie in two ranges only if a splitter has its prefix and hash, so the few
texts that are cut are known beforehand; their totals come from one map-side combined aggregate with at most as many
rows as splitters, which is therefore safe to broadcast.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import let, parts_for

#: Bytes of text (and as much for a row as ROW_BYTES) that a range is made for. The splitters travel with each task, so
#: their number has a bound, about 3 MB; ranges of a table of more than half a terabyte grow beyond, and their sorts spill.
RANGE_BYTES, ROW_BYTES, MOST_RANGES = 16 << 20, 64, 32768
#: Keys that are sampled at most, about 20 MB on the driver.
MOST_SAMPLED = 1 << 18


def _key(text: Column, row_id: Column, prefix: int) -> Column:
    return F.struct(F.substring(text, 1, prefix).alias("k"), F.xxhash64(text).alias("h"), F.xxhash64(row_id).alias("r"))


def sample_splitters(keys: DataFrame, n_ranges: int | None, per_range: int, seed: int) -> list[tuple]:
    """Quantiles by bytes of a bounded sample of keys (k, h, r, size); ``n_ranges`` None: as many ranges as the bytes ask for.

    Keys without a size weigh the same.
    """
    if n_ranges == 1:
        return []
    keys = keys if "size" in keys.columns else keys.withColumn("size", F.lit(1).cast("long"))
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n_ranges = min(MOST_RANGES, n_ranges or parts_for(whole["bytes"], RANGE_BYTES))
    if not whole["n"] or n_ranges < 2:
        return []
    share = min(1.0, min(MOST_SAMPLED, per_range * n_ranges) / whole["n"])
    drawn = sorted((r["k"].encode(), r["h"], r["r"], r["size"]) for r in keys.sample(False, share, seed).collect())
    upto = list(accumulate(row[3] for row in drawn))
    picked = {drawn[bisect_left(upto, upto[-1] * i / n_ranges)][:3] for i in range(1, n_ranges)} if drawn else set()
    return [(k.decode(), h, r) for k, h, r in sorted(picked)]


def _place(key: Column, splitters: list[tuple]) -> Column:
    """Struct (pid: splitters not above the key, cut: whether a splitter has the key's content)."""
    if not splitters:
        return F.struct(F.lit(0).alias("pid"), F.lit(False).alias("cut"))
    # One literal that the optimizer parses once, however many splitters there are.
    at_all = F.from_json(F.lit(json.dumps([{"k": k, "h": h, "r": r} for k, h, r in splitters])), "array<struct<k string, h long, r long>>")
    n, steps = len(splitters), math.ceil(math.log2(len(splitters) + 1))

    def among(all_: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            mid = F.shiftright(acc["lo"] + acc["hi"], 1)
            inside, below = acc["lo"] < acc["hi"], F.get(all_, mid) <= acc["key"]
            return F.struct(
                F.when(inside & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(inside & ~below, mid).otherwise(acc["hi"]).alias("hi"),
                acc["key"].alias("key"),
            )

        def done(acc: Column) -> Column:
            same = lambda i: F.coalesce((F.get(all_, i)["k"] == acc["key"]["k"]) & (F.get(all_, i)["h"] == acc["key"]["h"]), F.lit(False))
            return F.struct(acc["lo"].alias("pid"), (same(acc["lo"]) | same(acc["lo"] - 1)).alias("cut"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), key.alias("key"))
        return F.aggregate(F.lit(list(range(steps))), start, halve, done)

    return let(at_all, among)


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "smallest",
    carry: tuple[str, ...] = (),
    n_ranges: int | None = None,
    sample_per_range: int = 64,
    prefix: int = 48,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the ``carry`` columns.

    Equal means: identical after ``normalise``. ``keep`` says which id of a group stays, 'smallest' or
    'largest'. Null texts count as empty; very long texts are compared whole. A null id never wins against another
    id; a group of null ids keeps one row under a null keep_id. Of repeated rows with the winning id exactly one is
    kept, and rows of one text and one id stay in one range. An empty table gives an empty result. Extra columns are
    ignored unless carried, so their names cannot clash. ``n_ranges`` None: as many as the bytes ask for.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    base = docs.select(
        F.col(id_col).alias("_pl_id"),
        normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_pl_text"),
        F.struct(F.lit(0).alias("_pl_none"), *(F.col(c) for c in carry)).alias("_pl_carry"),
    )
    key = _key(F.col("_pl_text"), F.col("_pl_id"), prefix)
    size = (F.octet_length("_pl_text") + ROW_BYTES).cast("long")
    splitters = sample_splitters(base.select(key.alias("key"), size.alias("size")).select("key.*", "size"), n_ranges, sample_per_range, seed)
    placed = base.withColumn("_pl_at", _place(key, splitters)).withColumns({"_pl_pid": F.col("_pl_at.pid"), "_pl_cut": F.col("_pl_at.cut")}).drop("_pl_at")

    best = F.max if keep == "largest" else F.min
    order = F.col("_pl_id").desc_nulls_last() if keep == "largest" else F.col("_pl_id").asc_nulls_last()
    run = Window.partitionBy("_pl_pid", "_pl_text").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = placed.repartitionById(len(splitters) + 1, F.col("_pl_pid")).select(
        "_pl_id", "_pl_cut", "_pl_carry",
        best("_pl_id").over(whole).alias("_pl_keep"),
        F.count(F.lit(1)).over(whole).alias("_pl_size"),
        F.row_number().over(run).alias("_pl_rank"),
        F.sha2("_pl_text", 256).alias("_pl_sha"),
    )
    keep_id, size = F.col("_pl_keep"), F.col("_pl_size")
    if splitters:
        cut = placed.filter("_pl_cut").groupBy(F.sha2("_pl_text", 256).alias("_pl_sha")).agg(best("_pl_id").alias("_pl_all"), F.count(F.lit(1)).alias("_pl_n"))
        ranged = ranged.join(F.broadcast(cut), "_pl_sha", "left")
        keep_id, size = F.when(F.col("_pl_n").isNotNull(), F.col("_pl_all")).otherwise(keep_id), F.coalesce("_pl_n", size)
    return ranged.select(
        F.col("_pl_id").alias(id_col),
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        ((F.col("_pl_rank") == 1) & F.col("_pl_id").eqNullSafe(keep_id)).alias("kept"),
        F.col("_pl_sha").alias("text_sha256"),
        *(F.col("_pl_carry")[c].alias(c) for c in carry),
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``exact_groups`` for the cases)."""
    id_col = options.get("id_col", "doc_id")
    others = tuple(c for c in docs.columns if c != id_col)
    wrapped = docs.select(id_col, F.struct(*others).alias("_pl_row"), F.col(options.get("text_col", "text")).alias("_pl_body"))
    kept = exact_groups(wrapped, **{**options, "text_col": "_pl_body", "carry": ("_pl_row",)}).filter("kept")
    return kept.select(id_col, "_pl_row.*").select(*docs.columns)
