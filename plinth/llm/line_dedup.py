"""Line deduplication by distinct-site spread.

Every line with enough words is hashed to 128 bits. HyperLogLog sketches of the sites of a line merge by
aggregation, on the map side first, so a line on a third of all documents costs one small sketch per task.
Lines whose estimate is near the threshold get an exact distinct count, from the same narrow rows; the others
are decided by the estimate, whose error cannot carry them over the band. Lines spread over enough sites are
boilerplate and leave every document. Texts move once, to meet the hashes of their own removed lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, let, settle, words


def line_hash(line: Column) -> Column:
    """128 bits of the line without white space at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(WHITE))))


def spread_lines(lines: DataFrame, *, min_sites: int, log2_registers: int = 12, band: float = 0.25) -> DataFrame:
    """Hashes ``h`` of the lines of (h, site) that stand on at least ``min_sites`` sites.

    ``band``: lines whose estimate lies within that share of the threshold are counted exactly. A sketch of
    2^12 registers errs by 1.6 %, so the default band is 15 standard errors wide.
    """
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log2_registers)).alias("sites"), F.count(F.lit(1)).alias("n"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    # A line that occurs fewer times than the threshold cannot reach it.
    likely = settle(sketched.filter((F.col("n") >= min_sites) & (F.col("sites") >= low)).select("h", "sites"), "line-spread")
    near = likely.filter(F.col("sites") <= high).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return likely.filter(F.col("sites") > high).select("h").unionByName(exact.select("h"))


def drop_spread_lines(
    docs: DataFrame,
    *,
    text_col: str = "text",
    site_col: str = "source",
    id_col: str = "doc_id",
    min_sites: int = 10,
    min_words: int = 3,
    text_out: str = "text",
    removed_out: str | None = "n_removed",
    band: float = 0.25,
) -> DataFrame:
    """``docs`` without the lines that stand on at least ``min_sites`` sites; other columns pass unchanged.

    Lines are what \\n separates, compared without white space at their ends; lines of fewer than ``min_words``
    words always stay. ``removed_out`` (long) counts the removed lines, null to leave it out. A null text stays
    null and loses 0 lines; an empty text stays empty; a null site is a site of its own; a document that
    consists of removed lines keeps an empty text; repeated rows are treated alike; an empty table gives an
    empty result. Documents are matched on id and text hash, so neither has to be unique. Very long lines and texts are
    worked on whole, in time that grows with their length.
    """
    taken = {c.lower() for c in docs.columns} - {text_out.lower()}
    if removed_out and removed_out.lower() in taken:
        raise ValueError(f"column {removed_out!r} exists already; give removed_out another name")
    text = F.coalesce(F.col("_pl_text"), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("_pl_row"), F.col(id_col).alias("_pl_id"), F.col(site_col).alias("_pl_site"), F.col(text_col).alias("_pl_text"))
    split = whole.select(
        F.xxhash64("_pl_id", "_pl_text").alias("doc"),
        F.coalesce(F.concat(F.lit("s"), F.col("_pl_site").cast("string")), F.lit("null")).alias("site"),
        F.explode(F.array_distinct(F.filter(F.split(text, "\n"), lambda line: F.size(words(line)) >= min_words))).alias("line"),
    ).select("doc", "site", line_hash(F.col("line")).alias("h"))
    lines = settle(split, "line-hashes")
    gone = spread_lines(lines.select("h", "site"), min_sites=min_sites, band=band)
    per_doc = lines.join(gone, "h", "left_semi").groupBy("doc").agg(F.collect_set("h").alias("_pl_gone"))
    per_doc = per_doc.withColumnRenamed("doc", "_pl_doc")
    joined = whole.withColumn("_pl_doc", F.xxhash64("_pl_id", "_pl_text")).join(per_doc, "_pl_doc", "left")

    def rest(lines_of: Column) -> Column:
        stays = F.filter(lines_of, lambda line: (F.size(words(line)) < min_words) | ~F.array_contains(F.col("_pl_gone"), line_hash(line)))
        return F.struct(F.array_join(stays, "\n").alias("text"), (F.size(lines_of) - F.size(stays)).cast("long").alias("n"))

    done = F.when(F.col("_pl_gone").isNull(), F.struct(F.col("_pl_text").alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(let(F.split(text, "\n"), rest))
    out = joined.withColumn("_pl_done", done)
    columns = [F.col("_pl_done.text").alias(text_out) if c == text_out else F.col("_pl_row")[c].alias(c) for c in docs.columns]
    columns += [] if text_out in docs.columns else [F.col("_pl_done.text").alias(text_out)]
    return out.select(*columns, *([F.col("_pl_done.n").alias(removed_out)] if removed_out else []))
