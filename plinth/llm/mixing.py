"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The target of a source is its weight's share of all tokens, at most ``most_epochs`` times its own size, the
excess reshared by weight. Sources are cut into shards by hashed id, so a source with a third of all rows is
spread over as many tasks as any. Equal-token blocks go to sources, and then to the shards of each source,
by highest quotients; a shard takes its quota from its own documents in a seeded order, whole rounds first
and then the first blocks of the order. Everything but one count of tokens is done on narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import count_words, settle, words

#: Tokens to a shard, and the most shards a source is cut into.
SHARD_TOKENS, MOST_SHARDS = 1 << 18, 8192


def cycled_weights(rank: Column, weights: tuple[float, ...]) -> Column:
    """The weight of the source with that 0-based rank, repeating."""
    return F.element_at(F.lit([float(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def capped_shares(sizes: DataFrame, most_epochs: float) -> DataFrame:
    """Adds ``target`` to (source_size, weight): shares of the sum of sizes by weight, none above the cap.

    Sorted by cap to weight, the capped sources come first; what they leave is shared by the others. One row
    per source goes through one task, which sorts about ten million of them in the memory that a task has; sites as
    sources of a crawl with more have to be grouped first.
    """
    cap = F.col("source_size") * F.lit(float(most_epochs))
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    heft = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = sizes.withColumns({"_pl_level": left / heft, "_pl_full": cap / F.col("weight") <= left / heft})
    # The level that holds is the first one that leaves a source below its cap; before it sources are full.
    first = F.min(F.when(~F.col("_pl_full"), F.struct(cap / F.col("weight"), F.col("rank"), F.col("_pl_level").alias("level")))).over(all_rows)["level"]
    return level.withColumn("target", F.when(F.col("_pl_full") | first.isNull(), cap).otherwise(F.col("weight") * first)).drop("_pl_level", "_pl_full")


def apportion(parts: DataFrame, within: list[str], tie: list[str], claim: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: in each group ``within``, ``seats`` (equal in the group) go to rows by highest ``claim / (2 k - 1)``.

    Two divisors enclose the right one, so only about two candidate seats a row have to be ranked.
    """
    group = Window.partitionBy(*within)
    n, total = F.count(F.lit(1)).over(group), F.sum(claim).over(group)
    low = F.greatest(F.col(seats) - n / 2, F.lit(0.0))
    sure = F.when((F.col("_pl_total") > 0) & (F.col("_pl_low") > 0), F.round(F.col(claim) * F.col("_pl_low") / F.col("_pl_total") - 1e-9).cast("long")).otherwise(F.lit(0))
    most = F.when(F.col("_pl_total") > 0, F.ceil(F.col(claim) * (F.col(seats) + F.col("_pl_n") / 2) / F.col("_pl_total") + 0.5).cast("long")).otherwise(F.lit(0))
    ranged = parts.withColumns({"_pl_n": n, "_pl_total": total, "_pl_low": low}).withColumns({"_pl_sure": sure, "_pl_most": most})
    ranged = ranged.withColumn("_pl_open", F.col(seats) - F.sum("_pl_sure").over(group))
    extra = (
        ranged.filter((F.col("_pl_open") > 0) & (F.col("_pl_most") > F.col("_pl_sure")))
        .withColumn("_pl_seat", F.explode(F.sequence(F.col("_pl_sure") + 1, F.col("_pl_most"))))
        .withColumn("_pl_rank", F.row_number().over(group.orderBy((F.col(claim) / (2 * F.col("_pl_seat") - 1)).desc(), *tie, "_pl_seat")))
        .filter("_pl_rank <= _pl_open")
        .groupBy(*within, *tie)
        .agg(F.count(F.lit(1)).alias("_pl_extra"))
    )
    keys = [*within, *tie]
    joined = ranged.join(extra, keys, "left")
    return joined.withColumn(out, F.col("_pl_sure") + F.coalesce("_pl_extra", F.lit(0))).select(*parts.columns, out)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most_epochs: int = 3,
    block_tokens: int = 16,
    seed: int = 17,
    carry: tuple[str, ...] = (),
    shards: int | None = None,
) -> DataFrame:
    """Per document: id, source, size, source_size, target, quota_blocks, taken and the ``carry`` columns.

    ``taken`` counts the words that the mix takes from the document, repeats included; it is at most
    ``most_epochs`` times its size. Sources are ranked by code point, null last, and get the ``weights`` in turn.
    Null and empty texts have size 0 and are taken 0 times; a null id is a value like any other; repeated rows
    are separate rows; very long texts are counted whole; an empty table gives an empty result. Order inside a shard: md5
    of seed and id, or of the text where the id is null, then size, then a hash of the text and the ``carry`` columns but
    for maps, so that only rows equal in all of these are interchangeable.
    """
    hashed = [c for c in (text_col, *carry) if "map<" not in docs.schema[c].dataType.simpleString()]
    spread = F.conv(F.substring("_pl_mix", 1, 8), 16, 10).cast("long")
    def sized(columns: tuple[str, ...]) -> DataFrame:
        return docs.select(
            F.col(id_col).alias("_pl_id"), F.col(source_col).alias("_pl_src"), count_words(F.col(text_col)).alias("_pl_size"), F.struct(F.lit(0).alias("_pl_none"), *(F.col(c) for c in columns)).alias("_pl_carry"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))).alias("_pl_mix"),
            F.xxhash64(*hashed).alias("_pl_tie"),
        )

    # Counting words is what costs: it is done once, and once more only where texts are carried along.
    narrow = settle(sized(()), "mix-sizes")
    total = narrow.agg(F.sum("_pl_size")).first()[0] or 0
    shards = shards or min(MOST_SHARDS, max(1, -(-total // SHARD_TOKENS)))
    shard_of = lambda df: df.withColumn("_pl_shard", (spread + F.col("_pl_size")) % shards)
    cut = shard_of(sized(carry) if carry else narrow)
    cells = settle(shard_of(narrow).groupBy("_pl_src", "_pl_shard").agg(F.sum("_pl_size").alias("cell")), "mix-cells")
    sizes = cells.groupBy("_pl_src").agg(F.sum("cell").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_pl_src").asc_nulls_last())) - 1)
    shares = capped_shares(ranked.withColumn("weight", cycled_weights(F.col("rank"), weights)), most_epochs)
    shares = shares.withColumns({"all": F.lit(0), "seats": F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_tokens).cast("long")})
    shares = settle(apportion(shares, ["all"], ["rank"], "target", "seats", "blocks"), "mix-shares").select("_pl_src", "rank", "source_size", "target", "blocks")
    same = lambda a, b: F.col(f"{a}._pl_src").eqNullSafe(F.col(f"{b}._pl_src"))
    per_cell = cells.alias("c").join(shares.alias("s"), same("c", "s")).select("rank", "source_size", "target", "blocks", F.col("c._pl_src"), "_pl_shard", "cell")
    quotas = apportion(per_cell, ["rank"], ["_pl_shard"], "cell", "blocks", "quota")
    quotas = quotas.withColumn("wanted", F.least(F.col("quota") * block_tokens, F.col("cell") * most_epochs))

    shard = Window.partitionBy("d._pl_src", "d._pl_shard").orderBy("_pl_mix", "_pl_size", "_pl_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.alias("d").join(quotas.alias("q"), same("d", "q") & (F.col("d._pl_shard") == F.col("q._pl_shard")))
    rounds = F.when(F.col("cell") > 0, F.floor(F.col("wanted") / F.col("cell"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("wanted") - rounds * F.col("cell")
    partial = F.least(F.col("_pl_size"), F.greatest(F.lit(0), rest - (F.col("_pl_end") - F.col("_pl_size"))))
    return joined.withColumn("_pl_end", F.sum("_pl_size").over(shard)).select(
        F.col("_pl_id").alias(id_col), F.col("d._pl_src").alias(source_col), F.col("_pl_size").alias("size"), "source_size", "target",
        F.col("quota").alias("quota_blocks"), (rounds * F.col("_pl_size") + partial).cast("long").alias("taken"),
        *(F.col("_pl_carry")[c].alias(c) for c in carry),
    )


def mixed_documents(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each whole time a document is taken, and one with its first words.

    The words of a part are joined by one space. Documents that are not taken are absent; for the cases see
    ``mix_sources``.
    """
    wrapped = docs.select(F.struct(*docs.columns).alias("_pl_row"), *{options.get("id_col", "doc_id"), options.get("source_col", "source")}, F.col(text_col).alias("_pl_body"))
    taken = mix_sources(wrapped, text_col="_pl_body", carry=("_pl_row",), **options).filter("taken > 0")
    times = F.call_function("div", F.col("taken"), F.col("size"))
    rest = (F.col("taken") % F.col("size")).cast("int")
    rows = taken.withColumn("_pl_words", F.explode(F.concat(F.array_repeat(F.lit(None).cast("int"), times.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    text = F.when(F.col("_pl_words").isNull(), F.col("_pl_row")[text_col]).otherwise(F.array_join(F.slice(words(F.col("_pl_row")[text_col]), 1, F.coalesce("_pl_words", F.lit(0))), " "))
    return rows.select(*(text.alias(c) if c == text_col else F.col("_pl_row")[c].alias(c) for c in docs.columns))
