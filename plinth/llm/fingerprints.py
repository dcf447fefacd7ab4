"""Document fingerprints that subtract: invertible Bloom lookup sketches of a text's paragraphs, in column expressions.

A text is cut into paragraphs; the set of their 64-bit digests goes into a table of cells, each digest into one cell of every
third, as a count, an exclusive or of digests and one of check sums, so that a table is one aggregate. Tables of two versions
subtract cell by cell, which cancels what they share; as all of it is linear, a table of digests with signs is the
difference of the two tables. A cell with one digest left shows it; taking that digest out of its other cells shows more,
until the table is empty and all that differs is known. A table too small for the difference does not empty; it is replaced
by a larger one, which is many tables, each for the digests with the same first bits, and again by eight for each that
still fails. With 64 bits a table has one digest, so this ends, with the exact difference and no other way beside it.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import let, parts_for, settle, shuffle_width
from plinth.llm.exact_dedup import ROW_BYTES, _place, sample_splitters

#: A paragraph is a line; a long line is cut at the first sentence end, or line end, after so many characters, or after twice as
#: many. All of a text is in some paragraph.
LONG = 80
PARAGRAPH = f"[^\\n]{{1,{LONG}}}+[^.!?\\n]{{0,{LONG}}}+[.!?]{{0,20}}+\\n?+|\\n{{1,{LONG}}}+"
#: Cells of a third, as bits; digests that a table is meant for, rounds of taking out, bits by which what failed is dealt again.
CELL_BITS, MEANT, ROUNDS, MORE_BITS = 2, 2, 8, 3
THIRD, CELLS = 1 << CELL_BITS, 3 << CELL_BITS
#: The last bits of a digest check the others.
CHECK_BITS = 16
CHECK = (1 << CHECK_BITS) - 1
LOWEST = -(1 << 63)
LONGS = "array<bigint>"
#: Digests that a partition is made for, and failed tables that are broadcast at most, about 16 MB.
PART_DIGESTS, MOST_SENT = 1 << 19, 1 << 18


def _check(digest: Column) -> Column:
    """The check bits that go with the other bits of a digest."""
    return F.hash(F.call_function("shiftright", digest, F.lit(CHECK_BITS))).cast("long").bitwiseAND(F.lit(CHECK))


def _alone(n: Column, x: Column) -> Column:
    """Whether a cell has one digest left: with several, the check bits agree once in 2^16, which the last test of a table finds."""
    return (F.abs(n) == 1) & (x.bitwiseAND(F.lit(CHECK)) == _check(x))


def checked(hash_: Column) -> Column:
    """The digest of a hash: its first 48 bits and 16 that check them."""
    return hash_.bitwiseAND(F.lit(~CHECK)).bitwiseOR(_check(hash_))


def digests(text: Column) -> Column:
    """Array of the distinct digests of a text's paragraphs."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))
    return F.array_distinct(F.transform(found, checked))


def _cell(n: Column, x: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"))


def _own(digest: Column, third: int | Column, attempt: int) -> Column:
    """The cell of a third that a digest is in; by other bits of its hash at each attempt."""
    shift = CELL_BITS * (third if isinstance(third, Column) else F.lit(third)) + F.lit(CHECK_BITS + 3 * CELL_BITS * (attempt % 8))
    return F.call_function("shiftright", digest, shift.cast("int")).bitwiseAND(F.lit(THIRD - 1))


def tables(entries: DataFrame, keys: list[str], attempt: int) -> DataFrame:
    """The keys and the cells of their entries (d, sign), as columns n0, x0, n1 and on; a null d is in no cell."""
    placed = entries.select(*keys, "d", "sign", *(_own(F.col("d"), t, attempt).alias(f"p{t}") for t in range(3)))
    cells = []
    for i in range(CELLS):
        here = F.col(f"p{i // THIRD}") == i % THIRD
        of = lambda total, value: F.coalesce(total(F.when(here, F.col(value))), F.lit(0).cast("long"))  # noqa: B023, E731
        cells += [of(F.sum, "sign").alias(f"n{i}"), of(F.bit_xor, "d").alias(f"x{i}")]
    return placed.groupBy(*keys).agg(*cells)


def table() -> Column:
    """The cells of ``tables`` as one array."""
    return F.array(*(_cell(F.col(f"n{i}"), F.col(f"x{i}")) for i in range(CELLS)))


def peeled(cells: Column, attempt: int = 0) -> Column:
    """(ok, left, right): the digests that only the first and only the second version has, or not ok where some remain.

    Each round takes all digests that stand alone in a cell. Every digest is once in the first third, so what has come
    out is all when it has that third's count and digests together.
    """
    none = F.array().cast(LONGS)
    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(0).alias("go"))
    nothing = _cell(*[F.lit(0).cast("long")] * 2)
    plus = lambda acc, c: _cell(acc["n"] + c["n"], acc["x"].bitwiseXOR(c["x"]))
    minus = lambda acc, p: _cell(acc["n"] - p["n"], acc["x"].bitwiseXOR(p["x"]))

    def taken(held: Column, pure: Column) -> Column:
        def out_of(cell: Column, i: Column) -> Column:
            third, own = F.call_function("shiftright", i, F.lit(CELL_BITS)), i.bitwiseAND(THIRD - 1)
            return F.aggregate(F.filter(pure, lambda p: _own(p["x"], third, attempt) == own), cell, minus)

        return F.transform(held, out_of)

    def round_(acc: Column, _: Column) -> Column:
        def found(pure: Column) -> Column:
            of = lambda sign: F.transform(F.filter(pure, lambda p: p["n"] == sign), lambda p: p["x"])
            left, right = F.concat(acc["left"], of(1)).alias("left"), F.concat(acc["right"], of(-1)).alias("right")
            whole = F.aggregate(F.slice(acc["cells"], 1, THIRD), nothing, plus) == F.aggregate(pure, nothing, plus)
            ended = lambda go, a, b: F.struct(acc["cells"].alias("cells"), a, b, F.lit(go).alias("go"))
            return F.when(whole, ended(1, left, right)).when(F.size(pure) == 0, ended(-1, acc["left"].alias("left"), acc["right"].alias("right"))).otherwise(
                F.struct(taken(acc["cells"], pure).alias("cells"), left, right, F.lit(0).alias("go"))
            )

        pure = F.array_distinct(F.filter(acc["cells"], lambda c: _alone(c["n"], c["x"])))
        return F.when(acc["go"] == 0, let(pure, found)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: F.struct((acc["go"] == 1).alias("ok"), acc["left"].alias("left"), acc["right"].alias("right")))


def peeled_columns(attempt: int, with_digests: bool) -> Column:
    """``peeled`` of the columns of ``tables``, or the numbers of digests in place of the arrays.

    Most small tables have a third with no two digests in a cell, which shows all at once.
    """
    empty = lambda i: (F.col(f"n{i}") == 0) & (F.col(f"x{i}") == 0)
    arrays = lambda cells, sign: F.array_compact(F.array(*(F.when(F.col(f"n{i}") == sign, F.col(f"x{i}")) for i in cells)))
    numbers = lambda cells, sign: reduce(add, ((F.col(f"n{i}") == sign).cast("int") for i in cells))
    of = arrays if with_digests else numbers
    out = peeled(table(), attempt)
    out = out if with_digests else let(out, lambda p: F.struct(p["ok"].alias("ok"), F.size(p["left"]).alias("left"), F.size(p["right"]).alias("right")))
    for third in range(3):
        cells = range(third * THIRD, (third + 1) * THIRD)
        plain = reduce(and_, (empty(i) | _alone(F.col(f"n{i}"), F.col(f"x{i}")) for i in cells))
        out = F.when(plain, F.struct(F.lit(True).alias("ok"), of(cells, 1).alias("left"), of(cells, -1).alias("right"))).otherwise(out)
    return out


def _first_bits(digest: Column, bits: Column) -> Column:
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", digest, (64 - bits).cast("int")))


def differences(versions: DataFrame, base: str, others: tuple[str, ...], *, with_digests: bool = False) -> DataFrame:
    """(row, kind, n_left, n_right, and with ``with_digests`` left, right): what only ``base`` and only the other of that kind has.

    ``base`` and ``others`` are columns of arrays of distinct digests, none of them null; ``row`` names a row of ``versions``
    and ``kind`` is the place in ``others``. The first attempt is one table a pair, the second is meant for pairs that share
    nothing, and what fails then is dealt into tables by MORE_BITS bits more, until all of it has come out. Rows are dealt once
    an attempt; which of them failed is broadcast up to MOST_SENT tables, and joined where the rows are dealt beyond.
    """
    spark, attempt, done = versions.sparkSession, 0, []
    held = versions.select("row", base, *others)
    total = held.agg(F.sum(reduce(add, map(F.size, (base, *others))))).first()[0]
    width = max(shuffle_width(spark), parts_for(total, PART_DIGESTS))
    first = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("failed")) for k in range(len(others))))
    open_ = held.repartition(width, "row").withColumn("open", first)
    while True:
        of_kind = lambda k, other: F.struct(F.lit(k).alias("kind"), F.col(other).alias("b"), F.filter("open", lambda t: t["kind"] == k).alias("open"))
        todo = open_.select("row", F.col(base).alias("a"), F.explode(F.array(*(of_kind(k, other) for k, other in enumerate(others)))).alias("t")).select("row", "a", "t.*").filter(F.size("open") > 0)
        wanted = F.ceil(F.log2((F.size("a") + F.size("b") + 1) / MEANT)).cast("int") if attempt == 1 else F.lit(MORE_BITS if attempt else 0)
        bits = F.get("open", F.lit(0))["bits"]
        # One null digest goes with each pair, so that a pair without digests has a table too.
        digest = F.posexplode(F.concat("a", "b", F.array(F.lit(None).cast("long"))))
        dealt = todo.select("row", "kind", F.transform("open", lambda t: t["failed"]).alias("failed"), bits.alias("bits"), F.greatest(bits, F.least(bits + wanted, F.lit(64))).alias("to"), F.size("a").alias("n_a"), digest.alias("i", "d"))
        again = dealt.filter(F.col("d").isNull() | F.array_contains("failed", _first_bits(F.col("d"), F.col("bits")))) if attempt else dealt
        sign = F.when(F.col("i") < F.col("n_a"), 1).otherwise(-1).cast("long")
        entries = again.select("row", "kind", F.col("to").alias("bits"), F.coalesce(_first_bits(F.col("d"), F.col("to")), F.lit(-1).cast("long")).alias("first"), "d", sign.alias("sign"))
        found = tables(entries, ["row", "kind", "bits", "first"], attempt).select("row", "kind", "bits", "first", peeled_columns(attempt, with_digests).alias("p"))
        ok = F.col("p.ok")
        size = lambda side: F.when(ok, F.size(f"p.{side}") if with_digests else F.col(f"p.{side}")).otherwise(0).cast("long")  # noqa: B023, E731
        flat = lambda side: F.flatten(F.collect_list(F.when(ok, F.col(f"p.{side}")))).alias(side)  # noqa: B023, E731
        sums = [F.sum(size(side)).alias(f"n_{side}") for side in ("left", "right")] + [flat(side) for side in ("left", "right") if with_digests]
        # What came out, a row a pair, and a row for each table that failed.
        whole = settle(found.groupBy("row", "kind", "bits", F.when(~ok, F.col("first")).alias("failed")).agg(*sums), f"differences-{attempt}")
        done.append(whole.drop("bits", "failed"))
        failed = whole.filter("failed is not null")
        if not (n_failed := failed.count()):
            break
        by_row = failed.groupBy("row").agg(F.collect_list(F.struct("kind", "bits", "failed")).alias("open"))
        open_ = held.join(F.broadcast(by_row), "row").repartition(width, "row") if n_failed <= MOST_SENT else held.repartition(width, "row").join(by_row.repartition(width, "row"), "row")
        attempt += 1
    every = reduce(DataFrame.unionByName, done).groupBy("row", "kind")
    return every.agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), *([F.flatten(F.collect_list(c)).alias(c) for c in ("left", "right")] if with_digests else []))


def shown(cells: Column) -> Column:
    """A table as hexadecimal digits, 24 a cell: count and digests."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["x"]), 16, "0"))), "")


def table_in(fingerprint: Column) -> Column:
    """The table that ``shown`` has shown."""
    part = lambda i, at, n: F.conv(F.substring(fingerprint, i * 24 + at, F.lit(n)), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: _cell(part(i, 1, 8), part(i, 9, 16)))


def compared(a: Column, b: Column) -> Column:
    """(ok, left, right) of two fingerprints alone; not ok where they differ by more than such a table can tell."""
    return peeled(F.zip_with(table_in(a), table_in(b), lambda x, y: _cell(x["n"] - y["n"], x["x"].bitwiseXOR(y["x"]))))


def likeness(n_a: Column, n_left: Column, n_right: Column) -> Column:
    """Share of the paragraphs of both versions that they have in common; 1 where both have none. The first has ``n_a``."""
    return F.when(n_a + n_right == 0, 1.0).otherwise((n_a - n_left) / (n_a + n_right)).cast("double")


def with_next(docs: DataFrame, *, id_col: str, text_col: str, n_ranges: int | None = None, seed: int = 7) -> tuple[DataFrame, Window]:
    """Rows (_pl_id, _pl_text, _pl_ghost) dealt in order into ranges, one a task, and the window in which the next row is the next in order.

    Order: id, null first, then a hash of the text. The first row of each range also goes, as a ghost, to the end of the
    range before it, and that of the first range to the end of the last.
    """
    def keyed(columns: list[Column]) -> DataFrame:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        wide = F.lpad(F.hex(F.col(id_col).try_cast("long").bitwiseXOR(F.lit(LOWEST))), 16, "0")
        return docs.select(F.col(id_col).alias("_pl_id"), text.alias("_pl_text"), F.coalesce(wide, F.lit("")).alias("k"), F.xxhash64(text).alias("h"), F.lit(0).cast("long").alias("r")).select("k", "h", "r", *columns)

    narrow = settle(keyed([(F.octet_length("_pl_text") + ROW_BYTES).cast("long").alias("size")]), "fingerprint-keys")
    splitters = sample_splitters(narrow, n_ranges, 64, seed)
    range_of = _place(F.struct("k", "h", "r"), splitters)["pid"]
    firsts = sorted(tuple(r) for r in narrow.groupBy(range_of.alias("pid")).agg(F.min(F.struct("k", "h")).alias("m")).select("pid", "m.k", "m.h").collect())
    # At most a row a range, so at most MOST_RANGES of them.
    before = [(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)]
    marks = F.broadcast(docs.sparkSession.createDataFrame(before, "k string, h long, _pl_before int"))
    placed = keyed(["_pl_id", "_pl_text"]).withColumn("_pl_pid", range_of).join(marks, ["k", "h"], "left")
    own, ghost = F.struct(F.col("_pl_pid").alias("pid"), F.lit(False).alias("ghost")), F.struct(F.col("_pl_before").alias("pid"), F.lit(True).alias("ghost"))
    both = placed.withColumn("_pl_to", F.explode(F.when(F.col("_pl_before").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    dealt = both.select("_pl_id", "_pl_text", "k", "h", F.col("_pl_to.pid").alias("_pl_pid"), F.col("_pl_to.ghost").alias("_pl_ghost"))
    return dealt.repartitionById(len(splitters) + 1, F.col("_pl_pid")), Window.partitionBy("_pl_pid").orderBy("_pl_ghost", "k", "h")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many paragraphs the edit removed and added.

    The edited text of a row has its last floor(n_chars / 4) code points replaced by the first as many of the next row's
    text, or all of it. Rows are in order of their ids as 64-bit integers, null and what is no such number first, then of a
    hash of the text; after the last comes the first, which is its own next where there is one row. Likeness is the share of
    distinct paragraphs that two texts have in common. A null text is empty and has no paragraph; equal texts have equal
    fingerprints and likeness 1; very long texts are fingerprinted whole, their digests in one task; repeated rows follow each
    other, and those of one id and text are in one range; an empty table gives an empty result; other columns are ignored.
    """
    dealt, order = with_next(docs, id_col=id_col, text_col=text_col, n_ranges=n_ranges)
    own = dealt.withColumn("_pl_own", digests(F.col("_pl_text")))
    following = own.select("*", F.lead("_pl_text").over(order).alias("_pl_after"), F.lead("_pl_own").over(order).alias("_pl_next")).filter(~F.col("_pl_ghost"))
    n = F.length("_pl_text")
    tail = F.floor(n / 4).cast("int")
    edited = following.select("_pl_id", n.cast("long").alias("n_chars"), "_pl_own", "_pl_next", F.concat(F.substring("_pl_text", F.lit(1), n - tail), F.substring("_pl_after", F.lit(1), tail)).alias("_pl_text"))
    versions = edited.select(F.monotonically_increasing_id().alias("row"), "_pl_id", "n_chars", F.sha2("_pl_text", 256).alias("edited_sha256"), F.col("_pl_own").alias("own"), digests(F.col("_pl_text")).alias("edited"), F.col("_pl_next").alias("next"))
    versions = settle(versions, "fingerprint-digests")

    kinds = ("edited", "next")
    found = differences(versions, "own", kinds)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kinds.index(kind), F.col(c))).alias(f"{kind}_{c}")
    apart = found.groupBy("row").agg(*(of(kind, c) for kind in kinds for c in ("n_left", "n_right")))

    named = ["row", "_pl_id", "n_chars", "edited_sha256", "n_own"]
    width = max(shuffle_width(docs.sparkSession), parts_for(versions.agg(F.sum(F.size("own") + F.size("edited"))).first()[0] or 0, PART_DIGESTS))
    dealt = versions.withColumn("n_own", F.size("own")).drop("next").repartition(width, "row").select(*named, F.posexplode(F.concat("own", "edited", F.array(F.lit(None).cast("long"), F.lit(None).cast("long")))).alias("i", "d"), F.size("edited").alias("n_edited"))
    # Of the two null digests at the end, the first sees to a table of the text, the second to one of the edited text.
    of_edited = (F.col("i") >= F.col("n_own")) & (F.col("i") != F.col("n_own") + F.col("n_edited"))
    entries = dealt.select(*named, of_edited.alias("v"), "d", F.lit(1).cast("long").alias("sign"))
    both = tables(entries, [*named, "v"], 0).select(*named, F.struct("v", shown(table()).alias("t")).alias("t"))
    prints = both.groupBy(*named).agg(F.min_by("t.t", "t.v").alias("fingerprint"), F.max_by("t.t", "t.v").alias("edited_fingerprint"))
    return prints.join(apart, "row").select(
        F.col("_pl_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("n_own"), F.col("edited_n_left"), F.col("edited_n_right")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("next_n_left"), F.col("next_n_right")).alias("near_next"),
        F.col("edited_n_left").alias("n_removed"), F.col("edited_n_right").alias("n_added"),
    )
