"""CSV whose quoted fields hold line ends, read by many tasks a file.

A line belongs to a quoted field if an odd number of quotes stands before it. A first pass counts quotes and records in each
file split, for either state that the split may begin in; prefix sums over the splits, a few numbers each, tell the state
and the number of the first record of each. A second pass puts the lines of each split together to records. Only what
crosses the border of two splits is moved; all other records are parsed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COUNT = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("q", pa.int64()), ("ends0", pa.int64()), ("ends1", pa.int64())])
_COUNT_SQL = "file long, block long, q long, ends0 long, ends1 long"
_PART = pa.schema([("record", pa.int64()), ("row_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("value", pa.large_string())])
_PART_SQL = "record long, row_id long, block long, whole boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines of the files, ended by a line feed alone, in the order of each split, which one partition reads."""
    return spark.read.text(path, lineSep="\n").select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block"), "value")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(file, block, lines, quotes of each, whether each is blank) of the runs of one split in a partition's batches."""
    for batch in batches:
        file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.equal(pc.binary_length(pc.utf8_trim(batch.column(2), characters=" \t\r")), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
            if a < b:
                yield int(file[a]), int(block[a]), batch.column(2).slice(a, b - a), quotes[a:b], blank[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list[int]] = {}
    for file, block, _, quotes, blank in _segments(batches):
        own = held.setdefault((file, block), [0, 0, 0])
        odd = (own[0] + np.cumsum(quotes)) % 2
        own[0] += int(quotes.sum())
        own[1] += int(((odd == 0) & ~blank).sum())
        own[2] += int(((odd == 1) & ~blank).sum())
    rows = np.array([(*k, *v) for k, v in held.items()], np.int64).reshape(-1, 5)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], schema=_COUNT)


def _starts(lines: DataFrame, paths: DataFrame) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(odd, before, headers, first) of each split: whether it begins inside quotes, how many records end before it in all
    files, how many headers there are by its end, and the number of its file's header."""
    splits = lines.mapInArrow(_count, _COUNT_SQL).groupBy("file", "block").agg(*(F.sum(c).alias(c) for c in ("q", "ends0", "ends1"))).join(paths, "file")
    of_file = Window.partitionBy("file").orderBy("block")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).withColumn("ends", F.when(F.col("odd") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    out, total, headers, first, last = {}, 0, 0, 0, None
    for r in known.select("path", "file", "block", "odd", "ends").orderBy("path", "block").toLocalIterator():
        if r["file"] != last:
            last, first, begun = r["file"], total + 1, False
        if r["ends"] and not begun:
            headers, begun = headers + 1, True
        out[r["file"], r["block"]] = (r["odd"], total, headers, first)
        total += r["ends"]
    return out


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The columns that the header of the first file names, as strings, and ``row_id``: the 0-based place of the record, files by path.

    Quotes are doubled inside quotes; fields are kept with their white space; unquoted empty fields are null; a carriage return
    before the line feed that ends a record belongs to it; blank lines outside quotes are no records; each file begins with a
    header; a file without records, and an empty input, give no row. A record is held by one task. The driver, and each
    task, holds four numbers a split of the input, about 100 MB for 100 TB.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"').columns
    if not columns:
        return spark.createDataFrame([], "row_id long")
    lines = _lines(spark, path)
    paths = spark.createDataFrame([(p,) for p in lines.inputFiles()], "path string").select("path", F.xxhash64("path").alias("file"))
    starts = spark.sparkContext.broadcast(_starts(lines, paths))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, number, offset, first, open_, begun = None, 0, 0, 0, 0, [], True
        out: list[tuple] = []

        def given() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PART, strict=True)], schema=_PART)
                out.clear()

        def left() -> None:
            if open_ and number != first:
                out.append((number, number - 1 - offset, at[1], False, "\n".join(open_)))

        for file, block, values, quotes, blank in _segments(batches):
            if (file, block) != at:
                left()
                at = (file, block)
                odd, before, offset, first = starts.value[at]
                number, open_, begun = before + 1, [], odd == 0
            after = (odd + np.cumsum(quotes)) % 2
            texts, done = values.to_pylist(), 0
            for end in np.flatnonzero(after == 0):
                if blank[end] and end == done and not open_ and (odd if end == 0 else after[end - 1]) == 0:
                    done = end + 1
                    continue
                if number != first:
                    out.append((number, number - 1 - offset, block, begun, "\n".join([*open_, *texts[done : end + 1]])))
                number, open_, begun, done = number + 1, [], True, end + 1
            open_ += texts[done:]
            odd = int(after[-1])
            yield from given()
        left()
        yield from given()

    parts = lines.mapInArrow(records, _PART_SQL)
    joined = parts.filter(~F.col("whole")).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"), F.max("row_id").alias("row_id"))
    every = parts.filter("whole").select("row_id", "value").unionByName(joined.select("row_id", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = every.select("row_id", F.from_csv(F.regexp_replace("value", "\r\\z", ""), schema, options).alias("r"))
    return parsed.select(*(F.col("r")[c].alias(c) for c in columns), "row_id")
