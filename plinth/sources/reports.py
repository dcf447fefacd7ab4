"""Reports from CSV, and records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.incidents import record_json, without_missing
from plinth.sources.csv_records import read_csv_records


def read_reports(spark: SparkSession, path: str, *, whole_files: bool = True) -> DataFrame:
    """All columns as text with missing-value tokens as null, and ``row_id``: the 0-based place of the row in the input.

    With ``whole_files`` each file is read by one task, in order; without, by as many as it has splits (``read_csv_records``).
    """
    if not whole_files:
        return without_missing(read_csv_records(spark, path))
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    return without_missing(numbered(raw))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of a file scan with ``row_id``, their 0-based place: partitions are counted, and each begins where the last ends.

    The driver holds one number a partition. The scan is made twice and finds the same rows in the same places.
    """
    placed = rows.withColumn("_pl_at", F.monotonically_increasing_id())
    part, inside = F.call_function("shiftright", "_pl_at", F.lit(33)), F.col("_pl_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "_pl_part long, _pl_start long")
    joined = placed.withColumn("_pl_part", part).join(F.broadcast(offsets), "_pl_part", "left")
    return joined.select(*rows.columns, (F.col("_pl_start") + inside).cast("long").alias("row_id"))


def read_text(spark: SparkSession, path: str, most_bytes: int = 1 << 24) -> str:
    """A small text, such as a taxonomy for prompts: a file, or a folder's files in the order of their paths, one below another.

    A missing path and more than ``most_bytes`` are errors; empty files add nothing.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    if (files.agg(F.sum("size")).first()[0] or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes in {path}")
    return "\n".join(row["value"] for row in files.orderBy("path").collect() if row["value"])


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, in parallel."""
    record_json(records).select("record").write.mode("overwrite").text(path)


def write_record_array(records: DataFrame, path: str) -> int:
    """One JSON array in one local file, in input order, streamed a partition at a time; returns the number of records."""
    import json

    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for row in record_json(records).orderBy("row_id").toLocalIterator():
            shown = json.dumps(json.loads(row["record"]), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write(("," if n else "") + "\n  " + shown)
            n += 1
        out.write("\n]" if n else "]")
    return n


def relevant_preview(records: DataFrame, most: int = 20) -> DataFrame:
    """The columns that a reader looks at first, of the first relevant records."""
    return records.filter("meta.is_relevant").orderBy("row_id").limit(most).select("meta.report_id", "meta.title", "system_profile.ai_task", "risk_assessment.risk_category", "risk_assessment.risk_type")


def counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("meta.is_relevant")).alias("n_relevant"))


#: Characters of a key that name its folder: 256 of them a stage.
PREFIX = 2


def append_cache(answers: DataFrame, path: str, at: str, keep_failures: bool = False) -> None:
    """Adds new answers to the cache; the newest of a key counts when it is read, so a batch run twice does no harm."""
    from plinth.operators.incidents import cache_rows

    write_cache(cache_rows(answers, at, keep_failures), path, "append")


def write_cache(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Cache rows (stage, key, value, ts), a folder for each stage and first characters of the key."""
    rows.withColumn("prefix", F.substring("key", 1, PREFIX)).write.mode(mode).partitionBy("stage", "prefix").parquet(path)


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The cache (stage, key, value, ts); a path that does not exist yet is an empty one.

    With ``keys`` (key), only the folders that hold one of them are read: their names, 256 at most, go through the driver.
    """
    schema = "stage string, key string, value string, ts timestamp, prefix string"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).drop("prefix")
    cache = spark.read.schema(schema).parquet(path)
    if keys is not None:
        wanted = [r["p"] for r in keys.select(F.substring("key", 1, PREFIX).alias("p")).filter("p is not null").distinct().limit(16**PREFIX + 1).collect()]
        # Keys are hexadecimal; other ones, of a cache of another make, are looked for everywhere.
        if len(wanted) <= 16**PREFIX:
            cache = cache.filter(F.col("prefix").isin(wanted))
    return cache.select("stage", "key", "value", "ts")


def compact_cache(spark: SparkSession, path: str, out: str) -> None:
    """The newest value of each key of the cache at ``path``, as a new cache at ``out``, a file a folder."""
    from plinth.operators.incidents import latest

    kept = latest(read_cache(spark, path)).withColumn("_pl_prefix", F.substring("key", 1, PREFIX))
    write_cache(kept.repartition("stage", "_pl_prefix").drop("_pl_prefix"), out)
