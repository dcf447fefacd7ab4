"""Incremental intake of reports: stateless up to the prefilter, one report id once, the model a batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plinth.functions.storage import written
from plinth.operators import incidents
from plinth.sources.reports import append_cache, read_cache


def report_stream(spark: SparkSession, path: str, schema: StructType, delay: str = "1 hour", files_per_batch: int = 50) -> DataFrame:
    """Normalised reports of a folder of JSON files; an id that comes again within ``delay`` is dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    seen = incidents.normalised(raw.withColumn("row_id", F.xxhash64(*raw.columns))).withColumn("arrived", F.current_timestamp())
    return seen.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["report_id"]).drop("arrived")


def run_stream(reports: DataFrame, client: Callable[[], incidents.Client], out: str, checkpoint: str, terms: tuple[str, ...] = incidents.RETRIEVAL_HINTS, once: bool = True, cache: str | None = None) -> StreamingQuery:
    """Gate, extract and append records as Parquet; a batch that is run again writes the same folder again.

    With ``cache``, the path of one, answers are looked up and added there after each of the two stages, so that a batch
    that is run again asks the model only for what it had not got.
    """

    def batch(df: DataFrame, number: int) -> None:
        if cache is None:
            gated = incidents.relevance_gate(df, client, terms=terms)
            incidents.extract(gated, client).write.mode("overwrite").parquet(f"{out}/batch={number}")
            return

        def kept(answered: DataFrame) -> DataFrame:
            done = written(answered, "stream-answers")
            append_cache(done.filter("answer is not null").select("answer.*"), cache, datetime.now(timezone.utc).isoformat())
            return done.drop("answer")

        known = lambda: read_cache(df.sparkSession, cache)
        gated = kept(incidents.relevance_gate(df, client, terms=terms, cache=known(), answer_out="answer"))
        kept(incidents.extract(gated, client, cache=known(), answer_out="answer")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reports.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
