"""Helpers that several operators share: words, shared storage, sizes."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the six ASCII white-space characters; what lies between is a word.
SPACES = r"[ \t-\r]+"
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def solid_chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.translate(text, WHITE, "")).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or where it is unset one of our own, which only a local master may have."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="plinth-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that ``settle`` has written and nothing has dropped.
SETTLED: list[str] = []


def drop_settled(spark: SparkSession) -> None:
    """Deletes what ``settle`` has written so far; for when no DataFrame of this subpackage will be read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while SETTLED:
        path = hadoop.Path(SETTLED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    SETTLED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint of a narrow table in the shared folder: like ``settle``, for rounds of a loop, with a file a partition and
    none besides."""
    context, folder = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def parts_for(total: int, each: int, least: int = 1) -> int:
    """Number of parts of about ``each`` units that ``total`` units need."""
    return max(least, math.ceil((total or 0) / each))
