"""Confidence of findings, and their life over several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The statuses of a finding, and which may follow which by a review.
STATUSES = ("candidate", "reviewed", "confirmed", "rejected", "mitigated")
TRANSITIONS = (
    ("candidate", "reviewed"), ("candidate", "confirmed"), ("candidate", "rejected"), ("reviewed", "confirmed"), ("reviewed", "rejected"),
    ("confirmed", "mitigated"), ("confirmed", "rejected"), ("rejected", "reviewed"), ("mitigated", "reviewed"), ("retired", "reviewed"),
)
#: What a finding that a run no longer makes becomes, unless a review has closed it.
RETIRED, CLOSED = "retired", ("rejected", "mitigated")
STATE_SQL = "finding_iri string, status string, first_seen timestamp, last_seen timestamp, runs long, history array<struct<status: string, at: timestamp>>"


def leakage_confidence(leaks: DataFrame) -> DataFrame:
    """(finding_iri, confidence, n_ways) of leakage findings (finding_iri, source, result, hops): decimal(5,4).

    A way on which an exposed result reaches users over h hops is evidence of 0.8 / (h + 1); a finding's ways, one for each
    source, result and number of hops, support it independently, so that its confidence is 1 less the product of their doubts.
    It grows with sources and ways, falls with hops, and never reaches 1.
    """
    ways = leaks.select("finding_iri", "source", "result", F.explode(F.split("hops", ",")).alias("h")).distinct()
    doubt = F.exp(F.sum(F.log(F.lit(1.0) - 0.8 / (F.col("h").cast("int") + 1))))
    found = ways.groupBy("finding_iri").agg(F.least(F.round(1 - doubt, 4), F.lit(0.9999)).cast("decimal(5,4)").alias("confidence"), F.count(F.lit(1)).alias("n_ways"))
    return found


def merged(state: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """The state of all findings after a run that made the findings ``found`` (finding_iri) at the time ``at``.

    New findings are candidates; those seen again keep the status that reviews gave them, and a retired one is a candidate
    again; those of the state that the run no longer makes are retired, unless a review has closed them. Each change of status is
    added to the history. Findings are joined by their IRI, a row each: repeated ones count once, null ones are ignored.
    """
    now = F.lit(at).cast("timestamp")
    new = found.select("finding_iri").filter("finding_iri is not null").distinct().withColumn("made", F.lit(True))
    both = state.join(new, "finding_iri", "full")
    known, made = F.col("first_seen").isNotNull(), F.coalesce("made", F.lit(False))
    status = (
        F.when(~known, "candidate").when(made, F.when(F.col("status") == RETIRED, "candidate").otherwise(F.col("status")))
        .when(F.col("status").isin(*CLOSED), F.col("status")).otherwise(RETIRED)
    )
    return _changed(both.withColumn("to", status), now).select(
        "finding_iri", F.col("to").alias("status"), F.coalesce("first_seen", now).alias("first_seen"), F.when(made, now).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("runs", F.lit(0)) + made.cast("long")).cast("long").alias("runs"), "history",
    )


def reviewed(state: DataFrame, decisions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The state after the decisions (finding_iri, status), and the decisions that do not hold, with the reason.

    A decision holds if the finding exists and its status may be followed by the new one; two decisions on one finding hold neither.
    """
    pairs = state.sparkSession.createDataFrame(TRANSITIONS, "status string, to string")
    asked = decisions.select("finding_iri", F.col("status").alias("to")).distinct()
    asked = asked.join(asked.groupBy("finding_iri").agg(F.count(F.lit(1)).alias("n")), "finding_iri")
    judged = asked.join(state.select("finding_iri", "status"), "finding_iri", "left").join(F.broadcast(pairs.withColumn("may", F.lit(True))), ["status", "to"], "left")
    reason = F.when(F.col("status").isNull(), "no such finding").when(F.col("n") > 1, "several decisions").when(F.col("may").isNull(), F.concat(F.col("status"), F.lit(" may not become "), F.col("to")))
    judged = judged.withColumn("reason", reason)
    taken = judged.filter("reason is null").select("finding_iri", "to")
    after = _changed(state.join(taken, "finding_iri", "left").withColumn("to", F.coalesce("to", "status")), F.lit(at).cast("timestamp"))
    kept = after.select("finding_iri", F.col("to").alias("status"), "first_seen", "last_seen", "runs", "history")
    return kept, judged.filter("reason is not null").select("finding_iri", F.col("to").alias("status"), "reason")


def _changed(rows: DataFrame, now) -> DataFrame:
    """``history`` with the status ``to`` where it is another than ``status``."""
    entry = F.array(F.struct(F.col("to").alias("status"), now.alias("at")))
    past = F.coalesce("history", F.array().cast("array<struct<status: string, at: timestamp>>"))
    return rows.withColumn("history", F.when(F.col("status").eqNullSafe(F.col("to")), past).otherwise(F.concat(past, entry)))
