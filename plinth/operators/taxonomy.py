"""Taxonomies: concept tables, hierarchy rollups, mappings between schemes and control crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_counts(members: DataFrame, ancestors: DataFrame, value: str | None = None) -> DataFrame:
    """(concept, n_members): rows of (concept[, value]) counted at each concept and at each of its ancestors (sub, super).

    Members are counted by their own concept first, so only one row a concept meets the hierarchy.
    """
    own = members.groupBy(F.col("concept").alias("sub")).agg((F.sum(value) if value else F.count(F.lit(1))).alias("n"))
    return own.join(ancestors, "sub").groupBy(F.col("super").alias("concept")).agg(F.sum("n").alias("n_members"))


def symmetric(mapping: DataFrame) -> DataFrame:
    """(src, rel, dst) in both directions, as a set."""
    return mapping.select("src", "rel", "dst").unionByName(mapping.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))).distinct()


def crosswalk(mapping: DataFrame, related_control: DataFrame) -> DataFrame:
    """(risk, control, via): controls related to a risk itself ('own') or to one it is mapped to (the mapping's rel)."""
    own = related_control.select("risk", "control", F.lit("own").alias("via"))
    mapped = symmetric(mapping).select(F.col("src").alias("other"), F.col("dst").alias("risk"), F.col("rel").alias("via"))
    far = mapped.join(related_control.withColumnRenamed("risk", "other"), "other").select("risk", "control", "via")
    return own.unionByName(far).distinct()


def asymmetry(related_control: DataFrame, mitigates: DataFrame) -> DataFrame:
    """(risk, control, side): links that stand in one direction only; side is 'forward' or 'reverse'."""
    a = related_control.select("risk", "control").distinct().withColumn("f", F.lit(True))
    b = mitigates.select("risk", "control").distinct().withColumn("r", F.lit(True))
    both = a.join(b, ["risk", "control"], "full_outer").filter("f is null or r is null")
    return both.select("risk", "control", F.when(F.col("r").isNull(), "forward").otherwise("reverse").alias("side"))


def enriched(findings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Findings (finding_iri, taxonomy[]) with a row an entry and its label where the entry is defined."""
    entries = findings.select("finding_iri", F.explode("taxonomy").alias("entry"))
    return entries.join(concepts.select(F.col("iri").alias("entry"), F.col("pref_label").alias("entry_label")), "entry", "left")


def dangling(references: DataFrame, concepts: DataFrame) -> DataFrame:
    """(iri, n_references): referenced concepts that no table defines."""
    return references.join(concepts.select("iri"), "iri", "left_anti").groupBy("iri").agg(F.count(F.lit(1)).alias("n_references"))
