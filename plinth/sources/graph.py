"""The graph as one relation for each predicate, and as triples."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.storage import written
from plinth.operators.closure import Hierarchy
from plinth.plans.vocabulary import CATEGORY_EDGES, ROLE_EDGES, TYPE, Vocabulary

TRIPLES_SQL = "g string, s string, s_kind string, p string, o string, o_kind string, lang string, dt string"
TERMS = ["s", "s_kind", "p", "o", "o_kind", "lang", "dt"]


@dataclass
class Graph:
    """``use``, ``produce``, ``plays``, ``contains``, ``inform`` and ``types`` are (s, o); roles, categories and classes close over the last two."""

    use: DataFrame
    produce: DataFrame
    plays: DataFrame
    contains: DataFrame
    inform: DataFrame | None = None
    types: DataFrame | None = None
    roles: Hierarchy = field(default_factory=lambda: Hierarchy(ROLE_EDGES))
    categories: Hierarchy = field(default_factory=lambda: Hierarchy(CATEGORY_EDGES))
    classes: Hierarchy = field(default_factory=lambda: Hierarchy(()))
    #: Put before the local names of roles, categories and classes.
    role_base: str = ""
    class_base: str = ""

    def written(self, *names: str) -> "Graph":
        """The graph with these relations as written tables, each computed once, for plans that read them many times."""
        return replace(self, **{name: written(getattr(self, name), f"graph-{name}") for name in names or ("use", "produce", "plays")})

    def with_role(self, role: str) -> DataFrame:
        """(s): elements that play ``role`` or one under it."""
        return self.plays.filter(self.roles.under(F.col("o"), self.role_base + role)).select("s").distinct()

    def with_category(self, category: str) -> DataFrame:
        return self.contains.filter(self.categories.under(F.col("o"), self.role_base + category)).select("s").distinct()

    def with_class(self, name: str) -> DataFrame:
        return self.types.filter(self.classes.under(F.col("o"), self.class_base + name)).select("s").distinct()


def edges(triples: DataFrame, predicate: str) -> DataFrame:
    """(s, o) of one predicate; the filter prunes to one directory of a partitioned store."""
    return triples.filter(F.col("p") == predicate).select("s", "o").distinct()


def graph_of(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> Graph:
    """The graph in a triple table; hierarchies are read from it, by name, and have to be of vocabulary size."""
    hierarchy = lambda predicate: Hierarchy.of(edges(triples, predicate).toDF("sub", "super"))
    core, rp = vocabulary.c, vocabulary.p
    return Graph(
        use=edges(triples, core("use")), produce=edges(triples, core("produce")), plays=edges(triples, rp("playsRole")),
        contains=edges(triples, rp("containsDataCategory")), inform=edges(triples, core("inform")), types=edges(triples, TYPE),
        roles=hierarchy(rp("subRoleOf")), categories=hierarchy(rp("subDataCategoryOf")), classes=hierarchy("http://www.w3.org/2000/01/rdf-schema#subClassOf"),
        role_base=vocabulary.pattern, class_base=vocabulary.core,
    )


def merged(*graphs: DataFrame) -> DataFrame:
    """Union of triple tables with set semantics."""
    out = graphs[0]
    for other in graphs[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates()


def inverse(relation: DataFrame) -> DataFrame:
    """(s, o) of the inverse property."""
    return relation.select(F.col("o").alias("s"), F.col("s").alias("o"))


def with_superproperties(triples: DataFrame, properties: Hierarchy) -> DataFrame:
    """Triples and those that follow from sub-properties; the closure is a constant of the plan."""
    spark = triples.sparkSession
    up = properties.pairs(spark, reflexive=False).select(F.col("sub").alias("p"), F.col("super"))
    entailed = triples.join(up, "p").withColumn("p", F.col("super")).select(*triples.columns)
    return triples.unionByName(entailed).dropDuplicates()


def write_triples(triples: DataFrame, path: str) -> None:
    """Parquet, one directory for each graph and predicate."""
    triples.write.partitionBy("g", "p").mode("overwrite").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[c.split()[0] for c in TRIPLES_SQL.split(", ")])
