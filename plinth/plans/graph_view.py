"""A deterministic architecture graph, taxonomies and reports over the benchmark tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.closure import Hierarchy
from plinth.sources.graph import Graph

#: Sub-class edges of the classes that elements of the view have.
CLASS_EDGES = (("Transform", "Process"), ("Infer", "Process"), ("Data", "Resource"), ("StatisticalModel", "Model"), ("Model", "Resource"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(kind: str, *parts) -> F.Column:
    return F.concat(F.lit(kind), *(x for p in parts for x in (F.lit(":"), p.cast("string"))))


def graph_view(spark: SparkSession, sf_dir: str) -> Graph:
    """Steps are assistant turns; they use the turn before, a model, the answer before that and document stores."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    v, t = F.col("conv_id"), F.col("turn")
    said = talk.filter("role = 'assistant'").select("conv_id", "turn")
    step, text, before = _name("step", v, t), _name("text", v, t), _name("text", v, t - 1)
    llm = v % 3 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").contains("@").cast("long").alias("at"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(1))
    stores = (
        docs.join(toxic, "doc_id", "left").groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("n_at"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .withColumn("store", _name("store", F.col("source"), F.col("lang")))
    )
    earlier = said.select("conv_id", (t + 2).alias("turn"))
    with_source = said.filter(~llm | (v % 6 == 0)).withColumn("source", F.concat(F.lit("src"), (v % 20).cast("string")))
    use = (
        said.select(step.alias("s"), before.alias("o"))
        .unionByName(said.select(step.alias("s"), _name("model", v % 5).alias("o")))
        .unionByName(said.join(earlier, ["conv_id", "turn"], "left_semi").select(step.alias("s"), _name("text", v, t - 2).alias("o")))
        .unionByName(with_source.join(stores.select("source", "store"), "source").select(step.alias("s"), F.col("store").alias("o")))
    )
    produce = said.select(step.alias("s"), text.alias("o"))
    even = (v + t) % 2 == 0
    roles = F.array_compact(
        F.array(
            F.struct(step.alias("s"), F.when(llm, "LLMBasedInformationRetrievalStep").when(even, "VectorBasedRetrievalStep").otherwise("RetrievalStep").alias("o")),
            F.when(even | (t >= 4), F.struct(step.alias("s"), F.lit("GenerationStep").alias("o"))),
            F.when(~llm, F.struct(text.alias("s"), F.when(t % 4 == 1, "RetrievedResult").otherwise("RetrievedContext").alias("o"))),
            F.when(llm | ((v + t) % 5 == 0), F.struct(text.alias("s"), F.lit("UserFacingOutput").alias("o"))),
        )
    )
    plays = (
        said.select(F.explode(roles).alias("r")).select("r.*")
        .unionByName(talk.filter("role in ('user', 'system')").select(text.alias("s"), F.when(F.col("role") == "user", "UserInput").otherwise("SystemPrompt").alias("o")))
        .unionByName(said.select(_name("model", v % 5).alias("s"), F.lit("GenerativeModel").alias("o")).distinct())
        .unionByName(stores.select(F.col("store").alias("s"), F.lit("VectorStore").alias("o")))
    )
    held = F.array_compact(F.array(F.lit("Information"), F.when(F.col("toxic") == 1, "UntrustedContent"), F.when(100 * F.col("n_at") >= 3 * F.col("n"), "PersonalInformation")))
    contains = stores.select(F.col("store").alias("s"), F.explode(held).alias("o"))
    types = (
        said.select(step.alias("s"), F.when(llm, "Infer").otherwise("Transform").alias("o"))
        .unionByName(talk.filter("conv_id % 7 <> 0").select(text.alias("s"), F.lit("Data").alias("o")))
        .unionByName(said.select(_name("model", v % 5).alias("s"), F.lit("StatisticalModel").alias("o")).distinct())
        .unionByName(stores.select(F.col("store").alias("s"), F.lit("Data").alias("o")))
    )
    inform = produce.select(F.col("o").alias("x"), F.col("s").alias("from")).join(use.select(F.col("o").alias("x"), F.col("s").alias("to")), "x").select(F.col("from").alias("s"), F.col("to").alias("o")).distinct()
    return Graph(use=use, produce=produce, plays=plays, contains=contains, inform=inform, types=types, classes=Hierarchy(CLASS_EDGES))


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: first line as title, second as description, the page of the same number as url."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return docs.select("doc_id", F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(1)).alias("description"), "text", "source").join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("report_id"), "title", "description", "text", F.col("source").alias("source_domain"), "url"
    )


def controls_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(risk, control): customer nations as risks, with the brands they order in quantity as controls."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("risk"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("control"))
    joined = items.join(parts, "l_partkey").join(orders.join(customers, "c_custkey"), "l_orderkey")
    return _frequent(joined)


def controls_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(risk, control): the same of the nations whose suppliers deliver the brand."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("risk"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("control"))
    return _frequent(items.join(parts, "l_partkey").join(suppliers, "l_suppkey"))


def _frequent(pairs: DataFrame) -> DataFrame:
    """Pairs that occur at least as often as the average pair of the risk."""
    counted = pairs.groupBy("risk", "control").agg(F.count(F.lit(1)).alias("n"))
    means = counted.groupBy("risk").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    return counted.join(means, "risk").filter(F.col("n") * F.col("kinds") >= F.col("all")).select("risk", "control")


_ROLE_SQL = "('LLMBasedInformationRetrievalStep')"
GRAPH_SQL = """
said AS (SELECT conv_id v, turn t FROM conversations WHERE role = 'assistant'),
stores AS (
  SELECT d.source, d.lang, 'store:' || d.source || ':' || d.lang AS store, count(*) n, sum(CASE WHEN contains(d.text, '@') THEN 1 ELSE 0 END) n_at,
         max(CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END) toxic
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) x ON x.doc_id = d.doc_id GROUP BY d.source, d.lang),
use_edge AS (
  SELECT 'step:' || v || ':' || t s, 'text:' || v || ':' || (t - 1) o FROM said
  UNION ALL SELECT 'step:' || v || ':' || t, 'model:' || (v % 5) FROM said
  UNION ALL SELECT 'step:' || a.v || ':' || a.t, 'text:' || a.v || ':' || (a.t - 2) FROM said a JOIN said b ON b.v = a.v AND b.t = a.t - 2
  UNION ALL SELECT 'step:' || v || ':' || t, store FROM said JOIN stores ON source = 'src' || (v % 20) WHERE v % 3 <> 0 OR v % 6 = 0),
produce_edge AS (SELECT 'step:' || v || ':' || t s, 'text:' || v || ':' || t o FROM said),
plays AS (
  SELECT 'step:' || v || ':' || t s, CASE WHEN v % 3 = 0 THEN 'LLMBasedInformationRetrievalStep' WHEN (v + t) % 2 = 0 THEN 'VectorBasedRetrievalStep' ELSE 'RetrievalStep' END o FROM said
  UNION ALL SELECT 'step:' || v || ':' || t, 'GenerationStep' FROM said WHERE (v + t) % 2 = 0 OR t >= 4
  UNION ALL SELECT 'text:' || v || ':' || t, CASE WHEN t % 4 = 1 THEN 'RetrievedResult' ELSE 'RetrievedContext' END FROM said WHERE v % 3 <> 0
  UNION ALL SELECT 'text:' || v || ':' || t, 'UserFacingOutput' FROM said WHERE v % 3 = 0 OR (v + t) % 5 = 0
  UNION ALL SELECT 'text:' || conv_id || ':' || turn, CASE WHEN role = 'user' THEN 'UserInput' ELSE 'SystemPrompt' END FROM conversations WHERE role IN ('user', 'system')
  UNION ALL SELECT DISTINCT 'model:' || (v % 5), 'GenerativeModel' FROM said
  UNION ALL SELECT store, 'VectorStore' FROM stores),
contains_edge AS (
  SELECT store s, 'Information' o FROM stores UNION ALL SELECT store, 'UntrustedContent' FROM stores WHERE toxic = 1
  UNION ALL SELECT store, 'PersonalInformation' FROM stores WHERE 100 * n_at >= 3 * n),
types AS (
  SELECT 'step:' || v || ':' || t s, CASE WHEN v % 3 = 0 THEN 'Infer' ELSE 'Transform' END o FROM said
  UNION ALL SELECT 'text:' || conv_id || ':' || turn, 'Data' FROM conversations WHERE conv_id % 7 <> 0
  UNION ALL SELECT DISTINCT 'model:' || (v % 5), 'StatisticalModel' FROM said UNION ALL SELECT store, 'Data' FROM stores)
"""


def _values(edges) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in edges)


def hierarchy_sql(name: str, edges) -> str:
    """CTEs ``<name>_edge`` and the reflexive closure ``<name>_closure`` (sub, super)."""
    return f"""
{name}_edge(sub, super) AS (VALUES {_values(edges)}),
{name}_closure(sub, super) AS (
  SELECT sub, sub FROM {name}_edge UNION SELECT super, super FROM {name}_edge UNION SELECT c.sub, e.super FROM {name}_closure c JOIN {name}_edge e ON e.sub = c.super)"""
