"""Registered queries over the benchmark tables, and the same in SQL."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.storage import shared_dir, written
from plinth.functions.text import cache_key, encode_for_uri
from plinth.operators import implementations, incidents, library, lifecycle, motifs, patterns, risk, taxonomy
from plinth.operators.closure import Hierarchy, closure, closure_of_chains, reach
from plinth.plans import graph_view as gv
from plinth.plans.vocabulary import CATEGORY_EDGES, ROLE_EDGES, TYPE, Vocabulary
from plinth.sources import graph as graphs
from plinth.sources import star_store, turtle
from plinth.sources.reports import counts, read_reports, relevant_preview, write_records
from plinth.streaming import reports as streaming

V = Vocabulary()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


ROLE_SQL, CATEGORY_SQL, CLASS_SQL = gv.hierarchy_sql("role", ROLE_EDGES), gv.hierarchy_sql("category", CATEGORY_EDGES), gv.hierarchy_sql("class", gv.CLASS_EDGES)


def _with_role(role: str) -> str:
    return f"SELECT p.s FROM plays p JOIN role_closure c ON c.sub = p.o AND c.super = '{role}' UNION SELECT s FROM plays WHERE o = '{role}'"


def _solutions_sql(motif: motifs.Motif, strict: bool = False) -> str:
    def elements(node: motifs.Node) -> str:
        found = f"SELECT s FROM ({_with_role(node.role)})"
        return found + (f" WHERE s IN (SELECT t.s FROM types t JOIN class_closure c ON c.sub = t.o AND c.super = '{node.expected_class}')" if strict else "")

    step, query_, source, result = motif.nodes
    return f"""SELECT DISTINCT '{motif.name}' AS motif, a.s AS step, a.o AS query, b.o AS source, r.o AS result
      FROM use_edge a JOIN use_edge b ON b.s = a.s JOIN produce_edge r ON r.s = a.s
      WHERE a.s IN ({elements(step)}) AND a.o IN ({elements(query_)}) AND b.o IN ({elements(source)}) AND r.o IN ({elements(result)})"""


BASE_SQL = f"WITH RECURSIVE {gv.GRAPH_SQL}, {ROLE_SQL}, {CATEGORY_SQL}, {CLASS_SQL}"
MATCHED_SQL = f"{BASE_SQL}, vector AS ({_solutions_sql(motifs.VECTOR_IR)}), llm AS ({_solutions_sql(motifs.LLM_IR)})"
_match = lambda m: f"'{V.generated}motif-match/' || url_encode(step) || '{m.suffix}'"
_found = lambda i: f"'{V.generated}risk-finding/' || url_encode({_match(i.motif)}) || '{i.suffix}'"
EXPOSED_SQL = f"""
facing AS ({_with_role('UserFacingOutput')}), generation AS ({_with_role('GenerationStep')}),
hop1 AS (SELECT DISTINCT u.o s FROM use_edge u JOIN produce_edge p ON p.s = u.s WHERE p.o IN (SELECT s FROM facing) AND u.s IN (SELECT s FROM generation)),
hop2 AS (SELECT DISTINCT u.o s FROM use_edge u JOIN produce_edge p ON p.s = u.s WHERE p.o IN (SELECT s FROM hop1)),
exposed AS (SELECT s, 0 hops FROM facing UNION SELECT s, 1 FROM hop1 UNION SELECT s, 2 FROM hop2)"""
LEAKAGE_SQL = f"""{MATCHED_SQL}, {EXPOSED_SQL},
sensitive AS (SELECT s FROM contains_edge k JOIN category_closure c ON c.sub = k.o AND c.super = 'SensitiveInformation'),
leak AS (
  SELECT {_found(risk.LEAKAGE)} AS finding_iri, {_match(motifs.VECTOR_IR)} AS match_iri, step, source, result, string_agg(DISTINCT CAST(hops AS VARCHAR), ',' ORDER BY CAST(hops AS VARCHAR)) AS hops
  FROM (SELECT DISTINCT step, source FROM vector) JOIN (SELECT DISTINCT step, result FROM vector) USING (step) JOIN exposed e ON e.s = result
  WHERE source IN (SELECT s FROM sensitive) GROUP BY step, source, result)"""
CONFAB_SQL = f"""{LEAKAGE_SQL},
confab AS (
  SELECT {_found(risk.CONFABULATION)} AS finding_iri, {_match(motifs.LLM_IR)} AS match_iri, step, query, result
  FROM (SELECT DISTINCT step, query FROM llm) JOIN (SELECT DISTINCT step, result FROM llm) USING (step)
  WHERE NOT EXISTS (SELECT 1 FROM use_edge u WHERE u.s = step AND u.o IN ({_with_role('KnowledgeSource')})))"""


@query(f"{BASE_SQL} SELECT sub, super, count(DISTINCT s) AS n_elements FROM plays JOIN (SELECT sub, super FROM role_closure UNION SELECT o, o FROM plays) ON sub = o GROUP BY sub, super")
def role_closure(spark, sf_dir):
    """The roles that elements play, with all above them and the number of their elements."""
    g = gv.graph_view(spark, sf_dir)
    return _counted(g.plays, implementations.reflexive(g.roles, g.plays))


@query(f"{BASE_SQL} SELECT sub, super, count(DISTINCT s) AS n_elements FROM contains_edge JOIN (SELECT sub, super FROM category_closure UNION SELECT o, o FROM contains_edge) ON sub = o GROUP BY sub, super")
def category_closure(spark, sf_dir):
    """The categories that stores hold, with all above them and the number of their stores."""
    g = gv.graph_view(spark, sf_dir)
    return _counted(g.contains, implementations.reflexive(g.categories, g.contains))


def _counted(relation, closed):
    held = relation.groupBy(F.col("o").alias("sub")).agg(F.count_distinct("s").alias("n_elements"))
    return held.join(closed, "sub").select("sub", "super", "n_elements")


def _places(spark, sf_dir):
    read = lambda name: gv.table(spark, sf_dir, name)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return (
        read("customer").select(name("c", "c_custkey").alias("sub"), name("n", "c_nationkey").alias("super"))
        .unionByName(read("nation").select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("super")))
        .unionByName(read("region").select(name("r", "r_regionkey").alias("sub"), F.lit("world").alias("super")))
    )


PLACE_SQL = """WITH RECURSIVE edge(sub, super) AS (
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
walk(sub, super, hops) AS (SELECT sub, super, 1 FROM edge UNION SELECT w.sub, e.super, w.hops + 1 FROM walk w JOIN edge e ON e.sub = w.super)"""


@query(f"{PLACE_SQL} SELECT sub, super, CAST(hops AS BIGINT) AS hops FROM walk UNION SELECT sub, sub, 0 FROM edge UNION SELECT super, super, 0 FROM edge")
def geo_closure(spark, sf_dir):
    return closure(_places(spark, sf_dir)).withColumn("hops", F.col("hops").cast("long"))


@query("""WITH RECURSIVE edge AS (SELECT * FROM (SELECT event_id sub, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) super FROM events) WHERE super IS NOT NULL),
walk(sub, super, hops) AS (SELECT sub, super, 1 FROM edge UNION SELECT w.sub, e.super, w.hops + 1 FROM walk w JOIN edge e ON e.sub = w.super)
SELECT sub, super, CAST(hops AS BIGINT) AS hops FROM walk""")
def inform_reachability(spark, sf_dir):
    """Events and the later ones of their user, over the edges from each event to the user's next."""
    return closure_of_chains(gv.table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_id").withColumn("hops", F.col("hops").cast("long"))


@query(f"""{BASE_SQL}, inform AS (SELECT DISTINCT p.s AS a, u.s AS b FROM produce_edge p JOIN use_edge u ON u.o = p.o),
both_ways AS (SELECT a, b FROM inform WHERE a <> b UNION SELECT b, a FROM inform WHERE a <> b),
walk(sub, super) AS (SELECT a, b FROM both_ways UNION SELECT w.sub, e.b FROM walk w JOIN both_ways e ON e.a = w.super)
SELECT DISTINCT sub, super FROM walk WHERE sub <> super""")
def inform_cyclic_closure(spark, sf_dir):
    """Steps that inform each other in either direction, closed over cycles."""
    inform = gv.graph_view(spark, sf_dir).inform
    both = inform.unionByName(graphs.inverse(inform)).toDF("sub", "super")
    return closure(both, reflexive=False).select("sub", "super")


@query(f"{MATCHED_SQL} SELECT * FROM vector")
def motif_vector_ir_solutions(spark, sf_dir):
    return motifs.solutions(gv.graph_view(spark, sf_dir), motifs.VECTOR_IR).select("motif", "step", "query", "source", "result")


@query(f"{MATCHED_SQL} SELECT * FROM llm")
def motif_llm_ir_solutions(spark, sf_dir):
    return motifs.solutions(gv.graph_view(spark, sf_dir), motifs.LLM_IR).select("motif", "step", "query", "source", "result")


@query(f"{BASE_SQL} {_solutions_sql(motifs.VECTOR_IR, True)} UNION {_solutions_sql(motifs.LLM_IR, True)}")
def strict_class_matches(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    return motifs.solutions(g, motifs.VECTOR_IR, True).unionByName(motifs.solutions(g, motifs.LLM_IR, True)).select("motif", "step", "query", "source", "result")


@query(f"{MATCHED_SQL} SELECT * FROM vector UNION ALL SELECT * FROM llm")
def star_store_solutions(spark, sf_dir):
    """Solutions of both motifs from the store that is bucketed by subject, where star joins move nothing."""
    g = _graph(spark, sf_dir)
    store = spark.table(star_store.write_stars(g))
    found = [star_store.star_solutions(store, g, m) for m in motifs.MOTIFS]
    return found[0].unionByName(found[1]).select("motif", "step", "query", "source", "result")


def _bindings_sql(m: motifs.Motif, rows: str) -> str:
    return " UNION ".join(
        f"SELECT {_match(m)} AS match_iri, '{m.name}' AS motif, {_match(m)} || '/binding/{motifs.BINDING_PATHS[n.column]}' AS binding_iri, '{V.pat(n.pattern)}' AS pattern_node, '{n.column}' AS node, {n.column} AS element FROM {rows}"
        for n in m.nodes
    )


BINDINGS_SQL = f"{MATCHED_SQL}, bound AS ({_bindings_sql(motifs.VECTOR_IR, 'vector')} UNION {_bindings_sql(motifs.LLM_IR, 'llm')})"


def _graph(spark, sf_dir):
    """The graph view with the relations that motifs and findings read again and again as written tables."""
    return gv.graph_view(spark, sf_dir).written("use", "produce", "plays", "contains")


def _matched(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g, [(m, motifs.solutions(g, m)) for m in motifs.MOTIFS]


@query(f"{BINDINGS_SQL} SELECT * FROM bound")
def motif_bindings(spark, sf_dir):
    _, found = _matched(spark, sf_dir)
    (a, x), (b, y) = found
    return motifs.bindings(x, a).unionByName(motifs.bindings(y, b))


@query(f"""{BINDINGS_SQL}
SELECT match_iri AS s, '{TYPE}' AS p, '{V.p('MotifMatch')}' AS o FROM bound
UNION SELECT match_iri, 'http://www.w3.org/2000/01/rdf-schema#label', CASE motif WHEN '{motifs.VECTOR_IR.name}' THEN '{motifs.VECTOR_IR.label}' ELSE '{motifs.LLM_IR.label}' END FROM bound
UNION SELECT match_iri, '{V.p('matchesMotif')}', '{V.catalogue}' || motif FROM bound
UNION SELECT match_iri, '{V.p('hasNodeBinding')}', binding_iri FROM bound
UNION SELECT binding_iri, '{TYPE}', '{V.p('NodeBinding')}' FROM bound
UNION SELECT binding_iri, '{V.p('bindsPatternNode')}', pattern_node FROM bound
UNION SELECT binding_iri, '{V.p('matchedElement')}', element FROM bound""")
def motif_match_triples(spark, sf_dir):
    _, found = _matched(spark, sf_dir)
    (a, x), (b, y) = found
    return motifs.match_triples(x, a).unionByName(motifs.match_triples(y, b))


@query(f"""{MATCHED_SQL}, every_ AS (SELECT * FROM vector UNION ALL SELECT * FROM llm)
SELECT step, 'use' AS p, query AS o FROM every_ UNION SELECT step, 'use', source FROM every_ UNION SELECT step, 'produce', result FROM every_""")
def evidence_subgraph(spark, sf_dir):
    g, ((_, x), (_, y)) = _matched(spark, sf_dir)
    return motifs.evidence_edges(g, x.unionByName(y))


def _leakage(spark, sf_dir, graph=None):
    g = graph or _graph(spark, sf_dir)
    return risk.leakage(g, written(motifs.solutions(g, motifs.VECTOR_IR), "solutions"))


def _confabulation(spark, sf_dir, graph=None):
    g = graph or _graph(spark, sf_dir)
    return risk.confabulation(g, written(motifs.solutions(g, motifs.LLM_IR), "solutions"))


@query(f"{LEAKAGE_SQL} SELECT * FROM leak")
def finding_leakage(spark, sf_dir):
    return _leakage(spark, sf_dir)


@query(f"{CONFAB_SQL} SELECT * FROM confab")
def finding_confabulation(spark, sf_dir):
    return _confabulation(spark, sf_dir)


@query(f"{LEAKAGE_SQL} SELECT s, CAST(hops AS BIGINT) AS hops FROM exposed")
def flow_exposure(spark, sf_dir):
    return risk.exposed(_graph(spark, sf_dir)).distinct().withColumn("hops", F.col("hops").cast("long"))


def _finding_triples_sql(i: risk.Interpretation, rows: str) -> str:
    one = {TYPE: V.p("RiskFinding"), "http://www.w3.org/2000/01/rdf-schema#label": i.label, "http://purl.org/dc/terms/description": i.description, V.p("generatedByMotif"): V.pat(i.motif.name), V.p("hasInterpretedMechanism"): V.pat(i.mechanism), V.p("findingStatus"): "candidate"}
    parts = [f"SELECT finding_iri AS s, '{p}' AS p, '{o}' AS o FROM {rows}" for p, o in one.items()]
    parts += [f"SELECT finding_iri, '{V.p('generatedFromMatch')}', match_iri FROM {rows}"]
    parts += [f"SELECT finding_iri, '{V.p('hasEvidenceElement')}', {c} FROM {rows}" for c in i.evidence]
    parts += [f"SELECT finding_iri, '{V.p(p)}', '{V.entry(e)}' FROM {rows}" for p, es in (("hasCandidateRiskTaxonomyEntry", i.taxonomy), ("hasSuggestedControl", i.controls)) for e in es]
    return " UNION ".join(parts)


@query(f"{CONFAB_SQL} {_finding_triples_sql(risk.LEAKAGE, 'leak')} UNION {_finding_triples_sql(risk.CONFABULATION, 'confab')}")
def finding_triples(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return risk.finding_triples(_leakage(spark, sf_dir, g), risk.LEAKAGE).unionByName(risk.finding_triples(_confabulation(spark, sf_dir, g), risk.CONFABULATION))


def _records(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return risk.finding_records(_leakage(spark, sf_dir, g), risk.LEAKAGE).unionByName(risk.finding_records(_confabulation(spark, sf_dir, g), risk.CONFABULATION))


def _records_sql(i: risk.Interpretation, rows: str) -> str:
    evidence = " UNION ".join(f"SELECT finding_iri, match_iri, {c} AS e FROM {rows}" for c in i.evidence)
    joined = lambda es: "|".join(sorted(V.entry(e) for e in es))
    return f"""SELECT finding_iri, match_iri, '{V.pat(i.motif.name)}' AS motif, '{V.pat(i.mechanism)}' AS mechanism, string_agg(e, '|' ORDER BY e) AS evidence,
      '{joined(i.taxonomy)}' AS taxonomy, '{joined(i.controls)}' AS controls, 'candidate' AS status FROM ({evidence}) GROUP BY finding_iri, match_iri"""


@query(f"{CONFAB_SQL} {_records_sql(risk.LEAKAGE, 'leak')} UNION ALL {_records_sql(risk.CONFABULATION, 'confab')}")
def finding_records(spark, sf_dir):
    flat = lambda c: F.array_join(c, "|").alias(c)
    return _records(spark, sf_dir).select("finding_iri", "match_iri", "motif", "mechanism", flat("evidence"), flat("taxonomy"), flat("controls"), "status")


#: The taxonomy entries, of those that findings refer to, that the taxonomies define.
DEFINED = (("atlas:exposing-personal-information", "Exposing personal information"), ("owasp:llm02-sensitive-information-disclosure", "Sensitive information disclosure"), ("atlas:hallucination", "Hallucination"))
CONCEPT_SQL = "concept(iri, pref_label) AS (VALUES " + ", ".join(f"('{V.entry(e)}', '{label}')" for e, label in DEFINED) + ")"


def _concepts(spark):
    return spark.createDataFrame([(V.entry(e), label) for e, label in DEFINED], "iri string, pref_label string")


def _entries_sql(field: str) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT finding_iri, '{V.entry(e)}' AS entry FROM {rows}" for i, rows in ((risk.LEAKAGE, "leak"), (risk.CONFABULATION, "confab")) for e in getattr(i, field))


@query(f"{CONFAB_SQL}, {CONCEPT_SQL}, entries AS ({_entries_sql('taxonomy')}) SELECT finding_iri, entry, pref_label AS entry_label FROM entries LEFT JOIN concept ON iri = entry")
def finding_enrichment(spark, sf_dir):
    return taxonomy.enriched(_records(spark, sf_dir), _concepts(spark)).select("finding_iri", "entry", "entry_label")


@query(f"{CONFAB_SQL}, {CONCEPT_SQL}, entries AS ({_entries_sql('taxonomy')} UNION ALL {_entries_sql('controls')}) SELECT entry AS iri, count(*) AS n_references FROM entries WHERE entry NOT IN (SELECT iri FROM concept) GROUP BY entry")
def dangling_refs(spark, sf_dir):
    entries = _records(spark, sf_dir).select(F.explode(F.concat("taxonomy", "controls")).alias("iri"))
    return taxonomy.dangling(entries, _concepts(spark))


@query(f"{CONFAB_SQL}, entries AS ({_entries_sql('taxonomy')}) SELECT entry, count(*) AS n_findings FROM entries GROUP BY entry")
def findings_by_taxonomy(spark, sf_dir):
    return _records(spark, sf_dir).select(F.explode("taxonomy").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n_findings"))


@query(f"{PLACE_SQL}, up AS (SELECT sub, super FROM walk UNION SELECT sub, sub FROM edge UNION SELECT super, super FROM edge) SELECT super AS concept, CAST(count(*) AS BIGINT) AS n_members FROM orders JOIN up ON sub = 'c' || o_custkey GROUP BY super")
def taxonomy_rollup(spark, sf_dir):
    members = gv.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("concept"))
    return taxonomy.rollup_counts(members, closure(_places(spark, sf_dir)).select("sub", "super"))


FREQUENT_SQL = "SELECT risk, control FROM (SELECT risk, control, count(*) n, sum(count(*)) OVER (PARTITION BY risk) every_, count(*) OVER (PARTITION BY risk) kinds FROM ({}) GROUP BY risk, control) WHERE n * kinds >= every_"
FORWARD_SQL = FREQUENT_SQL.format("SELECT n_name risk, p_brand control FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
REVERSE_SQL = FREQUENT_SQL.format("SELECT n_name risk, p_brand control FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
MAPPING_SQL = "SELECT a.n_name src, CASE WHEN (a.n_nationkey + b.n_nationkey) % 2 = 0 THEN 'closeMatch' ELSE 'relatedMatch' END rel, b.n_name dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


def _mapping(spark, sf_dir):
    side = lambda s: gv.table(spark, sf_dir, "nation").select(*(F.col(f"n_{c}").alias(f"{c}_{s}") for c in ("nationkey", "name", "regionkey")))
    pairs = side("a").join(side("b"), F.col("regionkey_a") == F.col("regionkey_b")).filter("nationkey_a < nationkey_b")
    return pairs.select(F.col("name_a").alias("src"), F.when((F.col("nationkey_a") + F.col("nationkey_b")) % 2 == 0, "closeMatch").otherwise("relatedMatch").alias("rel"), F.col("name_b").alias("dst"))


@query(f"WITH m AS ({MAPPING_SQL}) SELECT src, rel, dst FROM m UNION SELECT dst, rel, src FROM m")
def mapping_symmetric(spark, sf_dir):
    return taxonomy.symmetric(_mapping(spark, sf_dir))


@query(f"WITH m AS ({MAPPING_SQL}), s AS (SELECT src, rel, dst FROM m UNION SELECT dst, rel, src FROM m), f AS ({FORWARD_SQL}) SELECT risk, control, 'own' AS via FROM f UNION SELECT dst, control, rel FROM s JOIN f ON risk = src")
def control_crosswalk(spark, sf_dir):
    return taxonomy.crosswalk(_mapping(spark, sf_dir), gv.controls_forward(spark, sf_dir))


@query(f"WITH f AS ({FORWARD_SQL}), r AS ({REVERSE_SQL}) SELECT coalesce(f.risk, r.risk) AS risk, coalesce(f.control, r.control) AS control, CASE WHEN r.risk IS NULL THEN 'forward' ELSE 'reverse' END AS side FROM f FULL JOIN r ON f.risk = r.risk AND f.control = r.control WHERE f.risk IS NULL OR r.risk IS NULL")
def crosswalk_asymmetry(spark, sf_dir):
    return taxonomy.asymmetry(gv.controls_forward(spark, sf_dir), gv.controls_reverse(spark, sf_dir))


@query(f"WITH RECURSIVE {gv.GRAPH_SQL} SELECT DISTINCT 'usedBy' AS p, o AS s, s AS o FROM use_edge UNION SELECT 'producedBy', o, s FROM produce_edge")
def inverse_edges(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    back = lambda p, e: graphs.inverse(e).distinct().select(F.lit(p).alias("p"), "s", "o")
    return back("usedBy", g.use).unionByName(back("producedBy", g.produce))


PROPERTY_EDGES = (("use", "touches"), ("produce", "touches"), ("touches", "related"))


@query(f"WITH RECURSIVE {gv.GRAPH_SQL}, t AS (SELECT DISTINCT s, 'use' AS p, o FROM use_edge UNION SELECT s, 'produce', o FROM produce_edge) SELECT s, p, o FROM t UNION SELECT s, 'touches', o FROM t UNION SELECT s, 'related', o FROM t")
def subproperty_entailment(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    triples = g.use.select("s", F.lit("use").alias("p"), "o").unionByName(g.produce.select("s", F.lit("produce").alias("p"), "o"))
    return graphs.with_superproperties(triples, Hierarchy(PROPERTY_EDGES))


@query(f"WITH RECURSIVE {gv.GRAPH_SQL} SELECT 'arch' AS g, s, 'use' AS p, o FROM use_edge UNION SELECT 'arch', s, 'playsRole', o FROM plays UNION SELECT 'arch', s, 'use', o FROM use_edge")
def graph_merge(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    named = lambda p, e: e.select(F.lit("arch").alias("g"), "s", F.lit(p).alias("p"), "o")
    return graphs.merged(named("use", g.use), named("playsRole", g.plays), named("use", g.use))


PY_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"
REPORTS_SQL = f"""raw AS (
  SELECT d.doc_id AS row_id, {_strip("string_split(text, chr(10))[1]")} AS title, coalesce({_strip("string_split(text, chr(10))[2]")}, '') AS description, {_strip('text')} AS body, coalesce(source, '') AS source_domain, coalesce({_strip('url')}, '') AS url
  FROM documents d LEFT JOIN pages ON page_id = d.doc_id),
report AS (
  SELECT row_id, CAST(row_id AS VARCHAR) AS report_id, title, description, source_domain, url,
    substring(concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN 'TITLE: ' || title END, CASE WHEN description <> '' THEN 'DESCRIPTION: ' || description END, CASE WHEN body <> '' THEN 'TEXT: ' || body END), 1, 8000) AS full_text
  FROM raw)"""
#: Words that do occur in the generated texts, so that the prefilter has something to select.
LICENCE_HINTS = ("license", "rights reserved", "rag", "password", "stupid")


def _hint_sql(terms) -> str:
    hay = f"regexp_replace(lower(title || ' ' || description || ' ' || full_text), '{PY_SPACE}+', ' ', 'g')"
    return "(" + " OR ".join(f"contains({hay}, '{t}')" for t in terms) + ")"


def _reports(spark, sf_dir):
    return incidents.normalised(gv.raw_reports(spark, sf_dir))


@query(f"WITH {REPORTS_SQL} SELECT * FROM report")
def reports_normalized(spark, sf_dir):
    return _reports(spark, sf_dir)


@query(f"WITH {REPORTS_SQL} SELECT row_id, {_hint_sql(incidents.RETRIEVAL_HINTS)} AS by_retrieval, {_hint_sql(LICENCE_HINTS)} AS by_licence FROM report")
def reports_prefiltered(spark, sf_dir):
    return _reports(spark, sf_dir).select("row_id", incidents.has_hint().alias("by_retrieval"), incidents.has_hint(LICENCE_HINTS).alias("by_licence"))


@query(f"WITH {REPORTS_SQL} SELECT * FROM report ORDER BY row_id LIMIT 100")
def reports_limited(spark, sf_dir):
    return incidents.limited(_reports(spark, sf_dir), 100)


@query(f"WITH {REPORTS_SQL} SELECT row_id, md5(regexp_replace(lower('relevance'), '{PY_SPACE}+', ' ', 'g') || '||' || report_id || '||' || regexp_replace(lower({_strip('substring(full_text, 1, 2000)')}), '{PY_SPACE}+', ' ', 'g')) AS key FROM report")
def cache_keys(spark, sf_dir):
    return _reports(spark, sf_dir).select("row_id", cache_key(F.lit("relevance"), F.col("report_id"), F.substring("full_text", 1, incidents.MOST_PROMPT_KEY)).alias("key"))


@query("SELECT doc_id, url_encode(source || ' *~+/' || lang || ':' || text) AS encoded FROM documents")
def iri_encoding(spark, sf_dir):
    docs = gv.table(spark, sf_dir, "documents")
    return docs.select("doc_id", encode_for_uri(F.concat("source", F.lit(" *~+/"), "lang", F.lit(":"), "text")).alias("encoded"))


#: Answers of the stand-in model, by report number modulo their count: each kind of answer a model gives.
STUB_ANSWERS = (
    '{"is_relevant": true, "relevance_level": "direct", "relevance_reason": "ranks", "matched_modes": ["search", 3, null], "detected_system_behavior": "ranking", "meta": {"title": ""}, "system_profile": {"ai_task": ["rank", "Unknown", " "], "domain": " news "}, "risk_assessment": {"confidence": "high"}}',
    'Here you are:\n```json\n{"is_relevant": "false", "matched_modes": "search", "risk_pattern": {"mechanism": "drift", "trigger": ""}, "evidence": ["x"]}\n```\nDone.',
    'I think {"is_relevant": 0, "relevance_reason": "no"} fits.',
    '["is_relevant"]',
    '{"is_relevant": true, "relevance_level":',
    "",
    '{"is_relevant": true} and {"is_relevant": false}',
    '{"is_relevant": 1, "system_profile": {"ai_task": "search", "stakeholders": ["users"]}, "meta": {"url": " u "}}',
)


def stub_client():
    """A client without a network; every eleventh report makes it raise."""

    def call(prompt: str, stage: str, report_id: str) -> str:
        if int(report_id) % 11 == 10:
            raise RuntimeError("no answer")
        return STUB_ANSWERS[int(report_id) % len(STUB_ANSWERS)]

    return call


STUB_SQL = f"""{REPORTS_SQL}, judged AS (
  SELECT *, row_id % 8 AS k, {_hint_sql(LICENCE_HINTS)} AS hint, row_id % 11 = 10 AS failed FROM report),
gate AS (
  SELECT row_id, report_id, title, source_domain, url, k, hint, hint AND failed AS failed,
    hint AND NOT failed AND k IN (0, 1, 7) AS is_relevant,
    CASE WHEN NOT hint THEN 'not_relevant' WHEN failed THEN 'unknown' WHEN k = 0 THEN 'direct' ELSE 'not_relevant' END AS relevance_level,
    CASE WHEN NOT hint THEN 'Keyword prefilter found no IR-related signal' WHEN failed THEN 'unknown' WHEN k = 0 THEN 'ranks' WHEN k = 2 THEN 'no' WHEN k IN (1, 7) THEN '' ELSE 'LLM response could not be parsed' END AS relevance_reason,
    CASE WHEN hint AND NOT failed AND k = 0 THEN 'search|3|None' ELSE '' END AS matched_modes,
    CASE WHEN hint AND NOT failed AND k = 0 THEN 'ranking' ELSE 'unknown' END AS detected_system_behavior
  FROM judged)"""


def _gated(spark, sf_dir):
    return incidents.relevance_gate(_reports(spark, sf_dir), stub_client, terms=LICENCE_HINTS)


@query(f"WITH {STUB_SQL} SELECT row_id, is_relevant, relevance_level, relevance_reason, matched_modes, detected_system_behavior FROM gate")
def relevance_gate_stub(spark, sf_dir):
    return _gated(spark, sf_dir).select("row_id", "is_relevant", "relevance_level", "relevance_reason", F.array_join("matched_modes", "|").alias("matched_modes"), "detected_system_behavior")


@query(f"""WITH {STUB_SQL} SELECT row_id, CASE WHEN k = 0 THEN '' ELSE title END AS title, CASE WHEN k = 7 THEN 'u' ELSE url END AS url,
  CASE k WHEN 0 THEN 'rank' WHEN 7 THEN 'search' ELSE '' END AS ai_task, CASE WHEN k = 0 THEN 'news' ELSE 'unknown' END AS domain, CASE WHEN k = 7 THEN 'users' ELSE '' END AS stakeholders,
  CASE WHEN k = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN k = 1 THEN 'drift' ELSE 'unknown' END AS mechanism, 'unknown' AS trigger_, '' AS system_evidence, matched_modes FROM gate WHERE is_relevant""")
def extraction_normalized(spark, sf_dir):
    found = incidents.extract(_gated(spark, sf_dir), stub_client).filter("meta.is_relevant")
    return found.select(
        "row_id", "meta.title", "meta.url", F.array_join("system_profile.ai_task", "|").alias("ai_task"), "system_profile.domain", F.array_join("system_profile.stakeholders", "|").alias("stakeholders"),
        "risk_assessment.confidence", "risk_pattern.mechanism", F.col("risk_pattern.trigger").alias("trigger_"), F.array_join("evidence.system_evidence", "|").alias("system_evidence"), F.array_join("matched_modes", "|").alias("matched_modes"),
    )


@query(f"WITH {STUB_SQL} SELECT row_id, report_id, 'pipeline_error: no answer' AS relevance_reason, relevance_level, true AS no_profile FROM gate WHERE failed")
def extraction_error_rows(spark, sf_dir):
    found = incidents.extract(_gated(spark, sf_dir), stub_client).filter(F.col("meta.relevance_reason").startswith("pipeline_error"))
    return found.select("row_id", "meta.report_id", "meta.relevance_reason", "relevance_level", F.col("system_profile").isNull().alias("no_profile"))


@query(f"WITH {STUB_SQL} SELECT count(*) AS n_records, CAST(count_if(is_relevant) AS BIGINT) AS n_relevant FROM gate")
def relevant_counts(spark, sf_dir):
    return counts(incidents.extract(_gated(spark, sf_dir), stub_client))


@query("SELECT stage, key, value, ts FROM (SELECT event_type AS stage, user_id AS key, props AS value, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, props) AS k FROM events) WHERE k = 1")
def cache_latest(spark, sf_dir):
    events = gv.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("key"), F.col("props").alias("value"), "ts")
    return incidents.latest(events)


def _steps(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    return g, patterns.relations_of(g), g.produce.select("s").distinct()


@query(f"""{BASE_SQL} SELECT DISTINCT s FROM contains_edge k JOIN category_closure c ON c.sub = k.o AND c.super = 'SensitiveInformation'""")
def condition_property_path(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    stores = g.contains.select("s").distinct()
    return patterns.satisfied(patterns.Condition("exists", "x", "containsDataCategory/subDataCategoryOf*", "SensitiveInformation"), patterns.relations_of(g), stores)


@query(f"""{BASE_SQL} SELECT DISTINCT s FROM produce_edge WHERE s NOT IN (SELECT u.s FROM use_edge u JOIN plays p ON p.s = u.o JOIN role_closure c ON c.sub = p.o WHERE c.super = 'KnowledgeSource')""")
def condition_negated(spark, sf_dir):
    _, relation, steps = _steps(spark, sf_dir)
    return patterns.satisfied(patterns.Condition("absent", "x", "use/playsRole/subRoleOf*", "KnowledgeSource"), relation, steps)


@query(f"""{BASE_SQL} SELECT s FROM (SELECT s, count(DISTINCT o) AS n FROM use_edge GROUP BY s) WHERE n BETWEEN 3 AND 6 AND s IN (SELECT s FROM produce_edge)""")
def condition_cardinality(spark, sf_dir):
    _, relation, steps = _steps(spark, sf_dir)
    return patterns.satisfied(patterns.Condition("count", "x", "use", None, 3, 6), relation, steps)


#: A chain of two steps over a retrieved context, the second of which writes for users and is grounded in a store.
CHAIN = patterns.Pattern(
    "GroundedChain",
    {"first": patterns.PatternNode("RetrievalStep"), "context": patterns.PatternNode("RetrievedContext"), "second": patterns.PatternNode("GenerationStep"), "output": patterns.PatternNode("UserFacingOutput")},
    (("first", "produce", "context"), ("second", "use", "context"), ("second", "produce", "output")),
    (patterns.Condition("exists", "second", "use/playsRole", "VectorStore"),),
)


@query(f"""{BASE_SQL} SELECT DISTINCT a.s AS first, a.o AS context, u.s AS second, b.o AS output FROM produce_edge a JOIN use_edge u ON u.o = a.o JOIN produce_edge b ON b.s = u.s
WHERE a.s IN ({_with_role('RetrievalStep')}) AND a.o IN ({_with_role('RetrievedContext')}) AND u.s IN ({_with_role('GenerationStep')}) AND b.o IN ({_with_role('UserFacingOutput')})
  AND u.s IN (SELECT x.s FROM use_edge x JOIN plays p ON p.s = x.o AND p.o = 'VectorStore')""")
def pattern_chain(spark, sf_dir):
    return patterns.matches(gv.graph_view(spark, sf_dir), CHAIN)


@query(f"""WITH RECURSIVE {gv.GRAPH_SQL}, inform AS (SELECT DISTINCT p.s AS a, u.s AS b FROM produce_edge p JOIN use_edge u ON u.o = p.o)
, walk(sub, super) AS (SELECT a, b FROM inform UNION SELECT w.sub, i.b FROM walk w JOIN inform i ON i.a = w.super) SELECT sub AS s, super AS o FROM walk""")
def flow_reachability(spark, sf_dir):
    """Steps reached by data flow over any number of hops: the path (produce/^use)+."""
    return patterns.Path("(produce/^use)+", patterns.relations_of(gv.graph_view(spark, sf_dir))).pairs()


@query(f"""WITH RECURSIVE {gv.GRAPH_SQL}, a AS (SELECT DISTINCT s, 'use' AS p, o FROM use_edge), b AS (SELECT DISTINCT s, 'use' AS p, o FROM use_edge WHERE o NOT LIKE 'store:%' UNION SELECT s, 'produce', o FROM produce_edge)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def graph_difference(spark, sf_dir):
    g = gv.graph_view(spark, sf_dir)
    use = g.use.select("s", F.lit("use").alias("p"), "o")
    return patterns.difference(use, use.filter("o not like 'store:%'").unionByName(g.produce.select("s", F.lit("produce").alias("p"), "o")))


@query("SELECT coalesce(CAST(n_regionkey AS VARCHAR), 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def group_rollup(spark, sf_dir):
    nations = gv.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"))
    return gv.table(spark, sf_dir, "customer").select("c_nationkey").join(nations, "c_nationkey").rollup("region", "nation").agg(F.count(F.lit(1)).alias("n_customers")).withColumns({"region": F.coalesce(F.col("region").cast("string"), F.lit("all")), "nation": F.coalesce("nation", F.lit("all"))})


#: The vector motif whose source also has to hold sensitive information.
SENSITIVE_IR = replace(motifs.VECTOR_IR, name="SensitiveVectorMotif", nodes=tuple(replace(n, category="SensitiveInformation") if n.column == "source" else n for n in motifs.VECTOR_IR.nodes))


@query(f"""{MATCHED_SQL}, sensitive AS (SELECT s FROM contains_edge k JOIN category_closure c ON c.sub = k.o AND c.super = 'SensitiveInformation')
SELECT 'SensitiveVectorMotif' AS motif, step, query, source, result FROM vector WHERE source IN (SELECT s FROM sensitive)""")
def motif_category_solutions(spark, sf_dir):
    return motifs.solutions(_graph(spark, sf_dir), SENSITIVE_IR).select("motif", "step", "query", "source", "result")


PART_SQL = """WITH RECURSIVE edge(sub, super) AS (SELECT DISTINCT 'p' || p_partkey, p_brand FROM part UNION SELECT DISTINCT 'p' || p_partkey, p_type FROM part UNION SELECT DISTINCT p_brand, p_type FROM part),
walk(sub, super, hops) AS (SELECT sub, super, 1 FROM edge UNION SELECT w.sub, e.super, w.hops + 1 FROM walk w JOIN edge e ON e.sub = w.super)"""


@query(f"{PART_SQL} SELECT sub, super, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY sub, super")
def multi_parent_closure(spark, sf_dir):
    """Parts under brands and types, brands under all types they come in: most nodes have several parents."""
    part = gv.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("p"), "p_brand", "p_type")
    edge = lambda a, b: part.select(F.col(a).alias("sub"), F.col(b).alias("super"))
    return closure(edge("p", "p_brand").unionByName(edge("p", "p_type")).unionByName(edge("p_brand", "p_type")), reflexive=False).withColumn("hops", F.col("hops").cast("long"))


@query(f"{PLACE_SQL} SELECT super AS s, sub AS o FROM walk")
def contain_closure(spark, sf_dir):
    """What a place contains at any depth: the transitive property ``contain`` as a path."""
    contain = _places(spark, sf_dir).select(F.col("super").alias("s"), F.col("sub").alias("o"))
    return patterns.Path("contain+", lambda name: contain).pairs()


@query("SELECT DISTINCT 'step:' || conv_id || ':' || turn AS s, 'performedBy' AS p, 'model:' || (conv_id % 5) AS o FROM conversations WHERE role = 'assistant'")
def performed_by(spark, sf_dir):
    """The inverse of ``perform``, which leads from the model of an answer to its step."""
    said = gv.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    perform = said.select(F.concat(F.lit("model:"), (F.col("conv_id") % 5).cast("string")).alias("s"), F.concat_ws(":", F.lit("step"), "conv_id", "turn").alias("o"))
    return graphs.inverse(perform).distinct().select("s", F.lit("performedBy").alias("p"), "o")


@query(f"WITH {STUB_SQL} SELECT row_id, hint AND NOT failed AND k IN (0, 1, 2, 7) AS cached, row_id % 11 = 10 AND NOT (hint AND NOT failed AND k IN (0, 1, 2, 7)) AS failed FROM gate")
def cache_probe(spark, sf_dir):
    """All reports asked about with the answers on those with a hint in the cache already: unreadable answers are not kept."""
    reports = _reports(spark, sf_dir)
    first = incidents.ask(reports.filter(incidents.has_hint(LICENCE_HINTS)), "relevance", stub_client)
    cache = written(incidents.cache_rows(first, "2024-01-01 00:00:00"), "stub-cache")
    again = incidents.ask(reports, "relevance", stub_client, cache=cache)
    return again.select("row_id", "cached", F.col("failure").isNotNull().alias("failed"))


@query(f"""WITH {STUB_SQL} SELECT row_id, is_relevant, CASE WHEN is_relevant AND k = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN is_relevant AND k = 0 THEN 'news' ELSE 'unknown' END AS domain,
  CASE WHEN is_relevant AND k = 1 THEN 'drift' ELSE 'unknown' END AS mechanism, CASE WHEN is_relevant AND k = 0 THEN 1 WHEN is_relevant AND k = 7 THEN 1 ELSE 0 END AS n_tasks FROM gate""")
def extraction_filled(spark, sf_dir):
    """All reports, with the defaults of a record where there is no extraction."""
    found = incidents.extract(_gated(spark, sf_dir), stub_client, filled=True)
    return found.select("row_id", "meta.is_relevant", "risk_assessment.confidence", "system_profile.domain", "risk_pattern.mechanism", F.size("system_profile.ai_task").alias("n_tasks"))


@query(f"""WITH {STUB_SQL} SELECT report_id, CASE WHEN k = 0 THEN '' ELSE title END AS title, CASE k WHEN 0 THEN 'rank' WHEN 7 THEN 'search' ELSE '' END AS ai_task, 'unknown' AS risk_category, 'unknown' AS risk_type
  FROM gate WHERE is_relevant ORDER BY row_id LIMIT 20""")
def records_preview(spark, sf_dir):
    """What a reader looks at first, of the first twenty relevant records."""
    found = relevant_preview(incidents.extract(_gated(spark, sf_dir), stub_client))
    return found.withColumn("ai_task", F.array_join("ai_task", "|"))


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT doc_id, nullif(text, '') AS text, count(*) OVER () - 1 AS last_row FROM documents""")
def csv_scan(spark, sf_dir):
    """Documents written as CSV and read as reports, by many tasks a file: quotes, line ends and carriage returns inside texts, and row numbers without a gap."""
    path = _scratch(spark, "csv")
    docs = gv.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_reports(spark, path, whole_files=False)
    seen = rows.agg(F.max("row_id").alias("last_row"), F.count_distinct("row_id").alias("n"))
    numbers = seen.select(F.when(F.col("n") == F.col("last_row") + 1, F.col("last_row")).alias("last_row"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").crossJoin(F.broadcast(numbers))


@query(f"WITH {STUB_SQL} SELECT report_id, is_relevant, relevance_level, CASE WHEN matched_modes = '' THEN 0 ELSE len(string_split(matched_modes, '|')) END AS n_modes, NOT is_relevant AS bare FROM gate")
def record_lines(spark, sf_dir):
    """Records written as JSON lines and read again."""
    path = _scratch(spark, "records")
    write_records(incidents.extract(_gated(spark, sf_dir), stub_client), path)
    back = spark.read.schema(incidents.RECORD_SQL.removeprefix("row_id long, ")).json(path)
    return back.select("meta.report_id", "meta.is_relevant", "relevance_level", F.size("matched_modes").alias("n_modes"), F.col("system_profile.ai_task").isNull().alias("bare"))


@query("SELECT 'http://example.org/doc/' || doc_id AS s, text AS o, lang FROM documents WHERE text IS NOT NULL")
def ntriples_scan(spark, sf_dir):
    """Whole texts as labels with a language, written as N-Triples and read again: line ends, quotes and backslashes are escapes there."""
    path = _scratch(spark, "ntriples")
    docs = gv.table(spark, sf_dir, "documents").filter("text is not null")
    plain = lambda c: F.lit(c).alias
    labels = docs.select(F.concat(F.lit("http://example.org/doc/"), F.col("doc_id").cast("string")).alias("s"), plain("iri")("s_kind"), plain("http://www.w3.org/2000/01/rdf-schema#label")("p"), F.col("text").alias("o"), plain("literal")("o_kind"), "lang", F.lit(None).cast("string").alias("dt"))
    turtle.write_ntriples(labels, path)
    return turtle.read_ntriples(spark, [path], "docs").select("s", "o", "lang")


def _generated_motifs() -> tuple[motifs.Motif, ...]:
    """A motif for each combination of roles around a step."""
    asked = itertools.product(
        ("RetrievalStep", "LLMBasedInformationRetrievalStep", "VectorBasedRetrievalStep", "GenerationStep"), ("UserInput", "RetrievedContext", "SystemPrompt"),
        ("KnowledgeSource", "VectorStore", "Model"), ("UserFacingOutput", "RetrievedContext"),
    )
    node = lambda column, role, edge=None: motifs.Node(column, column, role, edge)
    return tuple(motifs.Motif(f"M{i}", f"M{i}", f"-m{i}", (node("step", s), node("query", q, "use"), node("source", k, "use"), node("result", r, "produce"))) for i, (s, q, k, r) in enumerate(asked))


LIBRARY = _generated_motifs()
LIBRARY_SQL = f"""{BASE_SQL}, tag AS (SELECT p.s, c.super AS role FROM plays p JOIN role_closure c ON c.sub = p.o UNION SELECT s, o FROM plays),
library(motif, step_role, query_role, source_role, result_role) AS (VALUES {", ".join(str((m.name, *(n.role for n in m.nodes))) for m in LIBRARY)})"""


@query(f"""{LIBRARY_SQL} SELECT DISTINCT motif, a.s AS step, a.o AS query, b.o AS source, r.o AS result
FROM library m JOIN tag st ON st.role = m.step_role JOIN use_edge a ON a.s = st.s JOIN tag qt ON qt.s = a.o AND qt.role = m.query_role
  JOIN use_edge b ON b.s = st.s JOIN tag sr ON sr.s = b.o AND sr.role = m.source_role JOIN produce_edge r ON r.s = st.s JOIN tag rt ON rt.s = r.o AND rt.role = m.result_role""")
def motif_library_solutions(spark, sf_dir):
    """The solutions of 72 motifs in one plan, whose scans and joins are as many as for one."""
    return library.library_solutions(_graph(spark, sf_dir), LIBRARY).select("motif", "step", "query", "source", "result")


def _stored(spark, sf_dir):
    """The graph, and the triples of its matches by the stored query that the graph declares for the motif."""
    g = _graph(spark, sf_dir)
    motif, implementation = V.pat(motifs.VECTOR_IR.name), V.pat("StoredMatches")
    rows = [(motif, V.p("implementedBy"), implementation), (implementation, V.p("implementationLanguage"), implementations.LANGUAGE), (implementation, V.p("implementationPath"), "motif_matches.sql")]
    return g, implementations.run_declared(g, spark.createDataFrame(rows, "s string, p string, o string"), motif)


@query(ORACLES["motif_match_triples"])
def stored_match_triples(spark, sf_dir):
    """Match triples by a stored query text that is declared as the motif's implementation."""
    return _stored(spark, sf_dir)[1]


@query(ORACLES["finding_leakage"])
def stored_leakage(spark, sf_dir):
    """Leakage findings by a stored query text over the graph and the match triples of another."""
    g, matches = _stored(spark, sf_dir)
    text = implementations.stored_text(spark, "leakage_findings.sql")
    found = implementations.run_text(g, text, matches=written(matches, "match-triples"))
    return found.select("finding_iri", "match_iri", "step", "source", "result", "hops")


@query(f"""{LEAKAGE_SQL}, flow(a, b) AS (SELECT DISTINCT o, s FROM use_edge UNION SELECT s, o FROM produce_edge),
walk(s, hops) AS (SELECT s, 0 FROM facing UNION SELECT f.a, w.hops + 1 FROM walk w JOIN flow f ON f.b = w.s)
SELECT s, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY s""")
def output_reach(spark, sf_dir):
    """Everything from which data flows into user-facing output, at any depth, with the fewest edges on the way."""
    g = _graph(spark, sf_dir)
    flow = graphs.inverse(g.use).unionByName(g.produce).toDF("sub", "super")
    return reach(flow, g.with_role("UserFacingOutput")).withColumn("hops", F.col("hops").cast("long"))


@query(f"""{LEAKAGE_SQL}, ways AS (SELECT DISTINCT finding_iri, source, result, unnest(string_split(hops, ',')) AS h FROM leak)
SELECT finding_iri, CAST(least(round(1 - exp(sum(ln(1.0::DOUBLE - 0.8::DOUBLE / (CAST(h AS INT) + 1)))), 4), 0.9999) AS DOUBLE) AS confidence, count(*) AS n_ways FROM ways GROUP BY finding_iri""")
def leakage_confidence(spark, sf_dir):
    """Leakage findings with the confidence that their ways to users give."""
    return lifecycle.leakage_confidence(_leakage(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


def _two_runs(spark, sf_dir):
    """The state after a run without the conversations of every third model, reviews, and a run without those of every fourth step."""
    leaks = written(_leakage(spark, sf_dir).select("finding_iri", "step").distinct(), "leaks")
    number = F.split("step", ":")[1].cast("long")
    first = lifecycle.merged(spark.createDataFrame([], lifecycle.STATE_SQL), leaks.filter(number % 3 > 0), "2024-01-01 00:00:00")
    decisions = leaks.filter(number % 5 < 3).select("finding_iri", F.when(number % 5 == 0, "confirmed").when(number % 5 == 1, "rejected").otherwise("mitigated").alias("status"))
    state, refused = lifecycle.reviewed(first, decisions, "2024-01-02 00:00:00")
    return lifecycle.merged(state, leaks.filter(number % 4 > 0), "2024-01-03 00:00:00"), refused


LIFE_SQL = f"""{LEAKAGE_SQL}, f AS (SELECT DISTINCT finding_iri, CAST(split_part(step, ':', 2) AS BIGINT) AS v FROM leak),
one AS (SELECT *, v % 3 > 0 AS first_run, v % 4 > 0 AS second_run, CASE WHEN v % 3 > 0 THEN CASE v % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'candidate' END END AS before FROM f),
life AS (SELECT *, CASE WHEN second_run THEN coalesce(before, 'candidate') WHEN before IN ('rejected', 'mitigated') THEN before WHEN before IS NOT NULL THEN 'retired' END AS status FROM one WHERE first_run OR second_run)"""


@query(f"""{LIFE_SQL} SELECT finding_iri, status, CAST(CAST(first_run AS INT) + CAST(second_run AS INT) AS BIGINT) AS runs, CASE WHEN first_run THEN '2024-01-01' ELSE '2024-01-03' END AS first_seen,
  concat_ws('>', 'candidate', CASE WHEN before <> 'candidate' THEN before END, CASE WHEN status = 'retired' THEN status END) AS history FROM life""")
def finding_lifecycle(spark, sf_dir):
    """Findings over two runs with reviews in between: statuses are kept, what is no longer found is retired."""
    state, _ = _two_runs(spark, sf_dir)
    return state.select("finding_iri", "status", "runs", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.array_join(F.transform("history", lambda h: h["status"]), ">").alias("history"))


@query("""WITH d AS (SELECT 'http://example.org/doc/' || doc_id AS s, * FROM documents)
SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://example.org/Document' AS o, NULL AS lang, NULL AS dt FROM d
UNION ALL SELECT s, 'http://example.org/body', text, lang, NULL FROM d WHERE text IS NOT NULL
UNION ALL SELECT s, 'http://example.org/start', substring(text, 1, 40), NULL, NULL FROM d WHERE text IS NOT NULL
UNION ALL SELECT s, 'http://example.org/source', 'http://example.org/source/' || source, NULL, NULL FROM d WHERE source IS NOT NULL
UNION ALL SELECT s, 'http://example.org/size', CAST(length(text) AS VARCHAR), NULL, 'http://www.w3.org/2001/XMLSchema#integer' FROM d WHERE text IS NOT NULL
UNION ALL SELECT s, 'http://example.org/size', CAST(length(text) AS VARCHAR) || '.5', NULL, 'http://www.w3.org/2001/XMLSchema#decimal' FROM d WHERE text IS NOT NULL
UNION ALL SELECT s, 'http://example.org/long', CASE WHEN length(text) > 1000 THEN 'true' ELSE 'false' END, NULL, 'http://www.w3.org/2001/XMLSchema#boolean' FROM d WHERE text IS NOT NULL
UNION ALL SELECT s, 'http://example.org/seen', '2024-01-01', NULL, 'http://www.w3.org/2001/XMLSchema#date' FROM d""")
def turtle_scan(spark, sf_dir):
    """Documents as Turtle, one document of it each, and its triples: long and short strings, languages, numbers, truth values, typed literals, lists of objects."""
    docs = gv.table(spark, sf_dir, "documents")
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    long_form = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    size = F.length("text").cast("string")
    parts = [
        F.lit("@prefix : <http://example.org/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n# a document\n"), F.concat(F.lit("<http://example.org/doc/"), F.col("doc_id").cast("string"), F.lit("> a :Document")),
        F.when(F.col("text").isNotNull(), F.concat(F.lit(';\n  :body """'), long_form, F.lit('"""'), F.coalesce(F.concat(F.lit("@"), "lang"), F.lit("")))),
        F.when(F.col("text").isNotNull(), F.concat(F.lit(' ; :start "'), escaped(F.substring("text", 1, 40)), F.lit('" ; :size '), size, F.lit(", "), size, F.lit(".5 ; :long "), (F.length("text") > 1000).cast("string"))),
        F.when(F.col("source").isNotNull(), F.concat(F.lit(" ; :source <http://example.org/source/"), "source", F.lit(">"))), F.lit(' ; :seen "2024-01-01"^^xsd:date .\n'),
    ]
    written_as = docs.select(F.concat_ws("", *parts).alias("value"), F.col("doc_id").alias("file"))
    return turtle.document_triples(written_as, "docs").select("s", "p", "o", "lang", "dt")


@query(f"WITH {STUB_SQL} SELECT report_id, is_relevant, relevance_level, CASE WHEN is_relevant AND k = 0 THEN 'news' WHEN is_relevant THEN 'unknown' END AS domain FROM gate")
def stream_intake(spark, sf_dir):
    """Reports that arrive as files, half of them before a restart of the stream and some of those again after it: each is answered once."""
    source, out, checkpoint = (_scratch(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    raw = gv.raw_reports(spark, sf_dir).drop("row_id")
    number = F.col("report_id").cast("long")
    schema = raw.schema
    for arrived in (raw.filter(number % 2 == 0), raw.filter((number % 2 == 1) | (number % 10 == 0))):
        arrived.write.mode("append").json(source)
        reports = streaming.report_stream(spark, source, schema)
        streaming.run_stream(reports, stub_client, out, checkpoint, terms=LICENCE_HINTS).awaitTermination()
    records = spark.read.schema(incidents.RECORD_SQL).parquet(f"{out}/batch=*")
    return records.select("meta.report_id", "meta.is_relevant", "relevance_level", "system_profile.domain")
