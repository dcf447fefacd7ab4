"""Declared patterns of any shape: nodes, edges and conditions with property paths, read from triples or written in code."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.closure import closure
from plinth.plans.vocabulary import TYPE, Vocabulary
from plinth.sources.graph import Graph

#: Triples of a catalogue up to which it is read as a specification.
MOST_SPEC = 50_000


@dataclass(frozen=True)
class PatternNode:
    role: str | None = None
    category: str | None = None
    expected_class: str | None = None


@dataclass(frozen=True)
class Condition:
    """kind: 'exists', 'absent' or 'count'; the path leads from ``variable`` to ``target``, or to anything."""

    kind: str
    variable: str
    path: str
    target: str | None = None
    least: int = 1
    most: int | None = None


@dataclass(frozen=True)
class Pattern:
    name: str
    nodes: dict[str, PatternNode]
    edges: tuple[tuple[str, str, str], ...]
    conditions: tuple[Condition, ...] = ()


Relation = Callable[[str], DataFrame]


def relations_of(graph: Graph) -> Relation:
    """Relations of a graph by short name, with the edges of its hierarchies."""
    spark = graph.use.sparkSession
    fixed = {"use": graph.use, "produce": graph.produce, "playsRole": graph.plays, "containsDataCategory": graph.contains, "inform": graph.inform, "type": graph.types}
    held = {"subRoleOf": graph.roles, "subDataCategoryOf": graph.categories, "subClassOf": graph.classes}

    def of(name: str) -> DataFrame:
        if name in held:
            return spark.createDataFrame([(sub, sup) for sup, subs in sorted(held[name].below.items()) for sub in sorted(subs)], "s string, o string")
        return fixed[name].select("s", "o")

    return of


def relations_in(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> Relation:
    """Relations of a triple table by local name in the pattern or core vocabulary, or by full IRI."""

    def of(name: str) -> DataFrame:
        names = [TYPE] if name == "type" else [name] if "://" in name else [vocabulary.p(name), vocabulary.c(name)]
        return triples.filter(F.col("p").isin(names)).select("s", "o").distinct()

    return of


_PATH = re.compile(r"\s*(<[^>]*>|[\w:.-]+|[/|^*+?()])")


class Path:
    """Property paths: sequence ``a/b``, alternative ``a|b``, inverse ``^a``, ``a*``, ``a+``, ``a?`` and brackets, as (s, o)."""

    def __init__(self, text: str, relation: Relation):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            found = _PATH.match(text, at)
            if not found:
                raise ValueError(f"cannot read path {text!r} at {at}")
            self.tokens.append(found[1])
            at = found.end()
        self.relation = relation

    def pairs(self) -> DataFrame:
        out = self._alternative()
        if self.tokens:
            raise ValueError(f"unexpected {self.tokens[0]!r} in a path")
        return out[0] if not out[1] else out[0].unionByName(self._nodes(out[0])).distinct()

    def _nodes(self, pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("s").alias("x")).union(pairs.select("o")).distinct()
        return nodes.select(F.col("x").alias("s"), F.col("x").alias("o"))

    # Each part is (pairs, reflexive): with the flag, every element also reaches itself, which is never written out.
    def _alternative(self) -> tuple[DataFrame, bool]:
        pairs, own = self._sequence()
        while self.tokens[:1] == ["|"]:
            self.tokens.pop(0)
            more, also = self._sequence()
            pairs, own = pairs.unionByName(more).distinct(), own or also
        return pairs, own

    def _sequence(self) -> tuple[DataFrame, bool]:
        pairs, own = self._step()
        while self.tokens[:1] == ["/"]:
            self.tokens.pop(0)
            more, also = self._step()
            joined = pairs.withColumnRenamed("o", "via").join(more.withColumnRenamed("s", "via"), "via").select("s", "o")
            joined = joined.unionByName(pairs) if also else joined
            joined = joined.unionByName(more) if own else joined
            pairs, own = joined.distinct(), own and also
        return pairs, own

    def _step(self) -> tuple[DataFrame, bool]:
        token = self.tokens.pop(0) if self.tokens else ""
        if token == "^":
            pairs, own = self._step()
            return pairs.select(F.col("o").alias("s"), F.col("s").alias("o")), own
        if token == "(":
            pairs, own = self._alternative()
            if not self.tokens or self.tokens.pop(0) != ")":
                raise ValueError("a bracket is left open in a path")
        elif re.match(r"[\w<]", token):
            pairs, own = self.relation(token.strip("<>").split(":")[-1] if "://" not in token else token.strip("<>")), False
        else:
            raise ValueError(f"unexpected {token!r} in a path")
        if self.tokens[:1] and self.tokens[0] in "*+?":
            mark = self.tokens.pop(0)
            if mark != "?":
                far = closure(pairs.toDF("sub", "super"), reflexive=False).select(F.col("sub").alias("s"), F.col("super").alias("o"))
                pairs = far.unionByName(pairs).distinct()  # loops of the relation itself stay
            own = own or mark != "+"
        return pairs, own


def holders(condition: Condition, relation: Relation, elements: DataFrame) -> DataFrame:
    """(s, n): elements (s) whose path reaches the target, or anything, with the number of ends."""
    path = Path(condition.path, relation)
    pairs, own = path._alternative()
    if path.tokens:
        raise ValueError(f"unexpected {path.tokens[0]!r} in a path")
    pairs = pairs.join(elements, "s", "left_semi")
    if own:
        pairs = pairs.unionByName(elements.select("s", F.col("s").alias("o")))
    if condition.target is not None:
        pairs = pairs.filter(F.col("o") == condition.target)
    return pairs.distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def satisfied(condition: Condition, relation: Relation, elements: DataFrame) -> DataFrame:
    """(s): the elements that meet the condition; absence is judged on the whole graph."""
    found = holders(condition, relation, elements)
    if condition.kind == "exists":
        return elements.join(found, "s", "left_semi")
    if condition.kind == "absent":
        return elements.join(found, "s", "left_anti")
    if condition.kind != "count":
        raise ValueError(f"unknown kind of condition {condition.kind!r}")
    counted = elements.join(found, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") >= condition.least)
    return (counted if condition.most is None else counted.filter(F.col("n") <= condition.most)).select("s")


def matches(graph: Graph, pattern: Pattern, relation: Relation | None = None, strict: bool = False) -> DataFrame:
    """One column a node: distinct bindings of the pattern. Edges are joined in an order that stays connected."""
    relation = relation or relations_of(graph)
    left, out = list(pattern.edges), None
    while left:
        known = set(out.columns) if out is not None else set()
        edge = next((e for e in left if not known or {e[0], e[2]} & known), None)
        if edge is None:
            raise ValueError(f"pattern {pattern.name!r} is not connected")
        left.remove(edge)
        source, predicate, target = edge
        rows = relation(predicate)
        rows = rows.filter("s = o").select(F.col("s").alias(source)) if source == target else rows.toDF(source, target)
        for variable in {source, target}:
            rows = rows.join(_candidates(graph, pattern, relation, variable, rows, strict), variable, "left_semi") if _bounded(pattern, variable, strict) else rows
        out = rows if out is None else out.join(rows, sorted({source, target} & known))
    if out is None:
        ((variable, _),) = pattern.nodes.items()
        out = _candidates(graph, pattern, relation, variable, None, strict)
    return out.select(*pattern.nodes).distinct()


def _bounded(pattern: Pattern, variable: str, strict: bool) -> bool:
    node = pattern.nodes[variable]
    return bool(node.role or node.category or (strict and node.expected_class) or any(c.variable == variable for c in pattern.conditions))


def _candidates(graph: Graph, pattern: Pattern, relation: Relation, variable: str, rows: DataFrame | None, strict: bool) -> DataFrame:
    node = pattern.nodes[variable]
    found = graph.with_role(node.role) if node.role else rows.select(F.col(variable).alias("s")).distinct()
    if node.category:
        found = found.join(graph.with_category(node.category), "s", "left_semi")
    if strict and node.expected_class:
        found = found.join(graph.with_class(node.expected_class), "s", "left_semi")
    for condition in pattern.conditions:
        if condition.variable == variable:
            found = satisfied(condition, relation, found)
    return found.withColumnRenamed("s", variable)


def declared_patterns(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> list[Pattern]:
    """Patterns that a catalogue declares; names are local names. A catalogue of over MOST_SPEC such triples is an error.

    A path condition's ``pathExpression`` may end in a space and the name of its target; a ``conditionExpression`` is
    'absent <node> <path> [target]' or 'count <node> <least> <most or -> <path> [target]'.
    """
    rp = vocabulary.p
    names = ["hasPatternNode", "hasPatternEdge", "hasCondition", "variableName", "expectedRole", "expectedClass", "expectedDataCategory", "sourcePatternNode", "targetPatternNode", "patternPredicate", "pathExpression", "conditionExpression"]
    rows = triples.filter(F.col("p").isin([rp(n) for n in names])).select("s", "p", "o").distinct().limit(MOST_SPEC + 1).collect()
    if len(rows) > MOST_SPEC:
        raise ValueError(f"more than {MOST_SPEC} triples of pattern specifications")
    spec: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        spec.setdefault(r["s"], {}).setdefault(r["p"][len(vocabulary.pattern) :], []).append(r["o"])
    local = lambda iri: re.split(r"[#/]", iri)[-1]
    one = lambda s, p: next(iter(sorted(spec.get(s, {}).get(p, []))), None)
    named = lambda s, p: local(one(s, p)) if one(s, p) else None
    out = []
    for motif in sorted(s for s, ps in spec.items() if "hasPatternNode" in ps):
        variable = {n: one(n, "variableName") or local(n) for n in sorted(spec[motif]["hasPatternNode"])}
        nodes = {v: PatternNode(named(n, "expectedRole"), named(n, "expectedDataCategory"), named(n, "expectedClass")) for n, v in variable.items()}
        edges = [(variable[one(e, "sourcePatternNode")], local(one(e, "patternPredicate")), variable[one(e, "targetPatternNode")]) for e in sorted(spec[motif].get("hasPatternEdge", []))]
        conditions = [c for s in sorted(spec[motif].get("hasCondition", [])) for c in _conditions(one(s, "pathExpression"), one(s, "conditionExpression"), list(nodes)[0])]
        out.append(Pattern(local(motif), nodes, tuple(edges), tuple(conditions)))
    return out


def _conditions(path: str | None, text: str | None, first: str) -> list[Condition]:
    out = []
    if path:
        expression, _, target = path.strip().partition(" ")
        variable, mark, rest = expression.partition(".")
        out.append(Condition("exists", variable if mark else first, rest if mark else expression, target.strip() or None))
    if text:
        kind, variable, *rest = text.split()
        least, most = (int(rest[0]), None if rest[1] == "-" else int(rest[1])) if kind == "count" else (1, None)
        rest = rest[2:] if kind == "count" else rest
        out.append(Condition(kind, variable, rest[0], rest[1] if len(rest) > 1 else None, least, most))
    return out


def declared_interpretations(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(motif, interpretation, mechanism, risks[], controls[]): interpretations in either direction of their link."""
    rp = vocabulary.p
    of = lambda name: triples.filter(F.col("p") == rp(name)).select("s", "o")
    links = of("hasInterpretation").toDF("motif", "interpretation").unionByName(of("interpretsMotif").toDF("interpretation", "motif").select("motif", "interpretation")).distinct()
    many = lambda name, out: of(name).groupBy(F.col("s").alias("interpretation")).agg(F.array_sort(F.collect_set("o")).alias(out))
    joined = links.join(many("interpretedAsMechanism", "mechanism"), "interpretation", "left").join(many("mayIndicateRisk", "risks"), "interpretation", "left").join(many("suggestedControl", "controls"), "interpretation", "left")
    none = F.array().cast("array<string>")
    return joined.select("motif", "interpretation", F.get("mechanism", F.lit(0)).alias("mechanism"), F.coalesce("risks", none).alias("risks"), F.coalesce("controls", none).alias("controls"))


def interpreted(match: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Matches (match_iri, motif) with a row for each declared interpretation of their motif."""
    return match.select("match_iri", "motif").distinct().join(interpretations, "motif")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, ...): rows that are in one triple table only."""
    a, b = left.distinct(), right.select(*left.columns).distinct()
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))
