"""Readers of Turtle and N-Triples files into the triple table, and a writer of N-Triples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.plans.vocabulary import RDF
from plinth.sources.graph import TERMS, TRIPLES_SQL

XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<directive>@prefix|@base|(?i:PREFIX|BASE)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?))(?=[\s;,.\])]|$)|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>a|true|false)(?=[\s;,.\])]|$)|(?P<mark>[;,.\[\]()])""",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)


def unescaped(text: str) -> str:
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), text)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 30]!r}")
        at = found.end()
        if found.lastgroup != "skip":
            yield found.lastgroup, found[0]
    yield "end", ""


class Parser:
    """Triples of one document, as (s, s_kind, p, o, o_kind, lang, dt)."""

    def __init__(self, text: str, scope: str = "b"):
        self.stream, self.scope = tokens(text), scope
        self.kind, self.token = next(self.stream)
        self.prefixes: dict[str, str] = {}
        self.base, self.made, self.out = "", 0, []

    def step(self) -> str:
        was = self.token
        self.kind, self.token = next(self.stream, ("end", ""))
        return was

    def want(self, mark: str) -> None:
        if self.token != mark:
            raise ValueError(f"expected {mark!r}, found {self.token!r}")
        self.step()

    def iri(self, ref: str) -> str:
        body = unescaped(ref[1:-1])
        return body if re.match(r"[A-Za-z][\w+.-]*:", body) else self.base + body

    def named(self, name: str) -> str:
        prefix, local = name.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + local

    def fresh(self) -> tuple[str, str]:
        self.made += 1
        return f"_:{self.scope}{self.made}", "bnode"

    def node(self) -> tuple[str, str]:
        """IRI, blank node, property list or collection."""
        if self.kind == "iri":
            return self.iri(self.step()), "iri"
        if self.kind == "name":
            return self.named(self.step()), "iri"
        if self.kind == "blank":
            return f"_:{self.scope}.{self.step()[2:]}", "bnode"
        if self.token == "[":
            self.step()
            own = self.fresh()
            if self.token != "]":
                self.properties(own)
            self.want("]")
            return own
        if self.token == "(":
            self.step()
            items = []
            while self.token != ")":
                items.append(self.value())
            self.step()
            head: tuple = (f"{RDF}nil", "iri", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.out += [(*cell, f"{RDF}first", *item), (*cell, f"{RDF}rest", *head)]
                head = (*cell, None, None)
            return head[:2]
        raise ValueError(f"unexpected {self.token!r}")

    def value(self) -> tuple:
        """An object: (o, o_kind, lang, dt)."""
        kind = self.kind
        if kind in ("text", "long"):
            raw = self.step()
            text = unescaped(raw[3:-3] if kind == "long" else raw[1:-1])
            if self.kind == "lang":
                return text, "literal", self.step()[1:].lower(), None
            if self.kind == "type":
                self.step()
                return text, "literal", None, self.node()[0]
            return text, "literal", None, None
        if kind == "number":
            raw = self.step()
            return raw, "literal", None, XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer")
        if kind == "word" and self.token != "a":
            return self.step(), "literal", None, f"{XSD}boolean"
        return (*self.node(), None, None)

    def properties(self, subject: tuple[str, str]) -> None:
        while True:
            if self.token == "a" and self.kind == "word":
                self.step()
                predicate = f"{RDF}type"
            else:
                predicate = self.node()[0]
            self.out.append((*subject, predicate, *self.value()))
            while self.token == ",":
                self.step()
                self.out.append((*subject, predicate, *self.value()))
            while self.token == ";":
                self.step()
            if self.token in (".", "]") or self.kind == "end":
                return

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            if self.kind == "directive":
                at, word = self.token.startswith("@"), self.step().lstrip("@").lower()
                if word == "prefix":
                    prefix = self.step()[:-1]
                    self.prefixes[prefix] = self.iri(self.step())
                else:
                    self.base = self.iri(self.step())
                if at:
                    self.want(".")
                continue
            listed = self.token == "["
            subject = self.node()
            if not (listed and self.token == "."):
                self.properties(subject)
            self.want(".")
        return self.out


class TurtleTriples:
    """Table function: the triples of one Turtle document, whose blank nodes are named within ``scope``; a null document has none."""

    def eval(self, text: str, scope: str):
        if text is not None:
            yield from Parser(text, f"f{scope}-").parse()


def document_triples(documents: DataFrame, graph: str, text_col: str = "value", scope_col: str = "file") -> DataFrame:
    """The triples of documents, a row each, as a lateral join with a table function; other columns of theirs are left out.

    A document that is no Turtle is an error, with the line. Triples that several documents state are one.
    """
    triples = F.udtf(TurtleTriples, returnType=TRIPLES_SQL.removeprefix("g string, "))
    found = documents.select(F.col(text_col).alias("_pl_text"), F.col(scope_col).cast("string").alias("_pl_scope")).lateralJoin(triples(F.col("_pl_text").outer(), F.col("_pl_scope").outer()))
    return found.select(F.lit(graph).alias("g"), *TERMS).dropDuplicates()


def read_turtle(spark: SparkSession, paths: list[str], graph: str) -> DataFrame:
    """Triples of whole files, parsed where they are read; files are never followed to others they import."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value"), F.substring(F.md5(F.input_file_name()), 1, 8).alias("file"))
    return document_triples(files, graph)


def read_ntriples(spark: SparkSession, paths: list[str], graph: str, skip_bad: bool = False) -> DataFrame:
    """N-Triples by lines, so one large file is read in parallel. A line that is no statement is an error unless told otherwise."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for line in rows["value"]:
                line = line.strip()
                if line and line[0] != "#":
                    try:
                        found += Parser(line, "n").parse()
                    except ValueError as exc:
                        if not skip_bad:
                            raise ValueError(f"no statement: {line[:200]!r}") from exc
            yield pd.DataFrame([(graph, *t) for t in found], columns=["g", *TERMS])

    return spark.read.text(paths).mapInPandas(parse, TRIPLES_SQL).dropDuplicates()


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): the lines of N-Triples."""
    escaped = F.col("o")
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dt").isNotNull(), F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise("")
    term = lambda value, kind: F.when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(term(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat_ws(" ", term(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)
