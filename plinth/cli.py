"""Command line: info, match, assess and extract."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from plinth import registry
from plinth.functions.progress import Progress
from plinth.operators import incidents, motifs, risk
from plinth.plans.settings import Settings
from plinth.plans.vocabulary import Vocabulary
from plinth.sources import reports as report_io
from plinth.sources import turtle
from plinth.sources.graph import graph_of

log = logging.getLogger("plinth")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plinth", description=__doc__)
    parser.add_argument("--verbose", action="store_true", help="log what is done")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="list the registered queries")
    for name, what in (("match", "write motif match triples"), ("assess", "write risk finding triples")):
        one = commands.add_parser(name, help=what)
        one.add_argument("--graph", nargs="+", required=True, help="Turtle files")
        one.add_argument("--out", required=True, help="folder of N-Triples")
        for f in fields(Vocabulary):
            if f.name != "taxonomies":
                one.add_argument(f"--{f.name}", default=f.default, help="IRI base that the files declare")
        one.add_argument("--taxonomy", action="append", default=[], metavar="PREFIX=BASE", help="IRI base of a taxonomy, any number of times")
    extract = commands.add_parser("extract", help="reports to records")
    extract.add_argument("--reports", required=True, help="CSV file")
    extract.add_argument("--out", required=True, help="folder of JSON lines")
    extract.add_argument("--endpoint", help="else of the settings")
    extract.add_argument("--model", help="else of the settings")
    extract.add_argument("--most", type=int, help="reports to take, 0 for all; else of the settings")
    extract.add_argument("--env", help="file of PLINTH_<NAME>=value lines")
    return parser


def _vocabulary(args: argparse.Namespace) -> Vocabulary:
    taxonomies = dict(Vocabulary().taxonomies) | dict(x.split("=", 1) for x in args.taxonomy)
    return Vocabulary(args.core, args.pattern, args.catalogue, args.generated, tuple(taxonomies.items()))


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    own = Settings.of(spark, args.env)
    most = own.most_reports if args.most is None else args.most or None
    client = Settings(args.endpoint or own.endpoint, args.model or own.model).client()
    reports = incidents.limited(incidents.normalised(report_io.read_reports(spark, args.reports)), most)
    seen = Observation("records")
    progress = Progress(spark, "model calls")
    records = incidents.extract(incidents.relevance_gate(reports, client, counters=progress.counters), client, counters=progress.counters)
    failed = F.coalesce(F.col("meta.relevance_reason"), F.lit("")).startswith(incidents.FAILED)
    log.info("extracting at most %s reports of %s", most or "all", args.reports)
    with progress:
        report_io.write_records(records.observe(seen, F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("meta.is_relevant")).alias("n_relevant"), F.count_if(failed).alias("n_failed")), args.out)
    log.info("wrote %s: %s", args.out, seen.get)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    if args.command == "info":
        for name in registry.QUERIES:
            print(name, "(with SQL oracle)" if name in registry.ORACLES else "")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "extract":
        _extract(spark, args)
        return 0
    names = _vocabulary(args)
    graph = graph_of(turtle.read_turtle(spark, args.graph, "arch"), names).written()
    found = {m: motifs.solutions(graph, m) for m in motifs.MOTIFS}
    if args.command == "match":
        out = motifs.match_triples(found[motifs.VECTOR_IR], motifs.VECTOR_IR, names).unionByName(motifs.match_triples(found[motifs.LLM_IR], motifs.LLM_IR, names))
    else:
        leak, confab = risk.leakage(graph, found[motifs.VECTOR_IR], names), risk.confabulation(graph, found[motifs.LLM_IR], names)
        out = risk.finding_triples(leak, risk.LEAKAGE, names).unionByName(risk.finding_triples(confab, risk.CONFABULATION, names))
    is_iri = F.col("o").rlike(r"^[A-Za-z][\w+.-]*://\S*$")
    rows = out.select("s", F.lit("iri").alias("s_kind"), "p", "o", F.when(is_iri, "iri").when(F.col("o").startswith("_:"), "bnode").otherwise("literal").alias("o_kind"), F.when(F.col("p").rlike("(#label|/description)$"), "en").alias("lang"), F.lit(None).cast("string").alias("dt"))
    seen = Observation("triples")
    turtle.write_ntriples(rows.observe(seen, F.count(F.lit(1)).alias("n_triples")), args.out)
    log.info("wrote %s: %s", args.out, seen.get)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
