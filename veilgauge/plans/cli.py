"""Command line: scan (or score), compare, serve, build-db, benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.operators import anonymise, benchmark, build, population, providers, score
from veilgauge.plans import http, reports
from veilgauge.schema import Settings
from veilgauge.session import cut, ship
from veilgauge.sources import tables


def session() -> SparkSession:
    spark = SparkSession.builder.appName("veilgauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _cells(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return tables.population_parquet(spark, args.population, args.geography) if args.population else population.sample_for(spark, args.geography)


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r["json"]) for r in tables.as_json(df).collect()]


def _number(kind, least=None, below=None, most=None):
    """An argument type that checks its range."""

    def read(text: str):
        try:
            value = kind(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is no number") from None
        if (least is not None and value < least) or (below is not None and value >= below) or (most is not None and value > most):
            raise argparse.ArgumentTypeError(f"{text} is out of range")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilgauge", epilog="Exit status: 0; 1 if a score is above --fail-above; 2 for unusable input.")
    sub = p.add_subparsers(dest="command", required=True)
    scorer = argparse.ArgumentParser(add_help=False)
    scorer.add_argument("--geography", default="US")
    scorer.add_argument("--population", "--population-db")
    scorer.add_argument("--provider", default="rule_based")
    scorer.add_argument("--model")
    scorer.add_argument("--confidence-threshold", type=_number(float, 0, most=1), default=Settings().confidence_threshold)
    scorer.add_argument("--strict", action="store_true", help="an answer that can't be read is an error, not left to the rules")
    gate = argparse.ArgumentParser(add_help=False)
    gate.add_argument("--fail-above", type=_number(float, 0, below=1))
    s = sub.add_parser("scan", aliases=["score"], parents=[scorer, gate], help="score text files, - being standard input")
    s.add_argument("paths", nargs="+")
    s.add_argument("--json", action="store_true", help="print the results as JSON (the default without --text)")
    s.add_argument("--text", action="store_true", help="print a line per text")
    s.add_argument("--report", choices=sorted(reports.STANDARDS))
    s.add_argument("--format", "--report-format", choices=reports.FORMATS, default="json")
    s.add_argument("--output", "--report-output")
    c = sub.add_parser("compare", parents=[scorer, gate], help="risk of a text before and after anonymisation")
    c.add_argument("original")
    c.add_argument("anonymised")
    v = sub.add_parser("serve", parents=[scorer], help="the HTTP facade")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=_number(int, 0, most=65535), default=8080)
    b = sub.add_parser("build-db", help="population cells from person rows")
    b.add_argument("csv")
    b.add_argument("output")
    b.add_argument("--geography", required=True)
    b.add_argument("--survey", action="store_true")
    b.add_argument("--column", action="append", default=[], metavar="ATTRIBUTE=COLUMN")
    b.add_argument("--age")
    b.add_argument("--weight")
    b.add_argument("--value-map", action="append", default=[], metavar="ATTRIBUTE:CODE=LABEL")
    b.add_argument("--source-label", default="", help="where the rows come from, kept in the metadata")
    b.add_argument("--note", action="append", default=[])
    b.add_argument("--force", action="store_true")
    m = sub.add_parser("benchmark", help="evaluate anonymisers on a population file")
    m.add_argument("csv")
    m.add_argument("--profile", default="paper", choices=sorted(benchmark.PROFILES))
    m.add_argument("--records", type=_number(int, 1))
    m.add_argument("--indirect", type=_number(int, 1, most=len(benchmark.INDIRECT)))
    m.add_argument("--direct", type=_number(int, 0, most=len(benchmark.DIRECT)))
    m.add_argument("--theta0", type=_number(float, 0, most=1))
    m.add_argument("--theta", type=_number(float, 0, most=1))
    m.add_argument("--seed", type=int)
    m.add_argument("--anonymiser", action="append", choices=anonymise.ANONYMISERS.names())
    m.add_argument("--provider", default="rule_based", help="who attacks")
    m.add_argument("--model")
    m.add_argument("--output")
    return p


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, text, idx): the texts in the order of the arguments; those of a folder or a pattern come after single files."""
    files = [p for p in paths if p != "-"]
    own = [("<stdin>", sys.stdin.read())] if "-" in paths else []
    out = spark.createDataFrame(own, "source string, text string")
    out = out.unionByName(tables.text_files(spark, files)) if files else out
    given = F.array(*[F.lit("<stdin>" if p == "-" else os.path.abspath(p)) for p in paths])
    place = F.array_position(given, F.regexp_replace("source", "^file:/+", "/"))
    return out.withColumn("idx", F.when(place > 0, place - 1).otherwise(F.monotonically_increasing_id() + len(paths)))


def main(argv: list[str] | None = None) -> int:
    """0; 1 if a score is above --fail-above; 2 for unusable input."""
    args = parser().parse_args(argv)
    try:
        spark = session()
        if args.command == "build-db":
            maps: dict[str, dict[str, str]] = {}
            for x in args.value_map:
                attribute, _, pair = x.partition(":")
                code, _, name = pair.partition("=")
                if not (attribute and code and name):
                    raise ValueError(f"{x!r} is no ATTRIBUTE:CODE=LABEL")
                maps.setdefault(attribute, {})[code] = name
            if any("=" not in x for x in args.column):
                raise ValueError("--column needs ATTRIBUTE=COLUMN")
            recipe = (build.SURVEY if args.survey else build.Recipe()).merged(dict(x.split("=", 1) for x in args.column), args.age, args.weight, maps)
            _, summary = build.build(tables.person_csv(spark, args.csv), recipe, args.geography, args.output, args.force, args.source_label, tuple(args.note))
            print(json.dumps(vars(summary), indent=1))
            return 0
        if args.command == "benchmark":
            people = tables.benchmark_csv(spark, args.csv).withColumn("row_id", F.monotonically_increasing_id()).persist()
            given = {"n_records": args.records, "n_indirect": args.indirect, "n_direct": args.direct, "theta0": args.theta0, "theta": args.theta, "seed": args.seed}
            profile = benchmark.get_profile(args.profile, **{k: v for k, v in given.items() if v is not None})
            made = cut(benchmark.entries(people, profile))
            own = [anonymise.get(a) for a in args.anonymiser] if args.anonymiser else None
            summary, recall = benchmark.evaluated(made, people, own, theta=profile.theta, attacker=providers.get(args.provider, args.model))
            out = json.dumps({"profile": vars(profile), "entries": _rows(made.orderBy("entry")), "anonymisers": _rows(summary), "recall": _rows(recall)}, indent=1, ensure_ascii=False)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    f.write(out)
            else:
                print(out)
            return 0
        cells = _cells(spark, args)
        settings = Settings(args.geography, args.confidence_threshold, args.provider, args.model, args.strict)
        providers.model_of(settings.attacker, settings.model)
        if args.command == "serve":
            server = http.serve(spark, args.host, args.port, settings, cells if args.population else None)
            print(f"listening on {args.host}:{server.server_address[1]}", file=sys.stderr)
            server.serve_forever()
            return 0
        if args.command == "compare":
            pair = [(1, "before", open(args.original, encoding="utf-8").read()), (2, "after", open(args.anonymised, encoding="utf-8").read())]
            df = spark.createDataFrame(pair, "id int, side string, text string")
            scored = score.score(df, cells, "id", settings=settings).join(df.select("id", "side"), "id").withColumn("pair_id", F.lit(1))
            print(json.dumps(_rows(score.compare(scored))[0], indent=1))
            return int(args.fail_above is not None and score.above(scored.where("side = 'after'"), args.fail_above))
        texts = _texts(spark, args.paths)
        scored = score.score(texts, cells, "idx", settings=settings).join(texts.select("idx", "source"), "idx").persist()
        score.collected(scored, "idx")
        summary = score.summarize(scored).first().asDict()
        if args.report:
            made = reports.generate(scored, summary, args.report, args.format, args.output)
            if not args.output:
                sys.stdout.buffer.write(made if isinstance(made, bytes) else made.encode())
        elif args.text and not args.json:
            for r in scored.orderBy("idx").select("source", reports.record_lines(F.col("idx") + 1).alias("line")).collect():
                print(f"{r['source']}: {r['line']}")
        else:
            print(json.dumps({"results": _rows(scored.orderBy("idx")), "summary": summary}, indent=1, ensure_ascii=False))
        return int(args.fail_above is not None and score.above(scored, args.fail_above))
    except (ValueError, OSError, score.BatchError) as e:
        print(f"veilgauge: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
