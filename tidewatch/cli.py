"""Command line: run, train, detect, watch, rules, correlate, report, export, baseline, info, bench, doctor."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewatch import engine
from tidewatch.config import Config
from tidewatch.models.outliers import REGISTRY, load
from tidewatch.operators import features, rules
from tidewatch.operators.inject import TYPES
from tidewatch.sinks import formats
from tidewatch.sources.readers import exists, read_events
from tidewatch.streaming import live


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewatch")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("run", "score a log"), ("rules", "match attack patterns"), ("correlate", "find users that act together"), ("baseline", "profiles of users"), ("info", "what a log holds"), ("report", "risk report"), ("export", "log lines of anomalies")):
        c = sub.add_parser(name, help=about)
        c.add_argument("log")
        c.add_argument("--out")
        c.add_argument("--config")
        if name == "export":
            c.add_argument("--format", choices=("cef", "syslog", "stix", "json", "csv"), default="cef")
    t = sub.add_parser("train", help="fit a detector on a log and save it")
    t.add_argument("log")
    t.add_argument("model")
    t.add_argument("--detector", choices=sorted(REGISTRY), default="isolation_forest")
    t.add_argument("--config")
    w = sub.add_parser("watch", help="score each file that appears in a folder")
    w.add_argument("folder")
    w.add_argument("out")
    w.add_argument("--model")
    w.add_argument("--pattern", default="*")
    w.add_argument("--every", help="seconds between looks; without it, what is there is scored")
    w.add_argument("--config")
    d = sub.add_parser("detect", help="score a log by a saved model, or by one of another log")
    d.add_argument("train", help="a folder that train wrote, or a log")
    d.add_argument("log")
    d.add_argument("--out")
    d.add_argument("--config")
    b = sub.add_parser("bench", help="inject an attack and measure who finds it")
    b.add_argument("log")
    b.add_argument("--attack", choices=sorted(TYPES), default="session_hijack")
    b.add_argument("--config")
    sub.add_parser("init", help="print a starter configuration")
    sub.add_parser("doctor", help="check the installation")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "init":
        from dataclasses import asdict

        print(json.dumps(asdict(Config()), indent=2))
        return 0
    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "doctor":
        print(json.dumps({"spark": spark.version, "python": sys.version.split()[0], "rows": spark.range(3).count()}))
        return 0
    config = Config.load(a.config) if a.config else Config()
    if a.command == "watch":
        model = load(spark, a.model) if a.model else None

        def scored(events, path):
            """Without a model, each file is judged by one of its own."""
            name = path.rstrip("/").rsplit("/", 1)[-1]
            formats.write_ndjson(engine.detect(events, events, config, model=model).results, f"{a.out}/{name}")

        live.watch_files(spark, a.folder, scored, f"{a.out}/.checkpoint", a.pattern, every=f"{a.every} seconds" if a.every else None).awaitTermination()
        return 0
    events = read_events(spark, a.log)
    if a.command == "train":
        engine.train(events, config, a.detector, a.model)
        return 0
    show = lambda df: df.write.json(a.out) if getattr(a, "out", None) else df.show(20, truncate=60)
    if a.command == "info":
        show(engine.statistics(events))
    elif a.command == "rules":
        show(rules.evaluate(events, parameters=config.rules))
    elif a.command == "correlate":
        show(rules.correlate(events))
    elif a.command == "baseline":
        show(features.profiles(events))
    elif a.command == "run":
        show(engine.run(events, config).cases)
    elif a.command == "detect":
        saved = exists(spark, f"{a.train.rstrip('/')}/model")
        show(engine.detect(None if saved else read_events(spark, a.train), events, config, model=load(spark, a.train) if saved else None).users)
    elif a.command == "report":
        print(formats.report(engine.detect(events, events, config).users))
    elif a.command == "bench":
        print(formats.benchmark_report(engine.benchmark(events, a.attack, config), {"log": a.log, "attack": a.attack}))
    elif a.command == "export":
        results = engine.run(events, config).results
        lines = {"cef": formats.cef, "syslog": formats.syslog, "stix": formats.stix_objects}
        if a.format in lines:
            found = lines[a.format](results)
            formats.write_lines(found, a.out) if a.out else found.show(20, truncate=False)
        else:
            (formats.write_csv if a.format == "csv" else formats.write_ndjson)(results, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
