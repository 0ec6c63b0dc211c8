"""Log lines, tables and documents for what the engine finds: CEF, syslog, STIX, CSV, JSON, Markdown."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import log_safe, risk_grade


def severity_number(score: Column) -> Column:
    """3 to 10 from a score whose low values are anomalous."""
    return F.when(score < -0.4, 10).when(score < -0.2, 7).when(score < -0.1, 5).otherwise(3)


def cef(results: DataFrame, product: str = "tidewatch") -> DataFrame:
    """One CEF line per anomaly (score, confidence); every text is sanitised."""
    c = F.col
    line = F.concat(
        F.lit(f"CEF:0|{product}|{product}|1.0|anomaly|behavioural anomaly|"), severity_number(c("score")).cast("string"),
        F.lit("|rt="), F.date_format("timestamp", "MMM dd yyyy HH:mm:ss"), F.lit(" suser="), log_safe(c("user_id")), F.lit(" cs1="), log_safe(c("event_type")),
        F.lit(" cs1Label=EventType cfp1="), F.format_string("%.6f", c("score")), F.lit(" cfp1Label=AnomalyScore cfp2="), F.format_string("%.4f", c("confidence")), F.lit(" cfp2Label=Confidence"),
    )
    return results.where("is_anomaly").select(line.alias("value"))


def cef_rules(matches: DataFrame, product: str = "tidewatch") -> DataFrame:
    """One CEF line per rule match, five of its users at most named."""
    number = F.when(F.col("severity") == "critical", "10").when(F.col("severity") == "high", "7").when(F.col("severity") == "medium", "5").otherwise("3")
    at = F.date_format(F.timestamp_micros("matched_at"), "MMM dd yyyy HH:mm:ss")
    users = log_safe(F.concat_ws(",", F.slice(F.split("users", ","), 1, 5)))
    rule = log_safe(F.col("rule_id"))
    line = F.concat(F.lit(f"CEF:0|{product}|{product}|1.0|"), rule, F.lit("|"), F.replace(rule, F.lit("_"), F.lit(" ")), F.lit("|"), number, F.lit("|rt="), at, F.lit(" suser="), users, F.lit(" cs1="), rule, F.lit(" cs1Label=RuleID cnt="), F.col("n_events").cast("string"), F.lit(" msg="), log_safe(F.col("details"), 200))
    return matches.select(line.alias("value"))


def syslog(results: DataFrame, app: str = "tidewatch") -> DataFrame:
    """One RFC 5424 line per anomaly, facility 10."""
    level = F.when(F.col("score") < -0.4, 2).when(F.col("score") < -0.2, 3).when(F.col("score") < -0.1, 4).otherwise(6)
    line = F.concat(
        F.lit("<"), (80 + level).cast("string"), F.lit(">1 "), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f" - {app} - - - user="), log_safe(F.col("user_id")), F.lit(" event="), log_safe(F.col("event_type")),
        F.lit(" score="), F.format_string("%.4f", F.col("score")), F.lit(" confidence="), F.format_string("%.2f", F.col("confidence")), F.lit(" anomaly=true"),
    )
    return results.where("is_anomaly").select(line.alias("value"))


def stix_objects(results: DataFrame) -> DataFrame:
    """One STIX 2.1 observed-data object per anomaly, as JSON with an id that its event fixes."""
    digest = F.md5(F.concat_ws("|", "event_index", "user_id", F.unix_micros("timestamp")))
    name = F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.struct(
        F.lit("observed-data").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("observed-data--"), name).alias("id"), at.alias("created"), at.alias("modified"),
        at.alias("first_observed"), at.alias("last_observed"), F.lit(1).alias("number_observed"), F.col("user_id").alias("x_user_id"), F.col("event_type").alias("x_event_type"), F.round("score", 6).alias("x_score"),
    )
    return results.where("is_anomaly").select(F.to_json(body).alias("value"))


def stix_bundle(objects: list[str]) -> str:
    """A bundle document around objects; meant for a report's worth of them."""
    return json.dumps({"type": "bundle", "id": f"bundle--{uuid.uuid4()}", "objects": [json.loads(o) for o in objects]}, indent=2)


def write_csv(df: DataFrame, path: str) -> None:
    """A table with nested columns as JSON text, CSV with a header."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def report(summary: DataFrame, top: int = 20, title: str = "Risk report") -> str:
    """A Markdown report of the ``top`` users by anomaly rate, with totals over all."""
    totals = summary.agg(F.count("*").alias("users"), F.sum("n_events").alias("events"), F.sum("n_anomalies").alias("anomalies")).first()
    rate = (totals["anomalies"] or 0) / max(totals["events"] or 0, 1)
    rows = summary.withColumn("grade", risk_grade(F.col("anomaly_rate"), F.col("min_score"))).orderBy(F.desc("anomaly_rate"), "user_id").limit(top).collect()
    lines = [f"# {title}", "", f"{totals['users']} users, {totals['events'] or 0} events, {totals['anomalies'] or 0} anomalies ({rate:.2%}).", "", "| user | events | anomalies | rate | risk | grade |", "|-|-|-|-|-|-|"]
    lines += [f"| {r['user_id']} | {r['n_events']} | {r['n_anomalies']} | {r['anomaly_rate']:.2%} | {r['risk']} | {r['grade']} |" for r in rows]
    return "\n".join(lines) + "\n"


def benchmark_report(tables: dict[str, DataFrame], setup: dict | None = None, most_cases: int = 8) -> str:
    """A Markdown report of a benchmark's tables: rates, robustness, slices, case detection and the ``most_cases`` highest cases."""
    lines = ["# Benchmark", ""] + [f"- {k}: {v}" for k, v in (setup or {}).items()]
    rates: dict = {}
    for r in tables["rates"].collect():  # a row per method and limit
        rates.setdefault(r["target_fpr"], {})[r["method"]] = r["detection_rate"]
    methods = sorted({m for x in rates.values() for m in x})
    lines += ["", "## Detection rates", "", "| false positives | " + " | ".join(methods) + " |", "|-|" + "-|" * len(methods)]
    lines += [f"| {limit} | " + " | ".join(f"{x.get(m) or 0.0:.3f}" for m in methods) + " |" for limit, x in sorted(rates.items())]
    for name, title in (("robustness", "Robustness"), ("slices", "Slices"), ("cases", "Case detection")):
        if name in tables:
            df = tables[name]
            lines += ["", f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
            lines += ["| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.collect()]
    if "found" in tables:
        lines += ["", "## Cases", ""]
        for r in tables["found"].orderBy(F.desc("score"), "case_id").limit(most_cases).collect():
            lines += [f"### {r['case_id']}", "", f"{r['case_type']}, {r['severity']}, confidence {r['confidence']}, score {r['score']:.3f}, events {r['representatives']}, users {r['users']}", ""] + [f"- {x}" for x in r["reasons"]] + [""]
    return "\n".join(lines) + "\n"


def read_results(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Results or user summaries as ``write_ndjson`` wrote them, also one JSON document with them under ``events`` or in an envelope.

    Give the schema of what was written to get its types back; times without
    one come back as text.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    lines = reader.json(path)
    names = set(lines.columns)
    if schema is None and (names <= {"events", "users", "_corrupt_record"} or {"kind", "payload"} <= names):
        whole = spark.read.option("multiLine", True).json(path)
        whole = whole.select("payload.*") if "payload" in whole.columns else whole
        return whole.select(F.inline("events" if "events" in whole.columns else "users"))
    return lines


def timeline(events: DataFrame, width: int = 40) -> str:
    """Events by hour of the day as bars of text."""
    counts = {r["h"]: r["n"] for r in events.groupBy(F.hour("timestamp").alias("h")).agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=1)
    return "\n".join(f"{h:02d} {'#' * round(counts.get(h, 0) / most * width)} {counts.get(h, 0)}" for h in range(24))


def envelope(kind: str, payload, schema_version: str = "1.0") -> dict:
    return {"kind": kind, "schema_version": schema_version, "generated_at": datetime.now(timezone.utc).isoformat(), "payload": payload}


def unwrap(document):
    """The payload of an envelope, anything else as it is."""
    return document["payload"] if isinstance(document, dict) and {"kind", "payload"} <= set(document) else document
