"""All queries of the engine's own operators, with the SQL that each must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rules
from tidewatch.plans import queries_engine, queries_features, queries_rules, queries_scores
from tidewatch.sources.readers import stream_table

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (queries_rules, queries_features, queries_scores, queries_engine):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule matches of impossible travel and shared addresses, summed up by user."""
    found = rules.evaluate(stream_table(spark, sf_dir), ["impossible_travel", "mfa_bypass", "session_hijack"])
    users = found.select("rule_id", "severity", F.explode(F.split("users", ",")).alias("user_id"), "n_events")
    return users.groupBy("user_id").agg(
        F.count("*").alias("matches"), F.sum("n_events").alias("events"), F.concat_ws(",", F.sort_array(F.collect_set("rule_id"))).alias("rules"), F.max((F.col("severity") == "critical").cast("int")).alias("critical")
    )
