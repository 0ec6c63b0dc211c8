"""Cases: neighbouring suspicious events of one key, broken by gaps, as reviewable objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import case_severity, confidence_band
from tidewatch.operators import identity
from tidewatch.operators.patterns import MINUTE, micros


def _kinds(minutes: int) -> list[tuple[str, Column, list[Column], int, bool]]:
    """(type, which events, key, window in minutes, whether several users are needed)."""
    c, none = F.col, lambda x, y: F.coalesce(x, F.lit(y))
    ip, asn = none(c("ip_address"), "no-ip"), none(c("asn"), "no-asn")
    return [
        ("session_takeover_case", c("is_anomaly") & ((c("takeover_score") >= 0.58) | (c("takeover_sequence_score") >= 0.5)), [c("user_id"), F.coalesce("session_id", "ip_address", F.lit("no-session"))], minutes, False),
        ("password_spray_case", c("password_spray_score") >= 0.5, [ip, asn], minutes, False),
        ("low_and_slow_campaign_case", c("low_and_slow_score") >= 0.5, [ip, asn], max(minutes, 180), False),
        ("coordinated_identity_campaign_case", (c("campaign_score") >= 0.55) | (c("relationship_score") >= 0.55), [ip, F.coalesce("device_fingerprint", "user_agent", F.lit("no-device")), asn], minutes, True),
    ]


#: Said of a case whose events have no signal over its threshold.
NO_REASON = "The events were joined by their signals alone."
SCORES = ("takeover_score", "takeover_sequence_score", "campaign_score", "password_spray_score", "low_and_slow_score")


def aggregate(signals: DataFrame, minutes: int = 30) -> DataFrame:
    """Cases of four types from events with identity signals and is_anomaly, joined while steps stay within the window.

    An event is marked with all types that it belongs to in one pass, so the
    signals are computed once and one shuffle by (type, key) builds all cases.
    ``reasons`` are the first four different sentences of a case's events, in
    their order; ``indices`` are all its events, ``representatives`` the first
    twelve.
    """
    marks = [F.when(which, F.struct(F.lit(kind).alias("case_type"), F.concat_ws("\u0001", *key).alias("__key"), F.lit(window * MINUTE).alias("__gap"), F.lit(2 if several else 1).alias("__least"))) for kind, which, key, window, several in _kinds(minutes)]
    columns = ("event_index", "timestamp", "user_id", "session_id", "ip_address", "asn", "device_fingerprint", "user_agent")
    said = F.col("reasons") if "reasons" in signals.columns else identity.reasons() if set(identity.SIGNALS) <= set(signals.columns) else F.array().cast("array<string>")
    rows = signals.select(*columns, said.alias("__said"), F.greatest(*SCORES).alias("__score"), F.inline(F.filter(F.array(*marks), lambda x: x.isNotNull())))
    w = Window.partitionBy("case_type", "__key").orderBy("timestamp", "event_index")
    new = F.coalesce((micros() - F.lag(micros()).over(w) > F.col("__gap")).cast("int"), F.lit(0))
    names = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    rows = rows.withColumn("__case", F.sum(new).over(w))
    keys = ["case_type", "__key", "__case"]
    # an event goes in once for itself and once for each of its sentences, so one pass gives the case and the first of its sentences
    sentences = F.transform("__said", lambda x, i: F.struct(i.alias("at"), x.alias("why")))
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("why")))
    each = rows.withColumn("__e", F.explode(F.concat(itself, sentences))).withColumn("__why", F.col("__e.why"))
    own = lambda c: F.when(F.col("__why").isNull(), F.col(c))
    parts = {
        "least": F.max("__least"),
        "indices": F.sort_array(F.collect_set(own("event_index"))),
        "score": F.max("__score"),
        "first_seen": micros(F.min("timestamp")),
        "last_seen": micros(F.max("timestamp")),
        "n_users": F.size(F.collect_set(own("user_id"))),
        **{n: names(own(c)) for c, n in (("user_id", "users"), ("session_id", "sessions"), ("ip_address", "ips"), ("asn", "asns"))},
        "devices": F.concat_ws(",", F.array_sort(F.array_union(F.collect_set(own("device_fingerprint")), F.collect_set(own("user_agent"))))),
    }
    grouped = each.groupBy(*keys, "__why").agg(F.min(F.struct("timestamp", "event_index", "__e.at")).alias("__first"), F.struct(*[v.alias(k) for k, v in parts.items()]).alias("__own"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__why").isNotNull(), "__first"))
    few = grouped.withColumn("__place", place).where(F.col("__place") <= 5)
    said_first = F.transform(F.sort_array(F.collect_list(F.when(F.col("__why").isNotNull(), F.struct("__place", "__why")))), lambda x: x["__why"])
    built = few.groupBy(*keys).agg(F.first(F.when(F.col("__why").isNull(), F.col("__own")), ignorenulls=True).alias("__own"), said_first.alias("reasons"))
    built = built.select("case_type", "__own.*", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(NO_REASON))).alias("reasons")).where("n_users >= least")
    n = F.size("indices")
    digest = F.substring(F.sha1(F.concat("case_type", F.lit(":"), F.concat_ws(",", F.transform("indices", lambda x: x.cast("string"))))), 1, 12)
    return built.select(
        F.concat("case_type", F.lit(":"), digest).alias("case_id"),
        "case_type",
        case_severity(F.col("score"), n).alias("severity"),
        confidence_band(F.col("score")).alias("confidence"),
        "score",
        n.alias("n_events"),
        "first_seen",
        "last_seen",
        "users",
        "sessions",
        "ips",
        "devices",
        "asns",
        F.concat_ws(",", F.transform(F.slice("indices", 1, 12), lambda x: x.cast("string"))).alias("representatives"),
        "reasons",
        "indices",
    )


#: The case type that each injection should lead to.
EXPECTED = {
    "session_hijack": "session_takeover_case",
    "password_spraying": "password_spray_case",
    "low_and_slow": "low_and_slow_campaign_case",
    "coordinated_campaign": "coordinated_identity_campaign_case",
    "mfa_bypass": "session_takeover_case",
    "identity_drift": "session_takeover_case",
    "temporal_jitter": "coordinated_identity_campaign_case",
}


def detection(cases: DataFrame, synthetic: DataFrame, injection: str) -> DataFrame:
    """Whether cases hold injected events (event_index of ``synthetic``) at any place, and one of the type expected for the injection."""
    members = cases.select("case_id", "case_type", F.explode("indices").alias("__i"))
    hit = members.join(synthetic.select(F.col("event_index").alias("__i")), "__i", "left_semi").select("case_id", "case_type").distinct()
    expected = EXPECTED.get(injection, "coordinated_identity_campaign_case")
    return hit.agg(F.count("*").alias("synthetic_cases"), F.coalesce(F.max((F.col("case_type") == expected).cast("int")), F.lit(0)).alias("matches_expected")).withColumn("expected_case_type", F.lit(expected))
