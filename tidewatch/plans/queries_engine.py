"""Queries of models, injections, statistics, threat lists and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import engine
from tidewatch.functions.scalar import flag
from tidewatch.models.outliers import Ensemble, IsolationForest, LocalOutlierFactor, Scaler, explain
from tidewatch.operators import features
from tidewatch.operators.inject import TYPES, inject
from tidewatch.plans.queries_scores import RAW, models, rounded
from tidewatch.plans.sql import EVENTS
from tidewatch.sources.readers import stream_table

FEATURES = ["a", "b", "c"]


def _scaled(kind):
    def run(s, d):
        df = models(s, d)
        return rounded(Scaler(kind).fit(df, FEATURES).transform(df).select("event_index", *FEATURES))

    return run


def _explained(s, d):
    df = models(s, d)
    top = explain(FEATURES, Scaler().fit(df, FEATURES), 2)
    return df.select("event_index", F.concat_ws(",", F.transform(top, lambda x: x["feature"])).alias("top"))


def _injected(kind):
    def run(s, d):
        out = inject(stream_table(s, d), kind)
        return out.where("synthetic").groupBy("injection_type", "event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))

    return run


def _ensemble(s, d):
    df = models(s, d)
    return rounded(Ensemble([IsolationForest(), LocalOutlierFactor()]).fit(df, FEATURES).predict(df))


def _threats(s, d):
    listed = s.createDataFrame([("ip", "10.0.0.3"), ("asn", "AS64501"), ("country", "RU"), ("ip", "10.0.0.3")], "kind string, indicator string")
    df = features.listed(features.ordered(stream_table(s, d)), listed)
    return df.select("event_index", "is_threat_ip", "is_threat_asn", "is_threat_country")


def _known_vectors(s, d):
    """How many vectors there are, how many lengths, and their mean square."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return rows.agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("lengths"), F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("mean_square"))


QUERIES = {
    "standard_scale": _scaled("standard"),
    "robust_scale": _scaled("robust"),
    "explain_features": _explained,
    "isolation_forest": lambda s, d: rounded(IsolationForest().fit(models(s, d), FEATURES).predict(models(s, d))),
    "lof": lambda s, d: rounded(LocalOutlierFactor().fit(models(s, d), FEATURES).predict(models(s, d))),
    "ensemble": _ensemble,
    "validate_stats": lambda s, d: engine.statistics(stream_table(s, d)),
    "type_counts": lambda s, d: stream_table(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("success"), 1)).alias("successes")),
    "event_predicates": lambda s, d: stream_table(s, d).select("event_index", flag(F.col("event_type").isin("failed_login", "mfa_failure")).alias("is_failure"), (F.weekday("timestamp") >= 5).alias("is_weekend"), F.hour("timestamp").cast("long").alias("hour")),
    "threat_flags": _threats,
    "vector_stats": _known_vectors,
    **{f"inject_{k}": _injected(k) for k in TYPES},
}

_SEEN = "row_number() OVER (PARTITION BY user_id ORDER BY us, event_index) > 1"
ORACLES = {
    "standard_scale": f"WITH {RAW}, m AS (SELECT {', '.join(f'avg({x}) AS m{x}, stddev_pop({x}) AS s{x}' for x in FEATURES)} FROM raw) SELECT event_index, {', '.join(f'round(({x} - m{x}) / s{x}, 6) + 0 AS {x}' for x in FEATURES)} FROM raw, m",
    "robust_scale": f"WITH {RAW}, m AS (SELECT {', '.join(f'quantile_cont({x}, 0.5) AS m{x}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS s{x}' for x in FEATURES)} FROM raw) SELECT event_index, {', '.join(f'round(({x} - m{x}) / s{x}, 6) + 0 AS {x}' for x in FEATURES)} FROM raw, m",
    "explain_features": f"""WITH {RAW}, m AS (SELECT {', '.join(f'avg({x}) AS m{x}, stddev_pop({x}) AS s{x}' for x in FEATURES)} FROM raw),
z AS (SELECT event_index, unnest(['a', 'b', 'c']) AS f, unnest([{', '.join(f'abs({x} - m{x}) / s{x}' for x in FEATURES)}]) AS v FROM raw, m), r AS (SELECT *, row_number() OVER (PARTITION BY event_index ORDER BY v DESC, f) AS i FROM z)
SELECT event_index, string_agg(f, ',' ORDER BY i) AS top FROM r WHERE i <= 2 GROUP BY 1""",
    "validate_stats": f"""WITH {EVENTS} SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types, min(us) AS first_at, max(us) AS last_at, {', '.join(f'count({c}) AS with_{c}' for c in ('ip_address', 'asn', 'country_code', 'user_agent', 'device_fingerprint', 'session_id', 'session_duration_seconds', 'mfa_used', 'success'))}, 0::BIGINT AS with_auth_method FROM ev""",
    "type_counts": f"WITH {EVENTS} SELECT event_type, count(*) AS n, count(*) FILTER (success) AS successes FROM ev GROUP BY 1",
    "event_predicates": f"WITH {EVENTS} SELECT event_index, failed::INT::DOUBLE AS is_failure, isodow(timestamp) >= 6 AS is_weekend, hour(timestamp) AS hour FROM ev",
    "threat_flags": f"WITH {EVENTS}, s AS (SELECT *, {_SEEN} AS seen FROM ev) SELECT event_index, (seen AND ip_address = '10.0.0.3')::INT::DOUBLE AS is_threat_ip, (seen AND asn = 'AS64501')::INT::DOUBLE AS is_threat_asn, (seen AND country_code = 'RU')::INT::DOUBLE AS is_threat_country FROM s",
    "vector_stats": "SELECT count(*) AS n, count(DISTINCT len(embedding)) AS lengths, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS mean_square FROM embeddings",
}
