"""Queries of the score algebra, circular statistics, monitors, cases, evaluation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scalar import angular_distance, case_severity, confidence_band, cyclic, risk_grade
from tidewatch.models import outliers
from tidewatch.operators import cases, circular, evaluate, identity, monitor, rules, scoring
from tidewatch.plans.queries_features import SAID, SIGNALS
from tidewatch.plans.sql import EVENTS, bursts, user_order
from tidewatch.sinks import formats
from tidewatch.sources.readers import stream_table

O = user_order()  # noqa: E741
MODELS = ["a", "b", "c"]
#: Moves means of hundredths off exact ties, which the two engines round apart.
TIE = 3e-9


def models(spark, d):
    """Events with three raw scores: the duration, the number in the source event's properties, the hour with minutes."""
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("__i"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("b"))
    ev = stream_table(spark, d)
    return ev.join(raw, F.col("event_index") == F.col("__i")).drop("__i").withColumns({"a": F.col("session_duration_seconds"), "c": F.hour("timestamp") + F.minute("timestamp") / 60.0})


def normalised(spark, d, strategy="minmax"):
    df = models(spark, d)
    return scoring.Normaliser(strategy).fit(df, MODELS).transform(df)


def rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _norm(strategy):
    return lambda s, d: rounded(normalised(s, d, strategy).select("event_index", *MODELS))


def _vote(strategy, **more):
    return lambda s, d: rounded(normalised(s, d).select("event_index", scoring.vote(MODELS, strategy, **more).alias("ensemble")))


def _pipeline(s, d):
    df = models(s, d)
    out = scoring.Pipeline(MODELS, "median").fit(df).score(df)
    return rounded(out.select("event_index", "ensemble", "disagreement", "variance", "is_anomaly"))


def _scored(s, d):
    return scoring.scored(models(s, d).withColumn("score", -F.col("a")), "score")


def _feedback(s, d):
    """Verdicts out of the events: users are analysts, the number in the properties is the event that they judge."""
    ev = s.read.parquet(f"{d}/events.parquet")
    verdict = F.element_at(F.array(F.lit("fp"), F.lit("tp"), F.lit("unsure")), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(F.concat(F.lit("e"), F.regexp_extract("props", "[0-9]+", 0)).alias("event_id"), verdict.alias("verdict"), F.concat(F.lit("a"), (F.col("user_id") % 40).cast("string")).alias("analyst_id"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("user_id"), F.col("ts").cast("timestamp").alias("at"))


def _gate(s, d):
    df = normalised(s, d)
    rows = df.select("event_index", "user_id", "timestamp", scoring.vote(MODELS).alias("score"), F.col("b").alias("nll"), scoring.disagreement(MODELS).alias("jsd"))
    return monitor.gated(rows, tau=0.6, jsd_floor=0.1)


def _triage(s, d):
    df = normalised(s, d).withColumns({"score": scoring.vote(MODELS), "threshold": F.lit(0.6), "nll": F.col("b"), "jsd": scoring.disagreement(MODELS)})
    return outliers.triage(outliers.triage_features(df), {"f_excess": -4.0, "f_jsd": 2.0, "f_mfa": 0.5, "f_success": 0.25}, 0.1)


def _cases(s, d):
    df = identity.signals(stream_table(s, d)).withColumn("is_anomaly", F.col("fusion_score") >= 0.3)
    return cases.aggregate(df).withColumn("reasons", F.concat_ws(";", "reasons")).drop("indices")


def _lines(write):
    def run(s, d):
        df = stream_table(s, d).withColumn("score", -F.col("session_duration_seconds") / 130)
        return write(df.withColumns({"is_anomaly": F.col("score") < -0.3, "confidence": F.lit(0.5)}))

    return run


def _drift(s, d):
    df = circular.moments(stream_table(s, d).withColumn("user_id", F.concat_ws("@", "user_id", F.date_format("timestamp", "yyyy-MM-dd"))), least=1)
    who, day = F.substring_index("user_id", "@", 1), F.substring_index("user_id", "@", -1)
    return monitor_drift(df.select(who.alias("user_id"), day.alias("at"), F.degrees("mean_angle").alias("degrees")))


def _drift_status(s, d):
    df = circular.moments(stream_table(s, d).withColumn("user_id", F.concat_ws("@", "user_id", F.date_format("timestamp", "yyyy-MM-dd"))), least=1)
    who, day = F.substring_index("user_id", "@", 1), F.substring_index("user_id", "@", -1)
    seen = df.select(who.alias("user_id"), day.alias("at"), F.degrees("mean_angle").alias("degrees"))
    resets = seen.where("user_id = 'u1'").groupBy("user_id").agg(F.max("at").alias("at"), F.lit(90.0).alias("degrees"))
    return rounded(circular.drift_status(seen, circular.drift_baselines(seen, resets=resets)), 4)


def monitor_drift(df):
    return rounded(circular.drift(df), 4).withColumnRenamed("at", "day")


QUERIES = {
    "normalise_minmax": _norm("minmax"),
    "normalise_quantile": _norm("quantile"),
    "vote_mean": _vote("mean"),
    "vote_median": _vote("median"),
    "vote_trimmed": _vote("trimmed_mean"),
    "vote_weighted": _vote("weighted", weights={"a": 2.0, "c": 0.5}),
    "disagreement": lambda s, d: rounded(normalised(s, d).select("event_index", scoring.disagreement(MODELS).alias("jsd"), scoring.softmax_entropy(MODELS).alias("entropy"), scoring.variance(MODELS).alias("variance"))),
    "score_pipeline": _pipeline,
    "sensitivity": lambda s, d: rounded(scoring.sensitivity(normalised(s, d), "a")),
    "scorer": lambda s, d: rounded(_scored(s, d).select("event_index", "is_anomaly", "confidence", "percentile_rank", (F.col("user_baseline") + TIE).alias("user_baseline"))),
    "user_summary": lambda s, d: rounded(scoring.user_summary(_scored(s, d), "score").withColumn("grade", risk_grade(F.round("anomaly_rate", 6), F.col("min_score") / 100)).withColumn("mean_score", F.col("mean_score") + TIE)),
    "score_distribution": lambda s, d: rounded(scoring.distribution(models(s, d), "a")),
    "cyclic_features": lambda s, d: rounded(stream_table(s, d).select("event_index", *[x.alias(f"{n}_{f}") for n, v, p in (("hour", F.hour("timestamp"), 24), ("day", F.weekday("timestamp"), 7), ("month", F.month("timestamp") - 1, 12)) for f, x in zip(("sin", "cos"), cyclic(v.cast("double"), p), strict=True)])),
    "von_mises_moments": lambda s, d: rounded(circular.moments(stream_table(s, d)), 5),
    "von_mises_fit": lambda s, d: rounded(circular.fit(stream_table(s, d)), 4),
    "hour_surprise": lambda s, d: rounded(circular.surprise(stream_table(s, d), circular.fit(stream_table(s, d))), 4),
    "online_von_mises": lambda s, d: rounded(circular.online(stream_table(s, d)), 5),
    "drift_alerts": _drift,
    "fleet_windows": lambda s, d: rounded(monitor.fleet_windows(stream_table(s, d), 60, 10)),
    "fleet_alerts": lambda s, d: rounded(monitor.cooled_down(monitor.fleet_alerts(monitor.fleet_windows(stream_table(s, d), 60, 10)), seconds=3600)),
    "alert_gate": lambda s, d: _gate(s, d).select("event_index", "ensemble_fired", "temporal_fired", "jsd_fired", "n_signals", "passes"),
    "alert_dedup": lambda s, d: monitor.deduplicated(stream_table(s, d), 86400, 2).select("event_index", "emitted"),
    "alert_severity": lambda s, d: normalised(s, d).select("event_index", monitor.alert_severity(scoring.vote(MODELS), F.lit(0.3), scoring.disagreement(MODELS) * 5).alias("severity")),
    "feedback_summary": lambda s, d: rounded(monitor.feedback_summary(_feedback(s, d))),
    "triage": lambda s, d: rounded(_triage(s, d)),
    "feedback_confirmed": lambda s, d: monitor.confirmed(_feedback(s, d), 12),
    "feedback_fp_rates": lambda s, d: rounded(monitor.false_positive_rates(_feedback(s, d), 34)),
    "feedback_poisoning": lambda s, d: rounded(monitor.poisoning_analysts(_feedback(s, d), 12, 5, 0.2)),
    "identity_cases": lambda s, d: rounded(_cases(s, d)),
    "correlate": lambda s, d: rules.correlate(stream_table(s, d), min_failures=60).drop("details"),
    "drift_status": lambda s, d: _drift_status(s, d),
    "detection_rates": lambda s, d: rounded(evaluate.detection_rates(models(s, d).withColumn("truth", F.col("event_type") == "failed_login"), "b", "truth")),
    "robustness": lambda s, d: rounded(evaluate.robustness(normalised(s, d).withColumns({"truth": F.col("event_type") == "failed_login", "e": scoring.vote(MODELS)}).withColumn("flag", F.col("e") >= 0.6), MODELS, "e", "flag", "truth")),
    "slices": lambda s, d: rounded(evaluate.slices(normalised(s, d), {"failures": F.col("event_type").isin("failed_login", "mfa_failure"), "night": F.hour("timestamp") < 6, "no_mfa": ~F.col("mfa_used"), "all": F.lit(True)}, "a", "b", "success")),
    "cef_lines": _lines(formats.cef),
    "syslog_lines": _lines(formats.syslog),
    "case_bands": lambda s, d: normalised(s, d).select("event_index", case_severity(F.col("a"), F.floor(F.col("b") * 9)).alias("severity"), confidence_band(F.col("a")).alias("confidence"), F.round(angular_distance(F.col("c") * 360, F.col("b") * 360), 6).alias("apart")),
}

RAW = f"""{EVENTS}, raw AS (SELECT ev.*, session_duration_seconds AS a, k::DOUBLE AS b, hour(timestamp) + minute(timestamp) / 60.0 AS c FROM ev JOIN (SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k FROM events) ON event_id = event_index)"""
_CL = "greatest(least({}, 1.0), 0.0)"
NORM = f"""{RAW}, lim AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM raw),
nrm AS (SELECT raw.* EXCLUDE (a, b, c), {_CL.format('(a - la) / (ha - la)')} AS a, {_CL.format('(b - lb) / (hb - lb)')} AS b, {_CL.format('(c - lc) / (hc - lc)')} AS c FROM raw, lim)"""
_QUANT = f"""{RAW}, lim AS (SELECT {', '.join(f'quantile_cont({m}, 0.05) AS l{m}, quantile_cont({m}, 0.95) AS h{m}' for m in MODELS)} FROM raw)
SELECT event_index, {', '.join(f"round({_CL.format(f'({m} - l{m}) / (h{m} - l{m})')}, 6) + 0 AS {m}" for m in MODELS)} FROM raw, lim"""
_SORTED = "list_sort([a, b, c])"
_P = "(x + 1e-10) / (a + b + c + 3e-10)"
_JSD = "greatest((list_sum(list_transform([a, b, c], lambda x: (x + 1e-10) / (a + b + c + 3e-10) * ln((x + 1e-10) / (a + b + c + 3e-10)))) + ln(3)) / 3, 0)"
_SOFT = "-list_sum(list_transform([a, b, c], lambda x: exp(x) / (exp(a) + exp(b) + exp(c)) * ln(exp(x) / (exp(a) + exp(b) + exp(c)))))"
_VAR = "(pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3"
_SCORED = f"""{RAW}, sc AS (SELECT *, -a AS score FROM raw), tau AS (SELECT quantile_cont(score, 0.05) AS t FROM sc),
res AS (SELECT sc.*, score < t AS is_anomaly, least(1.0, CASE WHEN score < t THEN t - score ELSE score - t END / greatest(abs(t), 0.1)) AS confidence, cume_dist() OVER (ORDER BY score) AS percentile_rank, avg(score) OVER (PARTITION BY user_id) AS user_baseline FROM sc, tau)"""
_ANGLE = "(hour(timestamp) + minute(timestamp) / 60.0) * 2 * pi() / 24"
_TAU = "2 * pi()"


def _mod(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN {x} + {_TAU} ELSE {x} END"


_FLEET = f"""{EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, ip_address ORDER BY us, event_index) = 1)::INT AS new FROM ev),
w AS (SELECT *, unnest(range((us // 600000000 - 5) * 600000000, us // 600000000 * 600000000 + 1, 600000000)) + 3600000000 AS e FROM n),
u AS (SELECT e, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN new = 1 THEN user_id END) AS fresh, count(*) AS logins FROM w GROUP BY e),
a AS (SELECT e, max(n) AS top FROM (SELECT e, asn, count(*) AS n FROM w GROUP BY ALL) GROUP BY e),
f AS (SELECT e AS window_end, users, round(fresh / users, 6) AS new_ip_share, round(top / logins, 6) AS asn_share, 0.0::DOUBLE AS odd_share FROM u JOIN a USING (e) WHERE users >= 10)"""
_FB = """fb AS (SELECT 'e' || regexp_extract(props, '[0-9]+') AS event_id, ['fp', 'tp', 'unsure'][1 + event_id % 3] AS verdict, 'a' || (user_id % 40) AS analyst_id, 'u' || (event_id % 50) AS user_id FROM events)"""


def _key(*parts: str) -> str:
    return f"concat_ws(chr(1), {', '.join(parts)})"


#: Cases: (type, which, key, gap in minutes, users needed).
_KINDS = (
    ("session_takeover_case", "fusion_score >= 0.3 AND (takeover_score >= 0.58 OR takeover_sequence_score >= 0.5)", _key("user_id", "coalesce(session_id, ip_address, 'no-session')"), 30, 1),
    ("password_spray_case", "password_spray_score >= 0.5", _key("coalesce(ip_address, 'no-ip')", "coalesce(asn, 'no-asn')"), 30, 1),
    ("low_and_slow_campaign_case", "low_and_slow_score >= 0.5", _key("coalesce(ip_address, 'no-ip')", "coalesce(asn, 'no-asn')"), 180, 1),
    ("coordinated_identity_campaign_case", "campaign_score >= 0.55 OR relationship_score >= 0.55", _key("coalesce(ip_address, 'no-ip')", "coalesce(device_fingerprint, user_agent, 'no-device')", "coalesce(asn, 'no-asn')"), 30, 2),
)
_CASES = f"""{SIGNALS}, mk AS ({' UNION ALL '.join(f"SELECT *, '{kind}' AS case_type, {key} AS key, {gap * 60_000_000} AS gap_us, {least} AS least FROM sig WHERE {which}" for kind, which, key, gap, least in _KINDS)}),
st AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY case_type, key ORDER BY us, event_index) > gap_us)::INT, 0) AS starts FROM mk),
nm AS (SELECT *, sum(starts) OVER (PARTITION BY case_type, key ORDER BY us, event_index) AS cs FROM st),
wy AS (SELECT case_type, key, cs, us, event_index, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS why FROM (SELECT *, list_filter([{SAID}], lambda x: x IS NOT NULL) AS w FROM nm)),
fw AS (SELECT case_type, key, cs, why, min((us, event_index, pos)) AS f FROM wy GROUP BY ALL),
rw AS (SELECT case_type, key, cs, string_agg(why, ';' ORDER BY f) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY case_type, key, cs ORDER BY f) AS i FROM fw) WHERE i <= 4 GROUP BY ALL),
ag1 AS (SELECT case_type, key, cs, max(least) AS least, list_sort(list(DISTINCT event_index)) AS ids, max(greatest(takeover_score, takeover_sequence_score, campaign_score, password_spray_score, low_and_slow_score)) AS score, min(us) AS first_seen, max(us) AS last_seen, count(DISTINCT user_id) AS n_users,
  {', '.join(f"array_to_string(list_sort(list(DISTINCT {c})), ',') AS {n}" for c, n in (('user_id', 'users'), ('session_id', 'sessions'), ('ip_address', 'ips'), ('asn', 'asns')))},
  array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT device_fingerprint), list(DISTINCT user_agent)))), ',') AS devices FROM nm GROUP BY ALL)
SELECT case_type || ':' || substr(sha1(case_type || ':' || array_to_string(ids, ',')), 1, 12) AS case_id, case_type,
 CASE WHEN score >= 0.85 OR len(ids) >= 8 THEN 'critical' WHEN score >= 0.7 OR len(ids) >= 5 THEN 'high' WHEN score >= 0.55 OR len(ids) >= 3 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN score >= 0.85 THEN 'very_high' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
 round(score, 6) + 0 AS score, len(ids)::INT AS n_events, first_seen, last_seen, users, sessions, ips, devices, asns, array_to_string(ids[:12], ',') AS representatives, coalesce(reasons, 'The events were joined by their signals alone.') AS reasons
FROM ag1 LEFT JOIN rw USING (case_type, key, cs) WHERE n_users >= least"""
#: I1/I0 by its continued fraction, and concentrations by halving an interval until the ratio meets the resultant.
_RATIO = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(80, 0, -1), lambda j: j::DOUBLE)), lambda y, j: mid / (2 * j + mid * y))"
_FITTED = f"""WITH RECURSIVE {EVENTS}, m AS (SELECT user_id, count(*) AS n, round(avg(cos({_ANGLE})), 12) + 0 AS c, round(avg(sin({_ANGLE})), 12) + 0 AS s FROM ev GROUP BY 1),
r AS (SELECT user_id, n, CASE WHEN n >= 10 THEN {_mod('atan2(s, c)')} ELSE 0 END AS mean_angle, CASE WHEN n >= 10 THEN sqrt(c * c + s * s) ELSE 0 END AS length FROM m),
half AS (SELECT user_id, length, 0.0::DOUBLE AS low, 200.0::DOUBLE AS high, 100.0::DOUBLE AS mid, 0 AS step FROM r WHERE length >= 1e-9
         UNION ALL SELECT user_id, length, low, high, (low + high) / 2, step + 1 FROM (SELECT user_id, length, step, CASE WHEN {_RATIO} < length THEN mid ELSE low END AS low, CASE WHEN {_RATIO} < length THEN high ELSE mid END AS high FROM half WHERE step < 60)),
fitted AS (SELECT r.user_id, n, mean_angle, coalesce(mid, 0) AS kappa FROM r LEFT JOIN (SELECT * FROM half WHERE step = 60) h USING (user_id))"""
_I0 = "1 + list_sum(list_transform(range(1, 40), lambda j: pow(kappa / 2, 2 * j) / pow(gamma(j + 1.0), 2)))"


def _subquery(key: str, minutes: int, part: str | None, name: str) -> str:
    return bursts(key, minutes, "count(*) OVER w AS n, list_sort(list_distinct(list(user_id) OVER w)) AS names", "len(names) >= 3", f"'{name}' AS rule_id, cand.k AS key, event_index AS first_event, n AS n_events, names, us AS matched_at", "ip_address IS NOT NULL" if part is None else "TRUE", part)


_CORRELATE = f"""WITH a AS ({_subquery('ip_address', 30, None, 'shared_ip')}), b AS ({_subquery("'all'", 5, '', 'timing_burst')}), {EVENTS},
f AS (SELECT user_id, count(*) AS n, min((us, event_index)) AS first FROM ev WHERE failed GROUP BY 1 HAVING count(*) >= 60),
c AS (SELECT 'shared_failure_pattern' AS rule_id, 'all' AS key, struct_extract(min(first), 2) AS first_event, sum(n)::BIGINT AS n_events, list_sort(list(user_id)) AS names, struct_extract(min(first), 1) AS matched_at FROM f HAVING count(*) >= 3),
z AS (SELECT *, 1 AS o FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c)
SELECT rule_id, CASE WHEN o = 2 OR o = 1 AND len(names) >= 5 THEN 'high' ELSE 'medium' END AS severity, key, first_event, n_events, array_to_string(names, ',') AS users, matched_at, row_number() OVER (ORDER BY o, matched_at, first_event, key)::INT AS cluster_id FROM z"""


def _conf(q: int) -> str:
    return f"cf AS (SELECT event_id, verdict FROM fb GROUP BY ALL HAVING count(DISTINCT analyst_id) >= {q})"


ORACLES = {
    "normalise_minmax": f"WITH {NORM} SELECT event_index, round(a, 6) + 0 AS a, round(b, 6) + 0 AS b, round(c, 6) + 0 AS c FROM nrm",
    "normalise_quantile": f"WITH {_QUANT}",
    "vote_mean": f"WITH {NORM} SELECT event_index, round((a + b + c) / 3, 6) AS ensemble FROM nrm",
    "vote_median": f"WITH {NORM} SELECT event_index, round({_SORTED}[2], 6) AS ensemble FROM nrm",
    "vote_trimmed": f"WITH {NORM} SELECT event_index, round({_SORTED}[2], 6) AS ensemble FROM nrm",
    "vote_weighted": f"WITH {NORM} SELECT event_index, round((2 * a + b + 0.5 * c) / 3.5, 6) AS ensemble FROM nrm",
    "disagreement": f"WITH {NORM} SELECT event_index, round({_JSD}, 6) AS jsd, round({_SOFT}, 6) AS entropy, round({_VAR}, 6) AS variance FROM nrm",
    "score_pipeline": f"""WITH {NORM}, e AS (SELECT event_index, {_SORTED}[2] AS ens, {_JSD} AS jsd, {_VAR} AS v FROM nrm), t AS (SELECT quantile_cont(ens, 0.95) AS tau FROM e)
SELECT event_index, round(ens, 6) AS ensemble, round(jsd, 6) AS disagreement, round(v, 6) AS variance, ens >= tau AS is_anomaly FROM e, t""",
    "sensitivity": f"""WITH {NORM},
v AS (SELECT unnest((SELECT list((0.01 + 0.29 * i / 19)::DOUBLE ORDER BY i) FROM range(20) r(i))) AS q, unnest((SELECT quantile_cont(a, [{', '.join(repr(1 - (0.01 + 0.29 * i / 19)) for i in range(20))}]) FROM nrm)) AS x)
SELECT round(q, 6) AS contamination, round(x, 6) AS threshold, round((SELECT avg((a >= x)::INT) FROM nrm), 6) AS flagged_share FROM v""",
    "scorer": f"WITH {_SCORED} SELECT event_index, is_anomaly, round(confidence, 6) AS confidence, round(percentile_rank, 6) AS percentile_rank, round(user_baseline + 3e-9, 6) AS user_baseline FROM res",
    "user_summary": f"""WITH {_SCORED}, s AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (is_anomaly) AS n_anomalies, avg(score) AS m, min(score) AS lo, max(score) AS hi, stddev_pop(score) AS sd FROM res GROUP BY 1), r AS (SELECT *, n_anomalies / n_events AS rate FROM s)
SELECT user_id, n_events, n_anomalies, round(m + 3e-9, 6) AS mean_score, round(lo, 6) AS min_score, round(hi, 6) AS max_score, round(sd, 6) AS std_score, round(rate, 6) AS anomaly_rate,
 CASE WHEN rate > 0.5 OR lo < -0.5 THEN 'critical' WHEN rate > 0.2 OR m < -0.1 THEN 'high' WHEN rate > 0.05 OR n_anomalies > 0 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN round(rate, 6) > 0.5 OR lo / 100 < -0.5 THEN 'F' WHEN round(rate, 6) > 0.3 OR lo / 100 < -0.3 THEN 'D' WHEN round(rate, 6) > 0.15 OR lo / 100 < -0.15 THEN 'C' WHEN round(rate, 6) > 0.05 OR lo / 100 < -0.05 THEN 'B' ELSE 'A' END AS grade FROM r""",
    "score_distribution": f"""WITH {RAW}, q AS (SELECT count(a) AS n, avg(a) AS mean, stddev_pop(a) AS std, min(a) AS least, max(a) AS most, quantile_cont(a, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM raw)
SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, {', '.join(f'round(q[{i + 1}], 6) AS p{p}' for i, p in enumerate((1, 5, 10, 25, 50, 75, 90, 95, 99)))} FROM q""",
    "cyclic_features": f"""WITH {EVENTS} SELECT event_index, {', '.join(f"round({f}({v} * 2 * pi() / {p}), 6) + 0 AS {n}_{f}" for n, v, p in (('hour', 'hour(timestamp)', 24), ('day', '(isodow(timestamp) - 1)', 7), ('month', '(month(timestamp) - 1)', 12)) for f in ('sin', 'cos'))} FROM ev""",
    "von_mises_moments": f"""WITH {EVENTS}, m AS (SELECT user_id, count(*) AS n, round(avg(cos({_ANGLE})), 12) + 0 AS c, round(avg(sin({_ANGLE})), 12) + 0 AS s FROM ev GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n >= 10 THEN {_mod('atan2(s, c)')} ELSE 0 END, 5) AS mean_angle, round(CASE WHEN n >= 10 THEN sqrt(c * c + s * s) ELSE 0 END, 5) AS resultant FROM m""",
    "von_mises_fit": f"""{_FITTED} SELECT user_id, n, round(mean_angle, 4) AS mean_angle, round(kappa, 4) AS kappa FROM fitted""",
    "hour_surprise": f"""{_FITTED} SELECT event_index, user_id, round(CASE WHEN kappa > 0 THEN greatest(ln(2 * pi()) + ln({_I0}) - kappa * cos({_ANGLE} - mean_angle), 0) ELSE 0 END, 4) + 0 AS nll FROM ev JOIN fitted USING (user_id)""",
    "online_von_mises": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER ({O}) AS i FROM ev)
SELECT x.event_index, x.user_id, round(sum(pow(0.995, x.i - y.i) * cos((hour(y.timestamp) + minute(y.timestamp) / 60.0) * 2 * pi() / 24)), 5) AS c, round(sum(pow(0.995, x.i - y.i) * sin((hour(y.timestamp) + minute(y.timestamp) / 60.0) * 2 * pi() / 24)), 5) AS s, round(sum(pow(0.995, x.i - y.i)), 5) AS w
FROM r x JOIN r y ON x.user_id = y.user_id AND y.i <= x.i GROUP BY x.event_index, x.user_id""",
    "drift_alerts": f"""WITH {EVENTS}, m AS (SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, round(avg(cos({_ANGLE})), 12) + 0 AS c, round(avg(sin({_ANGLE})), 12) + 0 AS s FROM ev GROUP BY ALL),
g AS (SELECT user_id, day, degrees({_mod('atan2(s, c)')}) AS d FROM m), h AS (SELECT *, abs(d - lag(d) OVER o) AS x, abs(d - first(d) OVER o) AS y FROM g WINDOW o AS (PARTITION BY user_id ORDER BY day)),
v AS (SELECT *, avg(least(x, 360 - x)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vel, least(y, 360 - y) AS mv FROM h)
SELECT user_id, day, CASE WHEN mv >= 90 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, round(vel, 4) AS velocity, round(mv, 4) AS moved FROM v WHERE x IS NOT NULL AND (mv >= 90 OR vel >= 30)""",
    "fleet_windows": f"WITH {_FLEET} SELECT * FROM f",
    "fleet_alerts": f"""WITH RECURSIVE {_FLEET}, al AS (SELECT window_end, 'MASS_NEW_IP' AS alert_type, CASE WHEN new_ip_share >= 0.4 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, new_ip_share AS share FROM f WHERE new_ip_share >= 0.2
 UNION ALL SELECT window_end, 'ASN_CONCENTRATION', CASE WHEN asn_share >= 0.75 THEN 'CRITICAL' ELSE 'WARNING' END, asn_share FROM f WHERE asn_share >= 0.5),
g AS (SELECT alert_type, min(window_end) AS t FROM al GROUP BY 1 UNION ALL SELECT g.alert_type, min(a.window_end) FROM g JOIN al a ON a.alert_type = g.alert_type AND a.window_end >= g.t + 3600000000 GROUP BY g.alert_type, g.t)
SELECT al.* FROM al JOIN g ON al.alert_type = g.alert_type AND al.window_end = g.t""",
    "alert_gate": f"""WITH {NORM}, g AS (SELECT event_index, (a + b + c) / 3 >= 0.6 AS e, coalesce(count(b) OVER w >= 10 AND b > quantile_cont(b, 0.95) OVER w, false) AS t, {_JSD} >= 0.1 AS j, (a + b + c) / 3 >= 0.97 AS h FROM nrm WINDOW w AS ({O} ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))
SELECT event_index, e AS ensemble_fired, t AS temporal_fired, j AS jsd_fired, e::INT + t::INT + j::INT AS n_signals, h OR e::INT + t::INT + j::INT >= 2 AS passes FROM g""",
    "alert_dedup": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_index, user_id, us, row_number() OVER ({O}) AS i FROM ev),
s AS (SELECT user_id, i, event_index, [us] AS kept, true AS emitted FROM r WHERE i = 1
 UNION ALL SELECT r.user_id, r.i, r.event_index, CASE WHEN len(list_filter(s.kept, lambda t: r.us - t <= 86400000000)) < 2 THEN list_append(list_filter(s.kept, lambda t: r.us - t <= 86400000000), r.us) ELSE list_filter(s.kept, lambda t: r.us - t <= 86400000000) END, len(list_filter(s.kept, lambda t: r.us - t <= 86400000000)) < 2
 FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT event_index, emitted FROM s""",
    "alert_severity": f"""WITH {NORM}, x AS (SELECT event_index, ((a + b + c) / 3 - 0.3) / 0.3 AS r, {_JSD} * 5 > 0.5 AS j FROM nrm)
SELECT event_index, ['info', 'low', 'medium', 'high', 'critical'][1 + least((CASE WHEN r < 0.1 THEN 1 WHEN r < 0.5 THEN 2 WHEN r < 1.0 THEN 3 ELSE 4 END) + j::INT, 4)] AS severity FROM x""",
    "feedback_summary": f"WITH {_FB} SELECT count(*) AS total, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'unsure') AS unsure, round(avg((verdict = 'fp')::INT), 6) AS fp_rate FROM fb",
    "triage": f"""WITH {NORM}, p AS (SELECT event_index, 1 / (1 + exp(-(0.1 - 4.0 * ((a + b + c) / 3 - 0.6) + 2.0 * {_JSD} + 0.5 * mfa_used::INT + 0.25 * success::INT))) AS p FROM nrm) SELECT event_index, round(p, 6) AS fp_probability, round(abs(p - 0.5) * 2, 6) AS confidence FROM p""",
    "feedback_confirmed": f"WITH {_FB}, {_conf(12)} SELECT * FROM cf",
    "feedback_fp_rates": f"""WITH {_FB}, {_conf(34)} SELECT user_id, count(*) AS events, round(avg((event_id IN (SELECT event_id FROM cf WHERE verdict = 'fp'))::INT), 6) AS fp_rate FROM (SELECT DISTINCT user_id, event_id FROM fb) GROUP BY 1""",
    "feedback_poisoning": f"""WITH {_FB}, {_conf(12)}, w AS (SELECT *, row_number() OVER () AS i FROM fb WHERE analyst_id <> 'anon'), a AS (SELECT w.i, w.analyst_id, max((cf.event_id IS NOT NULL)::INT) AS bad FROM w LEFT JOIN cf ON cf.event_id = w.event_id AND cf.verdict <> w.verdict GROUP BY ALL)
SELECT analyst_id, count(*) AS labels, round(avg(bad), 6) AS disagreement FROM a GROUP BY 1 HAVING count(*) >= 5 AND avg(bad) > 0.2""",
    "identity_cases": _CASES,
    "correlate": _CORRELATE,
    "drift_status": f"""WITH {EVENTS}, m AS (SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, round(avg(cos({_ANGLE})), 12) + 0 AS c, round(avg(sin({_ANGLE})), 12) + 0 AS s FROM ev GROUP BY ALL),
g AS (SELECT user_id, day, degrees({_mod('atan2(s, c)')}) AS deg, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back FROM m),
u AS (SELECT user_id, CASE WHEN user_id = 'u1' THEN 90.0 ELSE arg_min(deg, day) END AS baseline, arg_max(deg, day) AS current, least(count(*), 7) AS n_recent FROM g GROUP BY 1)
SELECT user_id, 'tracked' AS status, round(baseline, 4)::DOUBLE AS baseline, round(current, 4) AS current, round(least(abs(baseline - current), 360 - abs(baseline - current)), 4)::DOUBLE AS moved, n_recent FROM u""",
    "detection_rates": f"""WITH {RAW}, v AS (SELECT b, sum((event_type = 'failed_login')::INT) AS p, count(*) AS n FROM raw GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY b DESC) AS tp, sum(n - p) OVER (ORDER BY b DESC) AS fp, sum(p) OVER () AS ap, sum(n - p) OVER () AS an FROM v)
SELECT t AS target_fpr, round(coalesce((SELECT max(tp / ap) FROM c WHERE fp / an <= t), 0), 6) AS detection_rate FROM (SELECT unnest([0.01, 0.05, 0.10, 0.20]::DOUBLE[]) AS t)""",
    "robustness": f"""WITH {NORM}, x AS (SELECT *, event_type = 'failed_login' AS truth, (a + b + c) / 3 AS e, {_SOFT} AS h, {_VAR} AS v FROM nrm)
SELECT count(*) AS n_events, count(*) FILTER (e >= 0.6) AS n_flagged, count(*) FILTER (truth) AS n_injected, count(*) FILTER (truth AND e >= 0.6) AS true_positives, count(*) FILTER (NOT truth AND e >= 0.6) AS false_positives,
 round(count(*) FILTER (NOT truth AND e >= 0.6) / count(*) FILTER (NOT truth), 6) AS false_positive_rate, round(avg(h), 6) AS entropy_mean, round(stddev_pop(h), 6) AS entropy_std, round(avg(v), 6) AS variance_mean, round(avg(e), 6) AS ensemble_mean FROM x""",
    "slices": f"""WITH {NORM}, m AS (SELECT *, unnest([CASE WHEN failed THEN 'failures' END, CASE WHEN hour(timestamp) < 6 THEN 'night' END, CASE WHEN NOT mfa_used THEN 'no_mfa' END, 'all']) AS slice FROM nrm)
SELECT slice, count(*) AS n, round(avg(success::INT), 6) AS flagged_share, round(avg(a), 6) AS mean_score, round(avg(b), 6) AS mean_baseline FROM m WHERE slice IS NOT NULL GROUP BY 1""",
    "cef_lines": f"""WITH {EVENTS}, s AS (SELECT *, -session_duration_seconds / 130 AS score FROM ev) SELECT 'CEF:0|tidewatch|tidewatch|1.0|anomaly|behavioural anomaly|' || CASE WHEN score < -0.4 THEN 10 WHEN score < -0.2 THEN 7 WHEN score < -0.1 THEN 5 ELSE 3 END || '|rt=' || strftime(timestamp, '%b %d %Y %H:%M:%S') || ' suser=' || user_id || ' cs1=' || event_type || ' cs1Label=EventType cfp1=' || printf('%.6f', score) || ' cfp1Label=AnomalyScore cfp2=0.5000 cfp2Label=Confidence' AS value FROM s WHERE score < -0.3""",
    "syslog_lines": f"""WITH {EVENTS}, s AS (SELECT *, -session_duration_seconds / 130 AS score FROM ev) SELECT '<' || CASE WHEN score < -0.4 THEN 82 WHEN score < -0.2 THEN 83 WHEN score < -0.1 THEN 84 ELSE 86 END || '>1 ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || ' - tidewatch - - - user=' || user_id || ' event=' || event_type || ' score=' || printf('%.4f', score) || ' confidence=0.50 anomaly=true' AS value FROM s WHERE score < -0.3""",
    "case_bands": f"""WITH {NORM} SELECT event_index, CASE WHEN a >= 0.85 OR floor(b * 9) >= 8 THEN 'critical' WHEN a >= 0.7 OR floor(b * 9) >= 5 THEN 'high' WHEN a >= 0.55 OR floor(b * 9) >= 3 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN a >= 0.85 THEN 'very_high' WHEN a >= 0.7 THEN 'high' WHEN a >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, round(least(abs(c - b) * 360, 360 - abs(c - b) * 360), 6) AS apart FROM nrm""",
}
