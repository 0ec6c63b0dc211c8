"""Queries of the base features and the identity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scalar import COUNTRY_CENTRES
from tidewatch.operators import features, identity
from tidewatch.operators.patterns import with_order
from tidewatch.plans.sql import EVENTS, PRIOR, user_order
from tidewatch.sources.readers import stream_table

O = user_order()  # noqa: E741
U = "PARTITION BY user_id ORDER BY us, event_index"


def _rounded(df, skip=("event_index", "user_id")):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _group(name):
    return lambda spark, d: _rounded(features.build(stream_table(spark, d), [name]))


def _identity(*steps, columns):
    def run(spark, d):
        df = with_order(stream_table(spark, d), identity.USER)
        for f in steps:
            df = f(df)
        return _rounded(df.select("event_index", *columns))

    return run


QUERIES = {f"{n}_features": _group(n) for n in features.GROUPS} | {
    "canonicalise": lambda spark, d: stream_table(spark, d).select("event_index", F.unix_micros("timestamp").alias("us"), "user_id", "event_type", "ip_address", "asn", "country_code", "user_agent", "device_fingerprint", "session_id", F.round("session_duration_seconds", 6).alias("duration"), "mfa_used", "success"),
    "user_profile": lambda spark, d: _rounded(features.profiles(stream_table(spark, d))),
    "peer_statistics": lambda spark, d: _rounded(features.peer_statistics(stream_table(spark, d))),
    "shared_entity_counts": _identity(identity.shared_counts, columns=("shared_ip_users", "shared_device_users", "shared_asn_users")),
    "infrastructure": _identity(identity.infrastructure, columns=("shared_infra_pair_users", "infra_burst_peer_count", "infra_burst_event_count", "sync_peer_count")),
    "novelty": _identity(identity.novelty, columns=("ip_novelty", "device_novelty", "country_novelty", "asn_novelty", "session_novelty")),
    "mfa_bypass_suspicion": _identity(identity.mfa_suspicion, columns=("mfa_bypass_suspicion",)),
    "session_context": _identity(identity.session_context, columns=("session_deltas", "session_context_shift")),
    "session_activity": _identity(identity.session_activity, columns=("session_concurrency", "session_replay_burst")),
    "failure_scores": _identity(identity.failures, columns=("password_spray_score", "low_and_slow_score")),
    "geo_velocity": _identity(identity.gaps, identity.geography, columns=("burst_score", "geo_velocity_flag", "geo_velocity_score", "high_risk_country")),
    "interval_deviation": _identity(identity.rhythm, columns=("interval_deviation",)),
    "takeover": _identity(identity.gaps, identity.session_context, identity.takeover, columns=("takeover_transition", "privileged_escalation", "takeover_sequence_score")),
    "identity_sessions": _identity(identity.sessions, columns=("session_position", "session_size")),
    "identity_signals": lambda spark, d: identity.build(stream_table(spark, d)).withColumn("reasons", F.concat_ws(";", "reasons")),
}


def _ev(body: str) -> str:
    return f"WITH {EVENTS} {body}"


def _distinct_before(value: str, name: str, key: str = "user_id", of: str | None = None) -> str:
    """Two columns over ``e``: the number of different earlier values, and whether this one is new."""
    return f"sum(first_{value}) OVER (PARTITION BY {key} ORDER BY us, event_index {PRIOR}) AS {name}"


def _firsts(*values: str, key: str = "user_id") -> str:
    return ", ".join(f"(row_number() OVER (PARTITION BY {key}, {v} ORDER BY us, event_index) = 1)::INT AS first_{v}" for v in values)


_SEEN = f"row_number() OVER ({O}) - 1 AS seen"
_R = "RANGE BETWEEN {} PRECEDING AND 1 PRECEDING"
_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def _known(v: str) -> str:
    return f"CASE WHEN first_{v} = 0 OR seen = 0 THEN 1.0 ELSE 0.0 END::DOUBLE"


def _lists(key: str, us: int, values: str, order: str = "us") -> str:
    return f"list({values}) OVER (PARTITION BY {key} ORDER BY {order} RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING)"


_OTHERS = "len(list_filter(list_distinct(coalesce({0}, [])), lambda x: x <> user_id))::DOUBLE"
_CENTRES = " ".join(f"WHEN '{k}' THEN [{a}, {b}]" for k, (a, b) in COUNTRY_CENTRES.items())


def _c(code: str, i: int) -> str:
    return f"(CASE {code} {_CENTRES} END)[{i}]"


_KM = f"""2 * 6371.0 * asin(sqrt(pow(sin(radians({_c('country_code', 1)} - {_c('was', 1)}) / 2), 2) + cos(radians({_c('was', 1)})) * cos(radians({_c('country_code', 1)})) * pow(sin(radians({_c('country_code', 2)} - {_c('was', 2)}) / 2), 2)))"""
_CLAMP = "greatest(least({}, 1.0), 0.0)"
_DELTAS = " + ".join(f"({c} <> first({c}) OVER s)::INT" for c in ("ip_address", "device_fingerprint", "country_code", "asn"))
_CHANGES = " + ".join(f"coalesce(({c} <> lag({c}) OVER o)::INT, 0)" for c in ("ip_address", "device_fingerprint", "country_code", "asn"))

ORACLES = {
    "canonicalise": _ev("SELECT event_index, us, user_id, event_type, ip_address, asn, country_code, user_agent, device_fingerprint, session_id, round(session_duration_seconds, 6) AS duration, mfa_used, success FROM ev"),
    "temporal_features": _ev(f"""SELECT event_index, user_id, round(sin(h * 2 * pi() / 24), 6) + 0 AS hour_sin, round(cos(h * 2 * pi() / 24), 6) + 0 AS hour_cos, d::DOUBLE AS day_of_week, (d >= 5)::INT::DOUBLE AS is_weekend,
 CASE WHEN hs IS NULL OR len(list_filter(hs, lambda x: abs(x - h) <= 2 OR abs(x - h) >= 22)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_typical_hour,
 CASE WHEN ds IS NULL OR list_contains(ds, d) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_typical_day
FROM (SELECT *, list(h) OVER w AS hs, list(d) OVER w AS ds FROM (SELECT *, hour(timestamp) AS h, isodow(timestamp) - 1 AS d FROM ev) WINDOW w AS ({O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""),
    "velocity_features": _ev(f"""SELECT event_index, user_id, least(h, 1000)::DOUBLE AS events_last_hour, least(d, 1000)::DOUBLE AS events_last_day,
 round(coalesce(CASE WHEN s > 0 THEN least(s, 86400.0) END, 86400.0), 6) AS time_since_last_event,
 round(least(CASE WHEN d >= 2 THEN (hi - lo) / 1e6 / (d - 1) ELSE 86400.0 END, 86400.0), 6) AS avg_inter_event_time
FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us {_R.format(_HOUR)}) AS h, count(*) OVER dd AS d, min(us) OVER dd AS lo, max(us) OVER dd AS hi, (us - lag(us) OVER ({O})) / 1e6 AS s
 FROM ev WINDOW dd AS (PARTITION BY user_id ORDER BY us {_R.format(_DAY)}))"""),
    "geographic_features": _ev(f"""SELECT event_index, user_id, {_known('ip_address')} AS is_known_ip, {_known('country_code')} AS is_known_country, {_known('asn')} AS is_known_asn,
 greatest(coalesce(i, 0), 1)::DOUBLE AS unique_ips_24h, greatest(coalesce(c, 0), 1)::DOUBLE AS unique_countries_24h, greatest(coalesce(a, 0), 1)::DOUBLE AS unique_asns_24h,
 round(CASE WHEN seen = 0 THEN 0 ELSE greatest(i, 1) / greatest(seen, 1) END, 6)::DOUBLE AS ip_change_frequency, 0.0::DOUBLE AS is_threat_ip, 0.0::DOUBLE AS is_threat_asn
FROM (SELECT *, {_distinct_before('ip_address', 'i')}, {_distinct_before('country_code', 'c')}, {_distinct_before('asn', 'a')} FROM (SELECT *, {_SEEN}, {_firsts('ip_address', 'country_code', 'asn')} FROM ev))"""),
    "device_features": _ev(f"""SELECT event_index, user_id, {_known('device_fingerprint')} AS is_known_device, {_known('user_agent')} AS is_known_user_agent,
 greatest(coalesce(i, 0), 1)::DOUBLE AS unique_devices_24h, greatest(coalesce(c, 0), 1)::DOUBLE AS unique_user_agents_24h
FROM (SELECT *, {_distinct_before('device_fingerprint', 'i')}, {_distinct_before('user_agent', 'c')} FROM (SELECT *, {_SEEN}, {_firsts('device_fingerprint', 'user_agent')} FROM ev))"""),
    "session_features": _ev(f"""SELECT event_index, user_id, round(CASE WHEN n >= 3 AND m <> 0 AND sd > 0 THEN (x - mean) / sd ELSE 0 END, 6) AS session_duration_zscore, round(CASE WHEN n >= 3 AND m <> 0 THEN x / greatest(m, 1) ELSE 1 END, 6) AS session_duration_ratio
FROM (SELECT *, session_duration_seconds AS x, count(*) OVER w AS n, avg(session_duration_seconds) OVER w AS mean, stddev_pop(session_duration_seconds) OVER w AS sd, quantile_cont(session_duration_seconds, 0.5) OVER w AS m
 FROM ev WINDOW w AS ({O} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"""),
    "auth_features": _ev(f"""SELECT event_index, user_id, failed::INT::DOUBLE AS is_failure, round(coalesce(r, 0) * 5, 6) AS failure_streak, (success AND coalesce(r, 0) > 0.3)::INT::DOUBLE AS failed_then_success, 0.0::DOUBLE AS is_unusual_auth_method
FROM (SELECT *, avg(failed::INT) OVER ({O} {PRIOR}) AS r FROM ev)"""),
    "entropy_features": _ev(f"""SELECT event_index, user_id, round(log2(greatest(coalesce(i, 0), 1)), 6) AS ip_entropy, round(log2(greatest(coalesce(d, 0), 1)), 6) AS device_entropy, round(log2(greatest(coalesce(c, 0), 1)), 6) AS country_entropy
FROM (SELECT *, {_distinct_before('ip_address', 'i')}, {_distinct_before('device_fingerprint', 'd')}, {_distinct_before('country_code', 'c')} FROM (SELECT *, {_firsts('ip_address', 'country_code', 'device_fingerprint')} FROM ev))"""),
    "peer_features": _ev(f"""SELECT event_index, user_id, round(abs(hour(timestamp) - 12.0) / 6.0, 6)::DOUBLE AS peer_hour_deviation, round(CASE WHEN seen = 0 THEN 0 ELSE abs(seen - 5.0) / 3.0 END, 6)::DOUBLE AS peer_velocity_deviation FROM (SELECT *, {_SEEN} FROM ev)"""),
    "travel_features": _ev(f"""SELECT event_index, user_id, (seen >= 2 AND first_country_code = 1 AND s > 0 AND s < {_HOUR})::INT::DOUBLE AS impossible_travel_flag
FROM (SELECT *, {_SEEN}, {_firsts('country_code')}, coalesce(us - lag(us) OVER ({O}), 0) AS s FROM ev)"""),
    "user_profile": _ev("""SELECT user_id, count(*) AS n_events, count(*) FILTER (failed) AS n_failures, min(us) AS first_seen, max(us) AS last_seen,
 array_to_string(list_sort(list(DISTINCT ip_address)), ',') AS known_ips, array_to_string(list_sort(list(DISTINCT country_code)), ',') AS known_countries,
 array_to_string(list_sort(list(DISTINCT asn)), ',') AS known_asns, array_to_string(list_sort(list(DISTINCT device_fingerprint)), ',') AS known_devices,
 round(quantile_cont(session_duration_seconds, 0.5), 6) AS median_duration, round(avg(failed::INT), 6) AS failure_rate FROM ev GROUP BY user_id"""),
    "peer_statistics": _ev("""SELECT round(avg(hour(timestamp)), 6) AS hour_mean, round(greatest(stddev_pop(hour(timestamp)), 1), 6) AS hour_std, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)) AS events_mean,
 (SELECT round(greatest(stddev_pop(n), 1), 6) FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)) AS events_std FROM ev"""),
    "shared_entity_counts": _ev(f"""SELECT event_index, coalesce(sum(a) OVER (PARTITION BY ip_address ORDER BY us, event_index {PRIOR}), 0)::DOUBLE AS shared_ip_users, coalesce(sum(b) OVER (PARTITION BY device_fingerprint ORDER BY us, event_index {PRIOR}), 0)::DOUBLE AS shared_device_users,
 coalesce(sum(c) OVER (PARTITION BY asn ORDER BY us, event_index {PRIOR}), 0)::DOUBLE AS shared_asn_users
FROM (SELECT *, (row_number() OVER (PARTITION BY ip_address, user_id ORDER BY us, event_index) = 1)::INT AS a, (row_number() OVER (PARTITION BY device_fingerprint, user_id ORDER BY us, event_index) = 1)::INT AS b, (row_number() OVER (PARTITION BY asn, user_id ORDER BY us, event_index) = 1)::INT AS c FROM ev)"""),
    "infrastructure": _ev(f""", p AS (SELECT *, ip_address || asn AS pair, us // 1000000 AS sec, (row_number() OVER (PARTITION BY ip_address, asn, user_id ORDER BY us, event_index) = 1)::INT AS f FROM ev),
q AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY pair ORDER BY us, event_index {PRIOR}), 0) - (1 - f) AS pairs, (SELECT list(z.user_id) FROM p z WHERE z.pair = p.pair AND (z.us < p.us OR z.us = p.us AND z.event_index < p.event_index) AND z.sec >= p.sec - 900) AS pu,
 {_lists('ip_address', 900_000_000, 'user_id')} AS iu, {_lists('device_fingerprint', 900_000_000, 'user_id')} AS du FROM p)
SELECT event_index, greatest(pairs, 0)::DOUBLE AS shared_infra_pair_users, {_OTHERS.format('pu')} AS infra_burst_peer_count, len(coalesce(pu, []))::DOUBLE AS infra_burst_event_count, greatest({_OTHERS.format('iu')}, {_OTHERS.format('du')}, {_OTHERS.format('pu')}) AS sync_peer_count FROM q"""),
    "novelty": _ev(f"""SELECT event_index, first_ip_address::DOUBLE AS ip_novelty, first_device_fingerprint::DOUBLE AS device_novelty, first_country_code::DOUBLE AS country_novelty, first_asn::DOUBLE AS asn_novelty, (first_session_id = 1 AND event_type IN ('session_refresh', 'privileged_action'))::INT::DOUBLE AS session_novelty
FROM (SELECT *, {_firsts('ip_address', 'device_fingerprint', 'country_code', 'asn', 'session_id')} FROM ev)"""),
    "mfa_bypass_suspicion": _ev(f"""SELECT event_index, (success AND NOT mfa_used AND coalesce(lag(n) OVER ({O}), 0) >= 2)::INT::DOUBLE AS mfa_bypass_suspicion
FROM (SELECT *, count(*) FILTER (failed AND mfa_used) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS n FROM ev)"""),
    "session_context": _ev(f"""SELECT event_index, n AS session_deltas, round(CASE WHEN n >= 2 THEN least(n / 3.0, 1.0) ELSE 0 END, 6)::DOUBLE AS session_context_shift FROM (SELECT *, {_DELTAS} AS n FROM ev WINDOW s AS (PARTITION BY user_id, session_id ORDER BY us, event_index))"""),
    "session_activity": _ev(f""", l AS (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_index) AS last FROM ev),
n AS (SELECT l.event_index, count(*) FILTER (z.user_id = l.user_id AND (z.ip_address <> l.ip_address OR z.user_agent <> l.user_agent)) AS a, count(*) AS c, count(*) FILTER (l.us - z.us <= 5000000) AS b
 FROM l JOIN ev z ON z.session_id = l.session_id AND z.us <= l.last AND z.us >= l.last - 900000000 AND z.event_index <> l.event_index GROUP BY 1)
SELECT event_index, least(coalesce(a, 0) / 2.0, 1.0)::DOUBLE AS session_concurrency, round(CASE WHEN c >= 3 AND b >= 3 THEN least(b / 6.0, 1.0) ELSE 0 END, 6)::DOUBLE AS session_replay_burst FROM ev LEFT JOIN n USING (event_index)"""),
    "failure_scores": _ev(f""", h AS (SELECT e.event_index, list(z.user_id) FILTER (z.us >= e.us - 1800000000) AS near, count(DISTINCT z.user_id) FILTER (z.us >= e.us - 1800000000 AND z.user_id <> e.user_id) AS nu, count(*) AS c, count(DISTINCT z.user_id) FILTER (z.user_id <> e.user_id) AS su, (e.us - min(z.us)) / 1e6 AS spread, count(*) FILTER (z.us >= e.us - 300000000) AS short
 FROM ev e JOIN ev z ON e.failed AND z.failed AND z.ip_address = e.ip_address AND z.us < e.us AND z.us >= e.us - 7200000000 GROUP BY e.event_index, e.us)
SELECT event_index, round(CASE WHEN nu >= 2 THEN {_CLAMP.format("nu / 4.0 + greatest((len(near) - 2) / 8.0, 0) + greatest((2 - list_max(map_values(list_histogram(near)))::INT) / 4.0, 0)")} ELSE 0 END, 6)::DOUBLE AS password_spray_score,
 round(CASE WHEN c >= 3 AND su >= 2 THEN {_CLAMP.format("su / 4.0 + least(spread / 3600.0, 1.0) + greatest((3 - short) / 4.0, 0)")} ELSE 0 END, 6)::DOUBLE AS low_and_slow_score FROM ev LEFT JOIN h USING (event_index)"""),
    "geo_velocity": _ev(f""", g AS (SELECT *, lag(country_code) OVER ({O}) AS was, (us - lag(us) OVER ({O})) / 1e6 AS gap FROM ev),
k AS (SELECT *, coalesce({_KM}, 0) AS km, was <> country_code AND gap < 900 AS moved FROM g)
SELECT event_index, round(CASE WHEN gap IS NULL THEN 0 ELSE {_CLAMP.format('1.0 - gap / 300.0')} END, 6)::DOUBLE AS burst_score, coalesce(moved, false)::INT::DOUBLE AS geo_velocity_flag,
 round(CASE WHEN moved THEN CASE WHEN km / greatest(gap / 3600.0, 0.01) > 900 AND km > 500 THEN least(km / greatest(gap / 3600.0, 0.01) / 1800.0, 1.0) WHEN km > 0 THEN least(km / 12000.0, 1.0) ELSE 0 END ELSE 0 END, 6)::DOUBLE AS geo_velocity_score, (country_code IN ('RU', 'CN', 'KP', 'IR', 'SY'))::INT::DOUBLE AS high_risk_country FROM k"""),
    "interval_deviation": _ev(f""", g AS (SELECT *, (us - lag(us) OVER ({O})) / 1e6 AS gap FROM ev),
l AS (SELECT *, list_filter(list(gap) OVER ({O} {PRIOR}), lambda x: x IS NOT NULL) AS gs FROM g),
m AS (SELECT *, CASE WHEN len(gs) > 0 THEN list_median(gs) ELSE 3600.0 END AS mid FROM l),
a AS (SELECT *, greatest(CASE WHEN len(gs) > 0 THEN list_median(list_transform(gs, lambda x: abs(x - mid))) ELSE 1.0 END, 1.0) AS dev FROM m)
SELECT event_index, round(coalesce(CASE WHEN gap IS NOT NULL THEN least(abs(gap - mid) / dev, 10.0) END, 0), 6)::DOUBLE AS interval_deviation FROM a"""),
    "takeover": _ev(f""", g AS (SELECT *, (us - lag(us) OVER o) / 1e6 AS gap, {_CHANGES} AS n, {_DELTAS} AS deltas, us // 1000000 AS sec,
  CASE event_type WHEN 'privileged_action' THEN 3 WHEN 'session_refresh' THEN 2 WHEN 'mfa_failure' THEN 0 ELSE 1 END AS st FROM ev WINDOW o AS ({O}), s AS (PARTITION BY user_id, session_id ORDER BY us, event_index)),
p AS (SELECT *, max(CASE WHEN st = 1 THEN us END) OVER b AS u1, max(CASE WHEN st = 1 THEN sec END) OVER b AS s1 FROM g WINDOW b AS ({O} {PRIOR})),
q AS (SELECT *, coalesce(st = 2 AND sec - s1 <= 900, false) AS ok FROM p),
r AS (SELECT *, max(CASE WHEN ok THEN us END) OVER ({O} {PRIOR}) AS u2 FROM q)
SELECT event_index, round(CASE WHEN gap < 900 AND n >= 2 AND event_type IN ('login', 'session_refresh', 'privileged_action') THEN least(n / 3.0, 1.0) ELSE 0 END, 6)::DOUBLE AS takeover_transition,
 (st = 3 AND (deltas >= 1 OR coalesce(gap < 900 AND n >= 2, false)))::INT::DOUBLE AS privileged_escalation, (CASE WHEN ok THEN 0.5 WHEN st = 3 AND sec - s1 <= 900 AND u2 > u1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS takeover_sequence_score FROM r"""),
    "identity_sessions": _ev(f""", g AS (SELECT *, sum(coalesce((us - last > 2700000000)::INT, 0)) OVER ({O}) AS sid FROM (SELECT *, lag(us) OVER ({O}) AS last FROM ev)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY us, event_index) AS n FROM g)
SELECT event_index, (n > 1)::INT::DOUBLE AS session_position, n::DOUBLE AS session_size FROM h"""),
}


def _exact(sql: str) -> str:
    """An oracle without its rounding, as a subquery."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}({sql[at + 6 : end - 1].rsplit(',', 1)[0]}){sql[end:]}"
    return f"({sql})"


def _weighed(weights: dict[str, float]) -> str:
    return _CLAMP.format(" + ".join(f"{w} * {n}" for n, w in weights.items()))


_PARTS = ("shared_entity_counts", "infrastructure", "novelty", "mfa_bypass_suspicion", "session_context", "session_activity", "failure_scores", "geo_velocity", "interval_deviation", "takeover", "identity_sessions")
_RHYTHM, _VOLUME = _CLAMP.format("interval_deviation / 6.0"), _CLAMP.format("infra_burst_event_count / 20.0")
_NETWORK, _SYNC = "greatest(ip_novelty, country_novelty, asn_novelty)", _CLAMP.format("sync_peer_count / 10.0")
_SHARED = {n: _CLAMP.format(f"(shared_{n}_users - 1) / 10.0") for n in ("ip", "device", "asn", "infra_pair")}
_SEQUENCE = {"burst_score": 0.2, _RHYTHM: 0.2, "geo_velocity_flag": 0.15, "geo_velocity_score": 0.2, _NETWORK: 0.1, "device_novelty": 0.1, "session_novelty": 0.1, "session_context_shift": 0.15, "session_concurrency": 0.2, "session_replay_burst": 0.1, "takeover_transition": 0.2, "privileged_escalation": 0.15, "takeover_sequence_score": 0.2}
_RELATION = {_SHARED["ip"]: 0.25, _SHARED["device"]: 0.25, _SHARED["asn"]: 0.1, _SHARED["infra_pair"]: 0.15, _SYNC: 0.12, _CLAMP.format("infra_burst_peer_count / 10.0"): 0.08, _VOLUME: 0.05, "fanout_score": 0.1, "password_spray_score": 0.12, "low_and_slow_score": 0.1}
_CAMPAIGN = {"password_spray_score": 0.45, "low_and_slow_score": 0.35, _SYNC: 0.1, _VOLUME: 0.05, "fanout_score": 0.1}
_TAKEOVER = {"takeover_sequence_score": 0.3, "takeover_transition": 0.35, "session_context_shift": 0.25, "session_concurrency": 0.25, "session_replay_burst": 0.15, "session_fingerprint_drift": 0.15, "geo_velocity_score": 0.15, "high_risk_country": 0.1, "privileged_escalation": 0.2, "mfa_bypass_suspicion": 0.2, "campaign_score": 0.1, "session_novelty": 0.1, f"greatest({_NETWORK}, device_novelty)": 0.1}
#: (condition, words, a column whose value stands in their middle): what an analyst reads, in order.
_SAID = (
    ("burst_score >= 0.7", "'Very fast events of ' || user_id || '.'"), ("interval_deviation >= 3", "'Event timing is far from the rhythm of ' || user_id || '.'"), ("geo_velocity_flag > 0", "'The country changed within minutes.'"),
    ("geo_velocity_score >= 0.5", "'No traveller moves that fast.'"), ("high_risk_country > 0", "'The country is on the list of high risk.'"), (f"{_NETWORK} > 0", "'The network is new for ' || user_id || '.'"), ("device_novelty > 0", "'The device is new for ' || user_id || '.'"),
    ("session_novelty > 0", "'A session is used that never began.'"), ("session_context_shift >= 0.6", "'A session changed several parts of its context.'"), ("session_concurrency >= 0.5", "'A session is used from two contexts at once.'"), ("session_replay_burst >= 0.5", "'A session repeats requests within seconds.'"),
    ("session_fingerprint_drift >= 0.5", "'A session''s client changed.'"), ("takeover_transition >= 0.6", "'The context changed as a session went on.'"), ("privileged_escalation > 0", "'A privileged action followed a change of context.'"), ("takeover_sequence_score >= 0.5", "'Login, refresh and privileged action came in order.'"),
    ("mfa_bypass_suspicion > 0", "'A success without a second factor followed failures with one.'"), ("password_spray_score >= 0.5", "'Failures of many users come from one address.'"), ("low_and_slow_score >= 0.5", "'Failures from one address are spread over hours.'"), ("campaign_score >= 0.5", "'Neighbouring events look like one campaign.'"),
    ("shared_ip_users > 2", "'The address has had ' || shared_ip_users::INT || ' users.'"), ("shared_device_users > 1", "'The device has had ' || shared_device_users::INT || ' users.'"), ("shared_infra_pair_users >= 1", "'Another user has had this address and network.'"),
    ("infra_burst_peer_count >= 1", "'Other users were just now on this address and network.'"), ("infra_burst_event_count >= 3", "'This address and network are busy.'"), ("sync_peer_count > 0", "'Just now active too: ' || sync_peer_count::INT || ' other users.'"),
)
#: All signals of all events, unrounded, as the table ``sig``.
SIGNALS = f"""WITH {EVENTS}, {', '.join(f'p{i} AS MATERIALIZED {_exact(ORACLES[n])}' for i, n in enumerate(_PARTS))},
ag AS (SELECT event_index, CASE WHEN first(user_agent) OVER s <> user_agent THEN 0.5 ELSE 0 END AS agent FROM ev WINDOW s AS (PARTITION BY user_id, session_id ORDER BY us, event_index)),
s1 AS (SELECT * FROM ev JOIN ag USING (event_index) {' '.join(f'JOIN p{i} USING (event_index)' for i in range(len(_PARTS)))}),
s2 AS (SELECT *, {_CLAMP.format('greatest(shared_ip_users, shared_device_users, shared_asn_users, shared_infra_pair_users, infra_burst_peer_count) / 10.0')} AS fanout_score,
       greatest(agent, CASE WHEN session_concurrency > 0 THEN 1.0 ELSE 0 END, takeover_transition) AS session_fingerprint_drift FROM s1),
s3 AS (SELECT *, {_weighed(_SEQUENCE)} AS sequence_score, {_weighed(_RELATION)} AS relationship_score, {_weighed(_CAMPAIGN)} AS campaign_score,
       greatest(session_context_shift, session_concurrency, session_replay_burst, session_fingerprint_drift, takeover_sequence_score, takeover_transition, privileged_escalation) AS takeover_support FROM s2),
sig AS MATERIALIZED (SELECT *, {_weighed(_TAKEOVER)} AS takeover_score, (sequence_score + relationship_score) / 2 AS fusion_score FROM s3)"""
SAID = ", ".join(f"CASE WHEN {a} THEN {b} END" for a, b in _SAID)
ORACLES["identity_signals"] = f"""{SIGNALS} SELECT event_index, user_id, {', '.join(f'round({c}::DOUBLE, 6) + 0 AS {c}' for c in identity.SIGNALS)},
 array_to_string(list_filter([{SAID}], lambda x: x IS NOT NULL), ';') AS reasons FROM sig"""
