"""Queries of the pattern rules and correlators."""

from __future__ import annotations

from tidewatch.operators import rules
from tidewatch.plans.sql import EVENTS, PRIOR, bursts, user_order
from tidewatch.sources.readers import stream_table

COLUMNS = ("rule_id", "severity", "key", "first_event", "n_events", "users", "matched_at")


def _run(f, **parameters):
    return lambda spark, d: f(stream_table(spark, d), **parameters).select(*COLUMNS)


QUERIES = {
    "brute_force": _run(rules.brute_force, max_failures=3, window_minutes=1440),
    "impossible_travel": _run(rules.impossible_travel),
    "credential_stuffing": _run(rules.credential_stuffing, window_minutes=60, max_success_rate=0.6),
    "off_hours": _run(rules.off_hours),
    "dormant_account": _run(rules.dormant_account, dormant_days=3),
    "new_device_new_location": _run(rules.new_device_new_location),
    "mfa_bypass": _run(rules.mfa_bypass),
    "session_hijack": _run(rules.session_hijack),
    "password_spraying": _run(rules.password_spraying, max_success_rate=0.6),
    "low_and_slow_campaign": _run(rules.low_and_slow, short_burst_cap=4),
    "shared_infrastructure_burst": _run(rules.shared_infrastructure),
    "correlate_by_ip": _run(rules.correlate_by_ip),
    "correlate_by_timing": _run(rules.correlate_by_timing, window_minutes=15),
    "correlate_by_failures": lambda spark, d: rules.correlate_by_failures(stream_table(spark, d)),
    "rules_summary": lambda spark, d: rules.evaluate(stream_table(spark, d), ["impossible_travel", "off_hours_login", "mfa_bypass", "session_hijack", "new_device_new_location"])
    .groupBy("rule_id", "severity").count().withColumnRenamed("count", "matches"),
}


def _one(rule: str, severity: str, key: str = "user_id", first: str = "event_index", n: str = "1", users: str = "user_id") -> str:
    return f"'{rule}' AS rule_id, {severity if severity.startswith('CASE') else repr(severity)} AS severity, {key} AS key, {first} AS first_event, CAST({n} AS BIGINT) AS n_events, {users} AS users, us AS matched_at"


_NAMES = "list_sort(list_distinct(list(user_id) OVER w)) AS names"
_JOINED = "array_to_string(names, ',')"
_TRAVEL = f"""SELECT {_one("impossible_travel", "critical", first="was_at", n="2")}
FROM (SELECT *, us - lag(us) OVER o AS step, lag(country_code) OVER o AS was, lag(event_index) OVER o AS was_at FROM ev WINDOW o AS ({user_order()}))
WHERE step > 0 AND step <= 3600000000 AND was <> country_code"""
_OFF = f"""SELECT {_one("off_hours_login", "low")} FROM ev WHERE hour(timestamp) < 6 OR hour(timestamp) >= 22"""
_MFA = f"""SELECT {_one("mfa_bypass", "critical")}
FROM (SELECT *, count(*) FILTER (failed AND mfa_used) OVER ({user_order()} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS n FROM ev)
WHERE success AND NOT mfa_used AND n >= 2"""
_HIJACK = f"""SELECT {_one("session_hijack", "critical", key="session_id", first="began", n="2")}
FROM (SELECT *, sum(changes) OVER ({user_order("session_id")}) AS total FROM
  (SELECT *, coalesce((ip_address <> lag(ip_address) OVER o)::INT, 0) + coalesce((user_agent <> lag(user_agent) OVER o)::INT, 0) AS changes,
          first(event_index) OVER o AS began FROM ev WINDOW o AS ({user_order("session_id")})))
WHERE changes > 0 AND total >= 1"""
_NEW = f"""SELECT {_one("new_device_new_location", "high")}
FROM (SELECT *, sum(nd) OVER ({user_order()} {PRIOR}) AS pd, sum(nc) OVER ({user_order()} {PRIOR}) AS pc FROM
  (SELECT *, (row_number() OVER (PARTITION BY user_id, device_fingerprint ORDER BY us, event_index) = 1)::INT AS nd,
          (row_number() OVER (PARTITION BY user_id, country_code ORDER BY us, event_index) = 1)::INT AS nc FROM ev))
WHERE nd = 1 AND nc = 1 AND pd > 0 AND pc > 0"""

ORACLES = {
    "brute_force": bursts("user_id", 1440, "count(*) OVER w AS n", "n >= 3", _one("brute_force", "high", n="n"), "failed"),
    "impossible_travel": f"WITH {EVENTS} {_TRAVEL}",
    "credential_stuffing": bursts("ip_address", 60, f"count(*) OVER w AS n, count(*) FILTER (failed) OVER w AS f, count(*) FILTER (success) OVER w AS s, {_NAMES}", "len(names) >= 3 AND f >= 6 AND s / n <= 0.6", _one("credential_stuffing", "critical", "ip_address", n="n", users=_JOINED)),
    "off_hours": f"WITH {EVENTS} {_OFF}",
    "dormant_account": f"""WITH {EVENTS} SELECT {_one("dormant_account", "medium")}
FROM (SELECT *, floor((us - lag(us) OVER ({user_order()})) / 86400000000) AS days FROM ev) WHERE days >= 3""",
    "new_device_new_location": f"WITH {EVENTS} {_NEW}",
    "mfa_bypass": f"WITH {EVENTS} {_MFA}",
    "session_hijack": f"WITH {EVENTS} {_HIJACK}",
    "password_spraying": bursts("ip_address", 45, "count(*) OVER w AS n, count(*) FILTER (success) OVER w AS s, list_filter(list(CASE WHEN failed THEN user_id END) OVER w, lambda x: x IS NOT NULL) AS tries", "s / n <= 0.6 AND len(list_distinct(tries)) >= 4 AND list_max(list_transform(list_distinct(tries), lambda u: len(list_filter(tries, lambda x: x = u)))) <= 2", _one("password_spraying", "critical", "ip_address", n="n", users="array_to_string(list_sort(list_distinct(tries)), ',')")),
    "low_and_slow_campaign": bursts("ip_address", 180, f"count(*) OVER w AS n, {_NAMES}, list_sort(list(us) OVER w) AS times", "n >= 5 AND len(names) >= 3 AND times[-1] - times[1] >= 1800000000 AND list_max(list_transform(times, lambda a: len(list_filter(times, lambda b: b >= a AND b <= a + 900000000)))) <= 4", _one("low_and_slow_campaign", "high", "ip_address", n="n", users=_JOINED), "failed"),
    "shared_infrastructure_burst": bursts("ip_address || '/' || asn", 15, f"count(*) OVER w AS n, {_NAMES}", "len(names) >= 3", _one("shared_infrastructure_burst", "critical", "cand.k", n="n", users=_JOINED), partition="k"),
    "correlate_by_ip": bursts("ip_address", 30, f"count(*) OVER w AS n, {_NAMES}", "len(names) >= 3", _one("shared_ip", "CASE WHEN len(names) >= 5 THEN 'high' ELSE 'medium' END", "ip_address", n="n", users=_JOINED)),
    "correlate_by_timing": bursts("'all'", 15, f"count(*) OVER w AS n, {_NAMES}", "len(names) >= 3", _one("timing_burst", "high", "'all'", n="n", users=_JOINED), partition=""),
    "correlate_by_failures": f"""WITH {EVENTS}, u AS (SELECT user_id, count(*) AS n, min(us) AS f FROM ev WHERE failed GROUP BY 1 HAVING n >= 3)
SELECT 'shared_failure_pattern' AS correlation, count(*) AS n_users, sum(n)::BIGINT AS n_events, min(f) AS first_at FROM u HAVING count(*) >= 3""",
    "rules_summary": f"WITH {EVENTS} SELECT rule_id, severity, count(*) AS matches FROM ({' UNION ALL '.join('(' + x + ')' for x in (_TRAVEL, _OFF, _MFA, _HIJACK, _NEW))}) GROUP BY ALL",
}
