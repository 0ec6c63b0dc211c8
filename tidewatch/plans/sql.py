"""Common parts of the SQL oracles."""

#: The ``events`` table as canonical events.
EVENTS = """
ev AS (SELECT event_id AS event_index, ts AS timestamp, epoch_us(ts) AS us, 'u' || user_id AS user_id,
         CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'mfa_failure' WHEN 'click' THEN 'login'
                         WHEN 'view' THEN 'session_refresh' ELSE 'privileged_action' END AS event_type,
         '10.0.0.' || (k % 4) AS ip_address, 'AS' || (64500 + k % 3) AS asn,
         ['US', 'NG', 'RU', 'DE', 'JP'][1 + k % 5] AS country_code,
         'ua-' || (k % 4) AS user_agent, 'dev-' || (k % 7) AS device_fingerprint,
         's-u' || user_id || '-' || CAST(ts AS DATE) AS session_id,
         value AS session_duration_seconds, k % 2 = 0 AS mfa_used, event_type NOT IN ('error', 'signup') AS success,
         event_type IN ('error', 'signup') AS failed
       FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events))"""

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def user_order(key: str = "user_id") -> str:
    return f"PARTITION BY {key} ORDER BY us, event_index"


def bursts(key: str, minutes: int, aggregates: str, qualifies: str, result: str, where: str = "TRUE", partition: str | None = None) -> str:
    """A scan by time that skips each burst: candidates, a recursion over their times, and the result columns."""
    part = f"PARTITION BY {partition}" if partition is not None and partition else (f"PARTITION BY {key}" if partition is None else "")
    w = minutes * 60_000_000
    return f"""
WITH RECURSIVE {EVENTS},
base AS (SELECT *, {key} AS k FROM ev WHERE {where}),
win AS (SELECT *, {aggregates} FROM base WINDOW w AS ({part} ORDER BY us RANGE BETWEEN CURRENT ROW AND {w} FOLLOWING)),
cand AS MATERIALIZED (SELECT * FROM win WHERE {qualifies}),
g AS (SELECT k, min(us) AS t FROM cand GROUP BY k
      UNION ALL SELECT g.k, min(c.us) FROM g JOIN cand c ON c.k = g.k AND c.us > g.t + {w} GROUP BY g.k, g.t)
SELECT {result} FROM cand JOIN g ON cand.k = g.k AND cand.us = g.t"""
