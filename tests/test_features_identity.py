import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_patterns_rules import DEFAULTS, FAIL, T0, events  # noqa: F401
from tidewatch.operators import features, identity, rules
from tidewatch.operators.patterns import MINUTE, prior_values, sliding, with_order


def by_index(df, *names):
    return {r["event_index"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_base_features(events):  # noqa: F811
    df = events([("a", 0, {}), ("a", 10, {"country_code": "RU", "ip_address": "2.2.2.2"}), ("a", 20, {"country_code": None}), ("a", 60 * 24, FAIL), ("b", 0, FAIL)])
    out = features.build(df)
    assert out.count() == 5
    assert len(out.columns) == 2 + 35
    assert by_index(out, "events_last_hour", "time_since_last_event") == {0: (0, 86400), 1: (1, 600), 2: (2, 600), 3: (0, 85200), 4: (0, 86400)}
    assert by_index(out, "is_known_country", "is_known_ip") == {0: (1, 1), 1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1)}
    assert by_index(out, "unique_countries_24h")[3] == 2
    assert by_index(out, "is_failure")[3] == 1


def test_later_events_do_not_change_earlier_features(events):  # noqa: F811
    rows = [("a", 7 * i, {"ip_address": f"ip{i % 3}", **(FAIL if i % 4 == 0 else {})}) for i in range(20)]
    early, late = identity.build(events(rows[:12])), identity.build(events(rows))
    a = {r["event_index"]: r for r in early.collect()}
    b = {r["event_index"]: r for r in late.collect()}
    assert all(a[i] == b[i] for i in a)


@pytest.fixture()
def kernel(spark):
    def make(pair, user, seconds):
        rows = [(i, p, f"u{u}", s) for i, (p, u, s) in enumerate(zip(pair, user, seconds, strict=True))]
        df = spark.createDataFrame(rows, "event_index long, pair int, user_id string, s int")
        return df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000))

    return make


def test_kernel_prior_users(kernel):
    df = kernel([10, 10, 12, 10, 12], [1, 2, 2, 1, 3], range(5))
    assert [by_index(prior_values(df, F.col("pair"), F.col("user_id"), "n"), "n")[i] for i in range(5)] == [0, 1, 0, 2, 1]
    assert [by_index(identity.pair_prior_users(df, F.col("pair")), "shared_infra_pair_users")[i] for i in range(5)] == [0, 1, 0, 1, 1]


def test_kernel_recent_peers_and_volume(kernel):
    df = sliding(kernel([10, 10, 10, 12, 10], [1, 1, 2, 3, 4], [0, 20, 30, 31, 100]), F.col("pair"), {"w": 45_000_000}, who=F.col("user_id"))
    assert [by_index(df, "w_others")[i] for i in range(5)] == [0, 0, 1, 0, 0]
    df = sliding(kernel([10, 10, 12, 10, 12], [1, 2, 3, 4, 5], [0, 20, 21, 40, 90]), F.col("pair"), {"w": 45_000_000})
    assert [by_index(df, "w")[i] for i in range(5)] == [0, 1, 0, 2, 0]


def test_sliding_counts_match_a_row_by_row_fold(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a", "a", "b"]), rng.choice([None, "u", "v", "w"]), rng.choice([0, 1, 1]), rng.randint(0, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_index long, k string, who string, weight int, s int").withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    spans = {"x": 5_000_000, "y": 17_000_000}
    got = {r["event_index"]: r for r in sliding(df, F.col("k"), spans, who=F.col("who"), first=("x", "y")).collect()}
    weighed = {r["event_index"]: r for r in sliding(df, F.col("k"), spans, weight=F.col("weight")).collect()}
    assert set(got) == set(weighed) == {r[0] for r in rows if r[1] is not None}
    for i, k, who, _, s in rows:
        if k is None:
            continue
        for name, us in spans.items():
            near = [r for r in rows if r[1] == k and (r[4], r[0]) < (s, i) and r[4] >= s - us // 1_000_000]
            assert got[i][name] == len(near) and weighed[i][name] == sum(r[3] for r in near)
            assert got[i][f"{name}_all"] == len({r[2] for r in near}) and got[i][f"{name}_others"] == len({r[2] for r in near} - {who})
            assert got[i][f"{name}_first"] == (min(1_000_000 * (r[4] + 1_700_000_000) for r in near) if near else None)


def test_thousands_of_events_at_one_time(spark):
    n = 5000
    rows = [(i, f"u{i % 50}", "1.1.1.1", "AS1", i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "event_index long, user_id string, ip_address string, asn string, failed boolean")
    df = df.select("*", F.timestamp_seconds(F.lit(1_700_000_000)).alias("timestamp"), F.when(F.col("failed"), "failed_login").otherwise("login").alias("event_type"), (~F.col("failed")).alias("success"), F.lit("s1").alias("session_id"), F.lit("ua").alias("user_agent"), F.lit("d").alias("device_fingerprint"))
    shared = by_index(identity.infrastructure(df), "infra_burst_event_count", "infra_burst_peer_count", "sync_peer_count", "shared_infra_pair_users")
    for i in (0, 1, 49, 50, 1023, 1024, 1025, 2999, 4999):
        users = {f"u{k % 50}" for k in range(i)} - {f"u{i % 50}"}
        assert shared[i] == (i, len(users), len(users), len(users))
    velocity = by_index(features.velocity(features.ordered(df.withColumn("user_id", F.lit("u")))), "events_last_hour", "avg_inter_event_time")
    assert velocity[4999] == (1000, 0) and velocity[900] == (900, 0) and velocity[0] == (0, 86400)
    (burst,) = rules.brute_force(df.withColumn("user_id", F.lit("u"))).collect()
    assert (burst["first_event"], burst["n_events"]) == (0, 1667)


def test_gap_statistics_with_and_without_a_bound(spark):
    rng = random.Random(6)
    rows = [(f"u{u}", i, u * 1000 + i, None if i == 0 or rng.random() < 0.1 else float(rng.choice([1, 2, 2, 5, 9, 30]))) for u in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id string, ord long, event_index long, gap double")
    for history in (None, 7):
        got = {r["event_index"]: (r["middle"], r["spread"]) for r in identity.gap_statistics(df, history).collect()}
        for u, i, k, _ in rows:
            past = [g for v, j, _, g in rows if v == u and j < i and (history is None or j >= i - history) and g is not None]
            mid = statistics.median(past) if past else None
            assert got[k] == (mid, statistics.median([abs(g - mid) for g in past]) if past else None)


def test_ordered_takeover(events):  # noqa: F811
    rows = [("a", 0, {}), ("a", 3, {"event_type": "session_refresh"}), ("a", 6, {"event_type": "privileged_action"}), ("b", 0, {"event_type": "session_refresh"}), ("b", 1, {"event_type": "privileged_action"}), ("c", 0, {}), ("c", 30, {"event_type": "session_refresh"}), ("c", 31, {"event_type": "privileged_action"})]
    assert by_index(identity.signals(events(rows)), "takeover_sequence_score") == {0: 0, 1: 0.5, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_intervals_use_median_and_its_deviation(events):  # noqa: F811
    minutes = [0, 5, 11, 13, 40, 41, 90]
    out = by_index(identity.rhythm(with_order(events([("a", m, {}) for m in minutes]), "user_id")), "interval_deviation")
    gaps = [60.0 * (b - a) for a, b in zip(minutes, minutes[1:], strict=False)]
    for i in range(2, 7):
        prior = gaps[: i - 1]
        mid = statistics.median(prior)
        mad = max(statistics.median([abs(g - mid) for g in prior]), 1.0)
        assert out[i] == pytest.approx(min(abs(gaps[i - 1] - mid) / mad, 10.0))
    assert out[0] == 0


def test_takeover_trio_is_explained(events):  # noqa: F811
    s = {"session_id": "s1"}
    rows = [("a", 0, {**s, "country_code": "NG"}), ("a", 3, {**s, "event_type": "session_refresh", "country_code": "RU", "ip_address": "9.9.9.9", "asn": "AS9", "device_fingerprint": "x", "auth_method": "token_refresh"}), ("a", 6, {**s, "event_type": "privileged_action", "country_code": "RU", "ip_address": "9.9.9.9", "asn": "AS9", "device_fingerprint": "x"})]
    out = {r["event_index"]: r for r in identity.build(events(rows)).collect()}
    assert out[1]["takeover_transition"] == 1 and out[1]["session_context_shift"] == 1 and out[1]["geo_velocity_flag"] == 1
    assert out[2]["privileged_escalation"] == 1 and out[2]["takeover_sequence_score"] == 1
    assert len(out[1]["reasons"]) > 4


def test_spray_and_slow_scores(events):  # noqa: F811
    rows = [(f"u{i}", i, FAIL) for i in range(4)]
    out = by_index(identity.failures(events(rows)), "password_spray_score", "low_and_slow_score")
    assert out[1] == (0, 0) and out[2][0] == pytest.approx(2 / 4 + 0 + 1 / 4) and out[3][1] > 0
    assert MINUTE == 60_000_000
