import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import rules
from tidewatch.operators.patterns import MINUTE, bucketed, gap_sessions, greedy_bursts, onward, prior_distinct, with_order
from tidewatch.sources.schema import EVENT

T0 = datetime(2026, 1, 1, 9, 0)
DEFAULTS = {"event_type": "login", "ip_address": "1.1.1.1", "asn": "AS1", "country_code": "US", "user_agent": "ua", "device_fingerprint": "d", "session_id": None, "session_duration_seconds": None, "auth_method": None, "mfa_used": None, "success": True, "failure_reason": None, "raw_fields": {}}


@pytest.fixture(scope="session")
def events(spark):
    """A function of (user, minutes, overrides) tuples -> canonical events."""

    def make(rows):
        out = []
        for i, (user, minutes, more) in enumerate(rows):
            r = {"event_index": i, "timestamp": T0 + timedelta(minutes=minutes), "user_id": user, **DEFAULTS, **more}
            out.append(tuple(r[f.name] for f in EVENT.fields))
        return spark.createDataFrame(out, EVENT)

    return make


FAIL = {"event_type": "failed_login", "success": False}


def matched(df):
    return sorted((r["key"], r["first_event"], r["n_events"]) for r in df.collect())


def test_brute_force_bursts_do_not_overlap(events):
    rows = [("a", m, FAIL) for m in (0, 1, 2, 3, 4, 5, 20, 21)] + [("b", 0, FAIL)]
    assert matched(rules.brute_force(events(rows))) == [("a", 0, 6)]
    assert matched(rules.brute_force(events(rows), 2, 1)) == [("a", 0, 2), ("a", 2, 2), ("a", 4, 2), ("a", 6, 2)]


def test_greedy_windows_match_a_row_by_row_fold_with_ties(events):
    rng = random.Random(11)
    rows = [(f"u{rng.randint(0, 6)}", rng.randint(0, 300), {"ip_address": f"ip{rng.randint(0, 2)}"}) for _ in range(400)]
    want = []
    for ip in {r[2]["ip_address"] for r in rows}:
        own = sorted((r[1], i, r[0]) for i, r in enumerate(rows) if r[2]["ip_address"] == ip)
        i = 0
        while i < len(own):
            burst = [x for x in own[i:] if x[0] <= own[i][0] + 5]
            if len({x[2] for x in burst}) >= 4:
                want.append((ip, own[i][1], len(burst)))
                i += len(burst)
            else:
                i += 1
    assert matched(rules.correlate_by_ip(events(rows), 4, 5)) == sorted(want)


def test_timing_correlation_needs_no_key(events):
    rows = [("a", 0, {}), ("b", 1, {"ip_address": "x"}), ("c", 4, {"ip_address": "y"}), ("d", 30, {})]
    assert matched(rules.correlate_by_timing(events(rows))) == [("all", 0, 3)]


def test_impossible_travel_and_dormancy(events):
    rows = [("a", 0, {}), ("a", 30, {"country_code": "RU"}), ("a", 31, {"country_code": None}), ("a", 200, {"country_code": "US"}), ("a", 200 + 60 * 24 * 31, {"country_code": "US"})]
    assert matched(rules.impossible_travel(events(rows))) == [("a", 0, 2)]
    assert matched(rules.dormant_account(events(rows))) == [("a", 4, 1)]


def test_stuffing_spraying_and_slow_campaigns(events):
    stuffing = [(f"u{i % 3}", i, FAIL) for i in range(6)]
    assert matched(rules.credential_stuffing(events(stuffing))) == [("1.1.1.1", 0, 6)]
    assert matched(rules.credential_stuffing(events(stuffing[:5]))) == []
    spray = [(f"u{i}", i, FAIL) for i in range(4)]
    assert matched(rules.password_spraying(events(spray))) == [("1.1.1.1", 0, 4)]
    assert matched(rules.password_spraying(events([*spray, ("u0", 4, FAIL), ("u0", 5, FAIL)]))) == [("1.1.1.1", 1, 5)]  # from the second row on, nobody has three
    slow = [(f"u{i % 3}", 20 * i, FAIL) for i in range(6)]
    assert matched(rules.low_and_slow(events(slow))) == [("1.1.1.1", 0, 6)]
    fast = [(f"u{i % 3}", 2 * i, FAIL) for i in range(6)] + [("u0", 60, FAIL)]
    assert matched(rules.low_and_slow(events(fast))) == []


def test_mfa_bypass_counts_unknown_as_none(events):
    failure = {"event_type": "mfa_failure", "success": False, "mfa_used": True}
    rows = [("a", 0, failure), ("a", 1, failure), ("a", 2, {}), ("b", 0, failure), ("b", 1, {})]
    assert matched(rules.mfa_bypass(events(rows))) == [("a", 2, 1)]


def test_session_hijack_compares_with_the_last_known_context(events):
    s = {"session_id": "s"}
    rows = [("a", 0, s), ("a", 1, {**s, "ip_address": None}), ("a", 2, {**s, "ip_address": "2.2.2.2"}), ("a", 3, {**s, "ip_address": "2.2.2.2"})]
    assert matched(rules.session_hijack(events(rows))) == [("s", 0, 2)]
    assert matched(rules.session_hijack(events(rows), 2)) == []


def test_new_device_and_location_and_hours(events):
    rows = [("a", 0, {}), ("a", 1, {"device_fingerprint": "e", "country_code": "RU"}), ("a", 2, {"device_fingerprint": "f"}), ("a", 900, {})]
    assert matched(rules.new_device_new_location(events(rows))) == [("a", 1, 1)]
    assert matched(rules.off_hours(events(rows))) == [("a", 3, 1)]
    assert matched(rules.shared_infrastructure(events([("a", 0, {}), ("b", 1, {}), ("c", 15, {}), ("d", 40, {})]))) == [("1.1.1.1/AS1", 0, 3)]


def test_failure_pattern(events):
    rows = [(u, m, FAIL) for u in "abc" for m in range(3)]
    (r,) = rules.correlate_by_failures(events(rows)).collect()
    assert (r["n_users"], r["n_events"]) == (3, 9)
    assert rules.correlate_by_failures(events(rows[:6])).count() == 0


def test_every_registered_rule_runs(events):
    out = rules.evaluate(events([("a", i, FAIL) for i in range(6)]))
    assert {r["rule_id"] for r in out.collect()} == {"brute_force"}
    assert len(rules.REGISTRY) == 11


def test_patterns(events):
    df = with_order(events([("a", 0, {}), ("a", 0, {"country_code": "RU"}), ("a", 100, {}), ("b", 0, {})]), "user_id")
    got = {r["event_index"]: r["n"] for r in prior_distinct(df, "user_id", "country_code", "n").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}
    got = {r["event_index"]: r["s"] for r in gap_sessions(df, "user_id", 45 * MINUTE, "s").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}
    placed = bucketed(df, 10 * MINUTE)
    counted = placed.withColumn("n", F.count("*").over(onward(["user_id", "bucket"], 10 * MINUTE))).where("anchor")
    assert {r["event_index"]: r["n"] for r in counted.collect()} == {0: 2, 1: 1, 2: 1, 3: 1}
    assert greedy_bursts(df.where("false"), ["user_id"], MINUTE).count() == 0


def test_order_of_input_rows_does_not_matter(events):
    rng = random.Random(2)
    df = events([(f"u{rng.randint(0, 5)}", rng.randint(0, 100), FAIL if rng.random() < 0.5 else {}) for _ in range(120)])
    shuffled = df.orderBy(F.xxhash64("event_index"))
    for f in (rules.brute_force, rules.correlate_by_ip, rules.password_spraying):
        assert matched(f(df)) == matched(f(shuffled))


def scan_by_hand(rows, key, within, fits):
    """(key, first row, rows) of the bursts of a row-by-row scan; ``fits`` judges the rows of a window."""
    want = []
    for k in {key(r[2]) for r in rows} - {None}:
        own = sorted((r[1], i, r) for i, r in enumerate(rows) if key(r[2]) == k)
        i = 0
        while i < len(own):
            burst = [x for x in own[i:] if x[0] <= own[i][0] + within]
            if fits(burst):
                want.append((k, own[i][1], len(burst)))
                i += len(burst)
            else:
                i += 1
    return sorted(want)


def dense_rows(seed, n=600, minutes=500):
    rng = random.Random(seed)
    return [(f"u{rng.randint(0, 9)}", rng.randint(0, minutes), {"ip_address": rng.choice(["a", "b", None]), **(FAIL if rng.random() < 0.6 else {})}) for _ in range(n)]


def no_row_carries_its_window(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any("Window [" in line and "collect" in line for line in plan.splitlines())


def test_shared_addresses_keep_no_sets_per_row(events):
    rows = dense_rows(1)
    found = rules.correlate_by_ip(events(rows), 4, 5)
    assert matched(found) == scan_by_hand(rows, lambda r: r["ip_address"], 5, lambda b: len({x[2][0] for x in b}) >= 4)
    assert no_row_carries_its_window(found)


def test_bursts_go_on_over_batches(spark, events):
    rows = dense_rows(6)
    want = matched(rules.correlate_by_ip(events(rows), 4, 5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert matched(rules.correlate_by_ip(events(rows), 4, 5)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_timing_keeps_no_sets_per_row(events):
    rows = dense_rows(2, 300)
    found = rules.correlate_by_timing(events(rows), 4, 5)
    assert matched(found) == scan_by_hand(rows, lambda r: "all", 5, lambda b: len({x[2][0] for x in b}) >= 4)
    assert no_row_carries_its_window(found)


def test_stuffing_keeps_no_sets_per_row(events):
    rows = dense_rows(4)
    failed = lambda b: sum("event_type" in x[2][2] for x in b)
    found = rules.credential_stuffing(events(rows), 3, 4, 10, 0.3)
    want = scan_by_hand(rows, lambda r: r["ip_address"], 10, lambda b: len({x[2][0] for x in b}) >= 3 and failed(b) >= 4 and (len(b) - failed(b)) / len(b) <= 0.3)
    assert want
    assert matched(found) == want
    assert no_row_carries_its_window(found)


def test_slow_campaigns_keep_no_lists_per_row(events):
    rows = dense_rows(5, 150, 3000)

    def fits(b):
        times = [x[0] for x in b]
        crowded = any(sum(t <= y <= t + 15 for y in times[i:]) > 3 for i, t in enumerate(times))
        return len(b) >= 5 and len({x[2][0] for x in b}) >= 3 and times[-1] - times[0] >= 30 and not crowded

    failures = [r if "event_type" in r[2] else (r[0], r[1], {**r[2], "ip_address": None}) for r in rows]
    found = rules.low_and_slow(events(rows))
    want = scan_by_hand(failures, lambda r: r["ip_address"], 180, fits)
    assert want
    assert matched(found) == want
    assert no_row_carries_its_window(found)


def test_all_correlations_keep_no_sets_per_row(events):
    rows = dense_rows(3)
    found = rules.correlate(events(rows), 4, 5, 5, 3)
    assert found.where("rule_id <> 'shared_failure_pattern'").count() == rules.correlate_by_ip(events(rows), 4, 5).count() + rules.correlate_by_timing(events(rows), 4, 5).count()
    assert no_row_carries_its_window(found)


@pytest.fixture
def row_shuffles(spark):
    """A function of a frame -> exchanges by key of its plan as it ran, without those that were used again."""

    def count(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return sum("Exchange hashpartitioning(__key" in line and "Reused" not in line for line in plan.splitlines())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield count
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_bursts_are_shuffled_once(events, row_shuffles):
    df = events(dense_rows(7))
    assert row_shuffles(rules.correlate(df, 4, 5, 5, 3)) == 2
    assert row_shuffles(rules.correlate(df, 4, 5, 5, 3).drop("details")) == 2
    for found in (rules.correlate_by_ip(df, 4, 5), rules.correlate_by_timing(df, 4, 5), rules.credential_stuffing(df, 3, 4, 10, 0.3), rules.low_and_slow(events(dense_rows(5, 150, 3000)))):
        assert row_shuffles(found) == 1


def test_only_narrow_rows_are_numbered(events):
    plan = rules.correlate(events(dense_rows(3)), 4, 5, 5, 3)._jdf.queryExecution().optimizedPlan()

    def windows(p):
        children = [p.children().apply(i) for i in range(p.children().size())]
        return ([p] if p.nodeName() == "Window" else []) + [w for c in children for w in windows(c)]

    found = windows(plan)
    assert found and not any("users" in w.output().mkString(",") for w in found)


def test_clusters_are_numbered_by_strategy_then_time(events):
    rows = dense_rows(8, 900)
    found = {r["cluster_id"]: r for r in rules.correlate(events(rows), 4, 5, 5, 3).collect()}
    users = lambda ks: ",".join(sorted({rows[k][0] for k in ks}))
    want = []
    for name, key in (("shared_ip", lambda r: r["ip_address"]), ("timing_burst", lambda r: "all")):
        own = []
        for k, first, n in scan_by_hand(rows, key, 5, lambda b: len({x[2][0] for x in b}) >= 4):
            at = rows[first][1]
            burst = [i for i, r in enumerate(rows) if key(r[2]) == k and (at, first) <= (r[1], i) and r[1] <= at + 5]
            more = {} if name == "shared_ip" else {"unique_ips": len({rows[i][2]["ip_address"] for i in burst} - {None})}
            own.append((at, first, k, name, n, users(burst), more))
            assert n == len(burst)
        want += sorted(own, key=lambda x: x[:3])
    assert len({w[3] for w in want}) == 2
    got = [found[i + 1] for i in range(len(want))]
    assert [(r["first_event"], r["key"], r["rule_id"], r["n_events"], r["users"]) for r in got] == [w[1:6] for w in want]
    assert all(json.loads(r["details"])["unique_ips"] == w[6]["unique_ips"] for r, w in zip(got, want, strict=True) if w[6])
    last = found[len(want) + 1]
    failing = [i for i, r in enumerate(rows) if "event_type" in r[2]]
    assert len(found) == len(want) + 1 and (last["rule_id"], last["n_events"], last["users"]) == ("shared_failure_pattern", len(failing), users(failing))
    assert last["first_event"] == min(failing, key=lambda i: (rows[i][1], i))
