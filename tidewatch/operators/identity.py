"""Identity features: shared infrastructure, sessions, failures, rhythm, geography, takeover, and their scores.

All of them look at strictly earlier events in the order (time, event_index),
except synchronous peers, which the caller may read as earlier rows within the
window. What a user's own events say is computed over one partitioning by user.
What shared entities say comes from narrow tables of (event, entity, user) as
running sums over (entity, time bucket), joined by event, so a shared address
doesn't fall to one task and events without the entity aren't moved.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import HIGH_RISK_COUNTRIES, clamp01, country_distance_km, flag
from tidewatch.operators.patterns import MINUTE, attach, attach_all, backward, before, first_seen, gap_sessions, micros, ordered_buckets, prior_values, sliding, stacked, with_order
from tidewatch.operators.rules import is_failure

USER = "user_id"
RELATION, BURST, SESSION_GAP, MOST_SHARED = 15 * MINUTE, 5 * MINUTE, 45 * MINUTE, 10


def pair_key() -> Column:
    """The first pair of infrastructure that an event has, else the single part, else ``missing``."""
    ip, dev, asn = F.col("ip_address"), F.col("device_fingerprint"), F.col("asn")
    both = lambda n, a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.lit(n), a, b))
    one = lambda n, a: F.when(a.isNotNull(), F.concat_ws("|", F.lit(n), a))
    return F.coalesce(both("ip_asn", ip, asn), both("ip_device", ip, dev), both("device_asn", dev, asn), one("ip", ip), one("device", dev), one("asn", asn), F.lit("missing"))


def stage() -> Column:
    """3 for privileged actions, 2 for refreshes, 1 for logins and failed ones, else 0."""
    kind = F.col("event_type")
    return (
        F.when(kind == "privileged_action", 3)
        .when((kind == "session_refresh") | F.coalesce(F.col("auth_method") == "token_refresh", F.lit(False)), 2)
        .when(kind.isin("login", "failed_login"), 1)
        .otherwise(0)
    )


_ENTITIES = {"ip": "ip_address", "device": "device_fingerprint", "asn": "asn"}


def _by_kind(kind: str, value: Column) -> Column:
    """The value of an event's row of a kind, 0 if it has none."""
    return F.coalesce(F.max(F.when(F.substring_index("__key", "|", 1) == kind, value)), F.lit(0)).cast("double")


def entity_history(events: DataFrame) -> DataFrame:
    """(event_index, shared_ip_users, shared_device_users, shared_asn_users, shared_infra_pair_users): different earlier users.

    Of the pair, other ones than the event's own.
    """
    rows = stacked(events, {n: F.col(c) for n, c in _ENTITIES.items()} | {"pair": pair_key()}, "event_index", "timestamp", USER)
    seen = prior_values(rows, F.col("key"), F.col(USER), "n")
    others = F.greatest(F.col("n") - 1 + F.col("n_new"), F.lit(0))
    return seen.groupBy("event_index").agg(*[_by_kind(n, F.col("n")).alias(f"shared_{n}_users") for n in _ENTITIES], _by_kind("pair", others).alias("shared_infra_pair_users"))


def shared_counts(df: DataFrame) -> DataFrame:
    """shared_ip_users, shared_device_users, shared_asn_users: different earlier users of the event's entity."""
    return attach(df, entity_history(df).drop("shared_infra_pair_users"))


def pair_prior_users(df: DataFrame, pair: Column) -> DataFrame:
    """(event_index, shared_infra_pair_users): different other users who had the pair before."""
    seen = prior_values(df, pair, F.col(USER), "n")
    return seen.select("event_index", F.greatest(F.col("n") - 1 + F.col("n_new"), F.lit(0)).cast("double").alias("shared_infra_pair_users"))


def _whole_seconds() -> Column:
    return F.floor(micros() / 1_000_000) * 1_000_000


def entity_neighbours(events: DataFrame) -> DataFrame:
    """(event_index, infra_burst_peer_count, infra_burst_event_count, sync_peer_count): recent other users and events.

    Those of the pair are read in whole seconds; synchronous peers are those of
    the address, the device or the pair, whichever has most.
    """
    rows = stacked(events, {"pair": pair_key(), "ip": F.col("ip_address"), "device": F.col("device_fingerprint")}, "event_index", "timestamp", USER)
    time = F.when(F.col("kind") == "pair", _whole_seconds()).otherwise(micros())
    near = sliding(rows, F.col("key"), {"r": RELATION}, who=F.col(USER), time=time, with_row=True)
    found = near.groupBy("event_index").agg(*[_by_kind(n, F.col("r_others")).alias(f"__{n}") for n in ("pair", "ip", "device")], _by_kind("pair", F.col("r")).alias("infra_burst_event_count"))
    return found.select("event_index", F.col("__pair").alias("infra_burst_peer_count"), "infra_burst_event_count", F.greatest("__ip", "__device", "__pair").alias("sync_peer_count"))


def infrastructure(df: DataFrame) -> DataFrame:
    """Pair users, recent other users and recent events on the pair (whole seconds), and synchronous peers."""
    return attach(attach(df, entity_history(df).select("event_index", "shared_infra_pair_users")), entity_neighbours(df))


def novelty(df: DataFrame) -> DataFrame:
    """ip, device, country, asn and session novelty of an event for its user."""
    late = F.col("event_type").isin("session_refresh", "privileged_action")
    new = {f"{n}_novelty": first_seen(USER, c).cast("double") for c, n in (("ip_address", "ip"), ("device_fingerprint", "device"), ("country_code", "country"), ("asn", "asn"))}
    return df.withColumns(new | {"session_novelty": flag((first_seen(USER, "session_id") == 1) & late)})


def factor_failures(events: DataFrame) -> DataFrame:
    """(event_index, __p): second-factor failures within the window up to the user's last event."""
    failed = F.coalesce(is_failure() & F.col("mfa_used"), F.lit(False))
    seen = sliding(events, F.col(USER), {"__f": max(RELATION, 30 * MINUTE)}, weight=failed, with_row=True)
    last = F.lag(F.col("__f") + F.col("__w")).over(Window.partitionBy("__key").orderBy("__us", "event_index"))
    return seen.select("event_index", F.coalesce(last, F.lit(0)).alias("__p"))


def _suspicion() -> Column:
    return flag(F.col("success") & (F.col("mfa_used") == F.lit(False)) & (F.col("__p") >= 2))


def mfa_suspicion(df: DataFrame) -> DataFrame:
    """A success known to lack a second factor after two second-factor failures, as counted at the user's last event."""
    return attach(df, factor_failures(df)).withColumn("mfa_bypass_suspicion", _suspicion()).drop("__p")


def session_context(df: DataFrame) -> DataFrame:
    """Context differences from the first event of (user, session): shift, changed agent, privileged follow-up."""
    w = Window.partitionBy(USER, "session_id").orderBy("ord")
    fields = ("ip_address", "device_fingerprint", "country_code", "asn")
    has = F.col("session_id").isNotNull() & (F.row_number().over(w) > 1)
    df = df.withColumns({"__in": has, **{f"__f_{c}": F.first(c).over(w) for c in (*fields, "user_agent")}})
    deltas = reduce(lambda a, c: a + F.when(F.col(f"__f_{c}") != F.col(c), 1).otherwise(0), fields, F.lit(0))
    df = df.withColumn("session_deltas", F.when(F.col("__in"), deltas).otherwise(0))
    df = df.withColumn("session_context_shift", F.when(F.col("session_deltas") >= 2, clamp01(F.col("session_deltas") / 3.0)).otherwise(0.0))
    return df.withColumn("__agent", F.when(F.col("__in") & (F.col("__f_user_agent") != F.col("user_agent")), 0.5).otherwise(0.0)).drop("__in", *[f"__f_{c}" for c in (*fields, "user_agent")])


def session_use(df: DataFrame) -> DataFrame:
    """(event_index, __apart, session_concurrency, session_replay_burst): concurrent use of a session and replay bursts.

    They look at its earlier events within the window of its last one, which
    are held together, in buckets of time. Events without a session aren't there.
    """
    here = F.struct(F.col("us").alias("t"), F.col(USER).alias("u"), F.col("ip_address").alias("i"), F.col("user_agent").alias("a"))
    rows = df.where("session_id IS NOT NULL").select("event_index", "session_id", "timestamp", micros().alias("us"), USER, "ip_address", "user_agent")
    placed = ordered_buckets(rows, "session_id", RELATION, "__so", look_back=True)
    placed = placed.withColumn("__kept", F.collect_list(here).over(backward(["session_id", "bucket"], RELATION, "__so"))).where("anchor")
    placed = placed.withColumn("__r", F.coalesce(F.lag("__kept").over(Window.partitionBy("session_id").orderBy("us", "event_index")), F.array()))
    differs = lambda x, f, c: F.coalesce(x[f] != F.col(c), F.lit(False))
    apart = F.size(F.filter("__r", lambda x: (x["u"] == F.col(USER)) & (differs(x, "i", "ip_address") | differs(x, "a", "user_agent"))))
    close = F.size(F.filter("__r", lambda x: F.abs(F.col("us") - x["t"]) <= 5_000_000))
    replay = F.when((F.size("__r") >= 3) & (F.col("__close") >= 3), clamp01(F.col("__close") / 6.0)).otherwise(0.0)
    placed = placed.withColumns({"__apart": apart, "__close": close})
    return placed.select("event_index", "__apart", clamp01(F.col("__apart") / 2.0).alias("session_concurrency"), replay.alias("session_replay_burst"))


_NO_SESSION = {"__apart": 0, "session_concurrency": 0.0, "session_replay_burst": 0.0}


def session_activity(df: DataFrame) -> DataFrame:
    """Concurrent use of a session and replay bursts."""
    return attach(df, session_use(df), **_NO_SESSION)


def failure_history(df: DataFrame) -> DataFrame:
    """(event_index, password_spray_score, low_and_slow_score) of failures, from earlier ones of the same address within two hours."""
    failed = df.where(is_failure() & F.col("ip_address").isNotNull())
    seen = sliding(failed, F.col("ip_address"), {"near": 2 * RELATION, "slow": 8 * RELATION, "short": BURST}, who=F.col(USER), first=("slow",), with_row=True)
    up = lambda x: F.greatest(x, F.lit(0.0))
    twice = F.when(F.col("near") > F.col("near_all"), 2.0).otherwise(1.0)  # the most failures of one user count up to two
    spray = clamp01(F.col("near_others") / 4.0 + up((F.col("near") - 2.0) / 8.0) + up((2.0 - twice) / 4.0))
    spread = F.least((F.col("__us") - F.col("slow_first")) / 1e6 / (4 * RELATION / 1e6), F.lit(1.0))
    slow = clamp01(F.col("slow_others") / 4.0 + spread + up((3.0 - F.col("short")) / 4.0))
    return seen.select(
        "event_index",
        F.when(F.col("near_others") >= 2, spray).otherwise(0.0).alias("password_spray_score"),
        F.when((F.col("slow") >= 3) & (F.col("slow_others") >= 2), slow).otherwise(0.0).alias("low_and_slow_score"),
    )


_NO_FAILURE = {"password_spray_score": 0.0, "low_and_slow_score": 0.0}


def failures(df: DataFrame) -> DataFrame:
    """password_spray_score and low_and_slow_score of failures; 0 for other events."""
    return attach(df, failure_history(df), **_NO_FAILURE)


def gap_statistics(rows: DataFrame, history: int | None = None) -> DataFrame:
    """(event_index, middle, spread) of (user_id, ord, event_index, gap): median and median deviation of a user's earlier gaps, null before the first.

    Users' rows come one after another in order; the gaps so far are kept
    sorted, so each row costs two binary searches and an insertion.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, gaps, queue = None, [], deque()

        def deviation(middle: float) -> float:
            n, at = len(gaps), bisect_left(gaps, middle)

            def smallest(k: int) -> float:
                """The k-th smallest distance, of which i lie to the left: there, distances rise to the left."""
                low, high = max(0, k - (n - at)), min(k, at)
                while low < high:
                    i = (low + high) // 2
                    if middle - gaps[at - 1 - i] < gaps[at + k - i - 1] - middle:
                        low = i + 1
                    else:
                        high = i
                last = [middle - gaps[at - low]] * (low > 0) + [gaps[at + k - low - 1] - middle] * (k > low)
                return max(last)

            return smallest(n // 2 + 1) if n % 2 else (smallest(n // 2) + smallest(n // 2 + 1)) / 2

        for batch in batches:
            middles, spreads = [], []
            for who, gap in zip(batch.column("user_id").to_pylist(), batch.column("gap").to_pylist(), strict=True):
                if who != user:
                    user, gaps, queue = who, [], deque()
                n = len(gaps)
                middle = None if not n else gaps[n // 2] if n % 2 else (gaps[n // 2 - 1] + gaps[n // 2]) / 2
                middles.append(middle)
                spreads.append(None if not n else deviation(middle))
                if gap is not None:
                    insort(gaps, gap)
                if history is not None:
                    queue.append(gap)
                    if len(queue) > history and (old := queue.popleft()) is not None:
                        del gaps[bisect_left(gaps, old)]
            yield pa.RecordBatch.from_arrays([batch.column("event_index"), pa.array(middles, pa.float64()), pa.array(spreads, pa.float64())], ["event_index", "middle", "spread"])

    narrow = rows.select(USER, "ord", "event_index", "gap").repartition(USER).sortWithinPartitions(USER, "ord").drop("ord")
    return narrow.mapInArrow(run, "event_index long, middle double, spread double")


def gaps(df: DataFrame) -> DataFrame:
    """gap: seconds since the user's last event, null for the first; burst_score."""
    df = df.withColumn("gap", (micros() - F.lag(micros()).over(Window.partitionBy(USER).orderBy("ord"))) / 1e6)
    return df.withColumn("burst_score", F.when(F.col("gap").isNotNull(), clamp01(1.0 - F.col("gap") / (BURST / 1e6))).otherwise(0.0))


def _deviation() -> Column:
    middle, spread = F.coalesce("middle", F.lit(3600.0)), F.greatest(F.coalesce("spread", F.lit(1.0)), F.lit(1.0))
    return F.when(F.col("gap").isNotNull(), F.least(F.abs(F.col("gap") - middle) / spread, F.lit(10.0))).otherwise(0.0)


def rhythm(df: DataFrame, history: int | None = None) -> DataFrame:
    """interval_deviation: the step to the last event against the median and its deviation of earlier steps; burst_score.

    The whole history counts unless ``history`` bounds it to so many last events.
    """
    df = gaps(df)
    return attach(df, gap_statistics(df, history)).withColumn("interval_deviation", _deviation()).drop("middle", "spread")


def geography(df: DataFrame) -> DataFrame:
    """Country changes within the window and how implausible the speed is; countries of high risk."""
    w = Window.partitionBy(USER).orderBy("ord")
    df = df.withColumn("__c", F.lag("country_code").over(w))
    moved = (F.col("__c") != F.col("country_code")) & (F.col("gap") < RELATION / 1e6)
    df = df.withColumn("__km", country_distance_km(F.col("__c"), F.col("country_code")))
    speed = F.col("__km") / F.greatest(F.col("gap") / 3600.0, F.lit(0.01))
    score = F.when((speed > 900) & (F.col("__km") > 500), clamp01(speed / 1800.0)).when(F.col("__km") > 0, clamp01(F.col("__km") / 12000.0)).otherwise(0.0)
    return df.withColumns(
        {"geo_velocity_flag": flag(moved), "geo_velocity_score": F.when(moved, score).otherwise(0.0), "high_risk_country": flag(F.col("country_code").isin(*HIGH_RISK_COUNTRIES))}
    ).drop("__c", "__km")


def takeover(df: DataFrame) -> DataFrame:
    """Context changes since the last event, their follow-ups, and progress through login, refresh, privileged action."""
    w = Window.partitionBy(USER).orderBy("ord")
    fields = ("ip_address", "device_fingerprint", "country_code", "asn")
    changed = reduce(lambda a, c: a + F.when(F.lag(c).over(w) != F.col(c), 1).otherwise(0), fields, F.lit(0))
    df = df.withColumns({"__n": changed, "__st": stage(), "__sec": F.floor(micros() / 1_000_000)})
    soon = F.col("gap") < RELATION / 1e6
    step = F.when(soon & (F.col("__n") >= 2) & F.col("event_type").isin("login", "session_refresh", "privileged_action"), clamp01(F.col("__n") / 3.0)).otherwise(0.0)
    followed = (F.col("event_type") == "privileged_action") & ((F.col("session_deltas") >= 1) | (soon & (F.col("__n") >= 2)))
    b = before(USER)
    last = lambda v, c: F.last(F.when(F.col("__st") == v, F.col(c)), ignorenulls=True).over(b)
    df = df.withColumns({"__s1": last(1, "__sec"), "__o1": last(1, "ord"), "__s2": last(2, "__sec"), "__o2": last(2, "ord")})
    limit = RELATION // 1_000_000
    in_time = F.col("__sec") - F.col("__s1") <= limit
    # a refresh counts if it came in time after the login that was the last one before it
    df = df.withColumn("__ok2", (F.col("__st") == 2) & F.coalesce(in_time, F.lit(False)))
    good = F.last(F.when(F.col("__ok2"), F.col("ord")), ignorenulls=True).over(b)
    df = df.withColumn("__g2", good)
    progress = F.when(F.col("__ok2"), 1).when((F.col("__st") == 3) & in_time & (F.col("__g2") > F.col("__o1")), 2).otherwise(0)
    df = df.withColumns({"takeover_transition": step, "privileged_escalation": flag(followed), "takeover_sequence_score": clamp01(progress / 2.0)})
    return df.drop("__n", "__st", "__sec", "__s1", "__o1", "__s2", "__o2", "__ok2", "__g2")


def sessions(df: DataFrame) -> DataFrame:
    """session_position (0 for a first event, else 1) and session_size (events so far) of sessions broken by the gap."""
    df = gap_sessions(df, USER, SESSION_GAP, "__gs")
    n = F.row_number().over(Window.partitionBy(USER, "__gs").orderBy("ord"))
    return df.withColumn("session_size", n.cast("double")).withColumn("session_position", flag(F.col("session_size") > 1)).drop("__gs")


def _sum(weights: dict[str, float]) -> Column:
    return clamp01(reduce(lambda a, x: a + F.col(x[0]) * x[1], weights.items(), F.lit(0.0)))


def scores(df: DataFrame) -> DataFrame:
    """sequence, relationship, campaign, takeover support, takeover and fusion scores by fixed weights."""
    m = float(MOST_SHARED)
    most = F.greatest("shared_ip_users", "shared_device_users", "shared_asn_users", "shared_infra_pair_users", "infra_burst_peer_count")
    df = df.withColumns(
        {
            "fanout_score": clamp01(most / m),
            "__rhythm": clamp01(F.col("interval_deviation") / 6.0),
            "__network": F.greatest("ip_novelty", "country_novelty", "asn_novelty"),
            "__novel": F.greatest("ip_novelty", "device_novelty", "country_novelty", "asn_novelty"),
            "__sync": clamp01(F.col("sync_peer_count") / m),
            "__peers": clamp01(F.col("infra_burst_peer_count") / m),
            "__volume": clamp01(F.col("infra_burst_event_count") / (2 * m)),
            **{f"__{n}": clamp01((F.col(f"shared_{n}_users") - 1.0) / m) for n in ("ip", "device", "asn", "infra_pair")},
        }
    )
    sequence = {"burst_score": 0.20, "__rhythm": 0.20, "geo_velocity_flag": 0.15, "geo_velocity_score": 0.20, "__network": 0.10, "device_novelty": 0.10, "session_novelty": 0.10, "session_context_shift": 0.15, "session_concurrency": 0.20, "session_replay_burst": 0.10, "takeover_transition": 0.20, "privileged_escalation": 0.15, "takeover_sequence_score": 0.20}
    relationship = {"__ip": 0.25, "__device": 0.25, "__asn": 0.10, "__infra_pair": 0.15, "__sync": 0.12, "__peers": 0.08, "__volume": 0.05, "fanout_score": 0.10, "password_spray_score": 0.12, "low_and_slow_score": 0.10}
    campaign = {"password_spray_score": 0.45, "low_and_slow_score": 0.35, "__sync": 0.10, "__volume": 0.05, "fanout_score": 0.10}
    df = df.withColumns({"sequence_score": _sum(sequence), "relationship_score": _sum(relationship), "campaign_score": _sum(campaign)})
    support = F.greatest("session_context_shift", "session_concurrency", "session_replay_burst", "session_fingerprint_drift", "takeover_sequence_score", "takeover_transition", "privileged_escalation")
    weights = {"takeover_sequence_score": 0.30, "takeover_transition": 0.35, "session_context_shift": 0.25, "session_concurrency": 0.25, "session_replay_burst": 0.15, "session_fingerprint_drift": 0.15, "geo_velocity_score": 0.15, "high_risk_country": 0.10, "privileged_escalation": 0.20, "mfa_bypass_suspicion": 0.20, "campaign_score": 0.10, "session_novelty": 0.10, "__novel": 0.10}
    df = df.withColumns({"takeover_support": support, "takeover_score": _sum(weights)})
    df = df.withColumn("fusion_score", clamp01((F.col("sequence_score") + F.col("relationship_score")) / 2.0))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def reasons() -> Column:
    """What an analyst reads: one sentence for each signal over its threshold, in a fixed order."""
    c = F.col
    user = lambda a, z="": F.concat(F.lit(a), c(USER), F.lit(z))
    count = lambda a, x, z: F.concat(F.lit(a), c(x).cast("int").cast("string"), F.lit(z))
    said = [
        (c("burst_score") >= 0.7, user("Very fast events of ", ".")),
        (c("interval_deviation") >= 3.0, user("Event timing is far from the rhythm of ", ".")),
        (c("geo_velocity_flag") > 0, F.lit("The country changed within minutes.")),
        (c("geo_velocity_score") >= 0.5, F.lit("No traveller moves that fast.")),
        (c("high_risk_country") > 0, F.lit("The country is on the list of high risk.")),
        ((c("ip_novelty") > 0) | (c("country_novelty") > 0) | (c("asn_novelty") > 0), user("The network is new for ", ".")),
        (c("device_novelty") > 0, user("The device is new for ", ".")),
        (c("session_novelty") > 0, F.lit("A session is used that never began.")),
        (c("session_context_shift") >= 0.6, F.lit("A session changed several parts of its context.")),
        (c("session_concurrency") >= 0.5, F.lit("A session is used from two contexts at once.")),
        (c("session_replay_burst") >= 0.5, F.lit("A session repeats requests within seconds.")),
        (c("session_fingerprint_drift") >= 0.5, F.lit("A session's client changed.")),
        (c("takeover_transition") >= 0.6, F.lit("The context changed as a session went on.")),
        (c("privileged_escalation") > 0, F.lit("A privileged action followed a change of context.")),
        (c("takeover_sequence_score") >= 0.5, F.lit("Login, refresh and privileged action came in order.")),
        (c("mfa_bypass_suspicion") > 0, F.lit("A success without a second factor followed failures with one.")),
        (c("password_spray_score") >= 0.5, F.lit("Failures of many users come from one address.")),
        (c("low_and_slow_score") >= 0.5, F.lit("Failures from one address are spread over hours.")),
        (c("campaign_score") >= 0.5, F.lit("Neighbouring events look like one campaign.")),
        (c("shared_ip_users") > 2, count("The address has had ", "shared_ip_users", " users.")),
        (c("shared_device_users") > 1, count("The device has had ", "shared_device_users", " users.")),
        (c("shared_infra_pair_users") >= 1, F.lit("Another user has had this address and network.")),
        (c("infra_burst_peer_count") >= 1, F.lit("Other users were just now on this address and network.")),
        (c("infra_burst_event_count") >= 3, F.lit("This address and network are busy.")),
        (c("sync_peer_count") > 0, count("Just now active too: ", "sync_peer_count", " other users.")),
    ]
    return F.filter(F.array(*[F.when(a, b) for a, b in said]), lambda x: x.isNotNull())


SIGNALS = ("shared_ip_users", "shared_device_users", "shared_asn_users", "shared_infra_pair_users", "infra_burst_peer_count", "infra_burst_event_count", "sync_peer_count", "fanout_score", "ip_novelty", "device_novelty", "country_novelty", "asn_novelty", "session_novelty", "mfa_bypass_suspicion", "session_context_shift", "session_concurrency", "session_replay_burst", "session_fingerprint_drift", "password_spray_score", "low_and_slow_score", "interval_deviation", "burst_score", "geo_velocity_flag", "geo_velocity_score", "high_risk_country", "takeover_transition", "privileged_escalation", "takeover_sequence_score", "session_position", "session_size", "sequence_score", "relationship_score", "campaign_score", "takeover_support", "takeover_score", "fusion_score")


def signals(events: DataFrame) -> DataFrame:
    """``events`` with all identity signals.

    First what a user's own events say, in one partitioning by user; then
    narrow tables of what needs others, joined by event.
    """
    df = with_order(events, USER)
    for f in (gaps, geography, novelty, session_context, sessions, takeover):
        df = f(df)
    narrow = events.select("event_index", "timestamp", USER, "event_type", "ip_address", "device_fingerprint", "asn", "user_agent", "session_id", "mfa_used")
    own = gaps(with_order(narrow, USER))
    df = attach_all(df, [(gap_statistics(own), {}), (factor_failures(narrow), {}), (session_use(narrow), _NO_SESSION), (failure_history(narrow), _NO_FAILURE), (entity_history(narrow), {}), (entity_neighbours(narrow), {})])
    drift = F.greatest(F.col("__agent"), F.when(F.col("__apart") > 0, 1.0).otherwise(0.0), F.col("takeover_transition"))
    df = df.withColumns({"interval_deviation": _deviation(), "mfa_bypass_suspicion": _suspicion(), "session_fingerprint_drift": drift})
    return scores(df.drop("middle", "spread"))


def build(events: DataFrame) -> DataFrame:
    """event_index, user_id, the signals rounded to six places, and their reasons."""
    df = signals(events)
    return df.select("event_index", USER, *[F.round(c, 6).alias(c) for c in SIGNALS], reasons().alias("reasons"))


def signal_map(prefix: str = "identity_") -> Column:
    """All signals of a row as a map from their prefixed names, for results that carry them along."""
    return F.map_from_arrays(F.array(*[F.lit(prefix + c) for c in SIGNALS]), F.array(*[F.round(c, 6) for c in SIGNALS]))
