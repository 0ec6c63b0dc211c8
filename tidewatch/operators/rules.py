"""Attack-pattern rules over canonical events. Each rule is a function DataFrame -> DataFrame of matches.

A match has rule_id, severity, key (the user, address or session at fault),
first_event, n_events, users (sorted), matched_at and details (JSON).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.patterns import DAY, MINUTE, before, burst_sets, burst_starts, first_seen, greedy_bursts, last_before, micros, onward, ordered_buckets, window_bursts, with_order
from tidewatch.sources.schema import FAILURES

REGISTRY: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def rule(name: str, severity: str):
    """Register a rule under a name; registered rules run in ``evaluate``."""

    def put(f):
        REGISTRY[name] = (f, severity)
        return f

    return put


def is_failure() -> Column:
    return F.col("event_type").isin(*FAILURES)


def _match(df: DataFrame, name: str, severity: str, key: Column, n: Column, users: Column, first: Column | None = None, at: Column | None = None, also: tuple[str, ...] = (), **details: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("rule_id"),
        F.lit(severity).alias("severity"),
        key.cast("string").alias("key"),
        (first if first is not None else F.col("event_index")).alias("first_event"),
        n.cast("long").alias("n_events"),
        F.concat_ws(",", users).alias("users"),
        micros(at if at is not None else F.col("timestamp")).alias("matched_at"),
        F.to_json(F.struct(*[v.alias(k) for k, v in details.items()]) if details else F.struct(F.lit(1).alias("match"))).alias("details"),
        *also,
    )


def burst_candidates(events: DataFrame, keys: list[str], within: int, aggregates: dict[str, Callable], where: Column | None = None) -> DataFrame:
    """Anchors with forward-window aggregates; keys are non-null. Aggregates map a name to a function of the window."""
    rows = events.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    if where is not None:
        rows = rows.where(where)
    one = rows.withColumn("__key", F.concat_ws("\u0001", *keys)) if len(keys) > 1 else rows.withColumn("__key", F.col(keys[0]))
    placed = ordered_buckets(one, "__key", within)
    w = onward(["__key", "bucket"], within)
    return placed.select("*", *[f(w).alias(n) for n, f in aggregates.items()]).where("anchor").drop("bucket", "anchor")


def _users(w) -> Column:
    return F.sort_array(F.collect_set("user_id").over(w))


def _names() -> Column:
    return F.sort_array(F.collect_set("__who"))


def _count(condition: Column | None = None):
    return lambda w: F.count(F.lit(1) if condition is None else F.when(condition, 1)).over(w)


@rule("brute_force", "high")
def brute_force(events: DataFrame, max_failures: int = 5, window_minutes: int = 10) -> DataFrame:
    """So many failed logins of one user within the window; bursts don't overlap."""
    w = window_minutes * MINUTE
    found = burst_candidates(events, ["user_id"], w, {"n": _count()}, is_failure()).where(F.col("n") >= max_failures)
    return _match(greedy_bursts(found, ["__key"], w), "brute_force", "high", F.col("user_id"), F.col("n"), F.array("user_id"))


@rule("impossible_travel", "critical")
def impossible_travel(events: DataFrame, max_minutes: int = 60) -> DataFrame:
    """Neighbouring events of a user in two countries within the window, not at once."""
    rows = with_order(events.where("country_code IS NOT NULL"), "user_id")
    w = Window.partitionBy("user_id").orderBy("ord")
    step = micros() - F.lag(micros()).over(w)
    rows = rows.withColumn("step", step).withColumn("was", F.lag("country_code").over(w)).withColumn("from", F.lag("event_index").over(w))
    rows = rows.where((F.col("step") > 0) & (F.col("step") <= max_minutes * MINUTE) & (F.col("was") != F.col("country_code")))
    return _match(rows, "impossible_travel", "critical", F.col("user_id"), F.lit(2), F.array("user_id"), first=F.col("from"), countries=F.concat_ws(">", "was", "country_code"))


@rule("credential_stuffing", "critical")
def credential_stuffing(events: DataFrame, min_users: int = 3, min_attempts: int = 6, window_minutes: int = 15, max_success_rate: float = 0.2) -> DataFrame:
    """Many users and failures from one address within the window, few of them successful."""
    sums = {"failed": is_failure(), "won": F.col("success")}
    fits = lambda c: (c["users"] >= min_users) & (c["failed"] >= min_attempts) & (c["won"] / c["n"] <= max_success_rate)
    found = window_bursts(events, F.col("ip_address"), window_minutes * MINUTE, fits, {"n": F.count(F.lit(1)), "names": _names(), "failed": F.count_if("__s_failed")}, sums)
    return _match(found, "credential_stuffing", "critical", F.col("__key"), F.col("n"), F.col("names"), failed=F.col("failed"))


@rule("off_hours_login", "low")
def off_hours(events: DataFrame, start_hour: int = 6, end_hour: int = 22) -> DataFrame:
    rows = events.where((F.hour("timestamp") < start_hour) | (F.hour("timestamp") >= end_hour))
    return _match(rows, "off_hours_login", "low", F.col("user_id"), F.lit(1), F.array("user_id"), hour=F.hour("timestamp"))


@rule("dormant_account", "medium")
def dormant_account(events: DataFrame, dormant_days: int = 30) -> DataFrame:
    """An event after so many whole days without one."""
    rows = with_order(events, "user_id")
    w = Window.partitionBy("user_id").orderBy("ord")
    rows = rows.withColumn("days", F.floor((micros() - F.lag(micros()).over(w)) / DAY)).where(F.col("days") >= dormant_days)
    return _match(rows, "dormant_account", "medium", F.col("user_id"), F.lit(1), F.array("user_id"), days=F.col("days"))


@rule("new_device_new_location", "high")
def new_device_new_location(events: DataFrame) -> DataFrame:
    """A device and a country, both new to a user who has had some of each."""
    rows = with_order(events.withColumn("device", F.coalesce("device_fingerprint", "user_agent")), "user_id")
    rows = rows.withColumn("nd", first_seen("user_id", "device")).withColumn("nc", first_seen("user_id", "country_code"))
    b = before("user_id")
    rows = rows.withColumn("pd", F.coalesce(F.sum("nd").over(b), F.lit(0))).withColumn("pc", F.coalesce(F.sum("nc").over(b), F.lit(0)))
    rows = rows.where("nd = 1 AND nc = 1 AND pd > 0 AND pc > 0")
    return _match(rows, "new_device_new_location", "high", F.col("user_id"), F.lit(1), F.array("user_id"), device=F.col("device"), country=F.col("country_code"))


@rule("mfa_bypass", "critical")
def mfa_bypass(events: DataFrame, recent: int = 10, min_failures: int = 2) -> DataFrame:
    """A success without a second factor (unknown counts as none) when the last ten events hold second-factor failures."""
    rows = with_order(events, "user_id")
    w = Window.partitionBy("user_id").orderBy("ord").rowsBetween(1 - recent, -1)
    rows = rows.withColumn("failed", F.count(F.when(is_failure() & F.col("mfa_used"), 1)).over(w))
    rows = rows.where(F.coalesce("success", F.lit(False)) & F.coalesce(~F.col("mfa_used"), F.lit(True)) & (F.col("failed") >= min_failures))
    return _match(rows, "mfa_bypass", "critical", F.col("user_id"), F.lit(1), F.array("user_id"), failed=F.col("failed"))


@rule("session_hijack", "critical")
def session_hijack(events: DataFrame, min_context_changes: int = 1) -> DataFrame:
    """A session whose address or agent differs from its last known one, once such changes add up."""
    rows = with_order(events.where("session_id IS NOT NULL"), "session_id")
    changed = [F.coalesce((F.col(c) != last_before("session_id", c)).cast("int"), F.lit(0)) for c in ("ip_address", "user_agent")]
    rows = rows.withColumn("changes", changed[0] + changed[1])
    w = Window.partitionBy("session_id").orderBy("ord")
    rows = rows.withColumn("total", F.sum("changes").over(w)).withColumn("from", F.first("event_index").over(w))
    rows = rows.where((F.col("changes") > 0) & (F.col("total") >= min_context_changes))
    return _match(rows, "session_hijack", "critical", F.col("session_id"), F.lit(2), F.array("user_id"), first=F.col("from"), changes=F.col("total"))


@rule("password_spraying", "critical")
def password_spraying(events: DataFrame, min_users: int = 4, window_minutes: int = 45, max_attempts_per_user: int = 2, max_success_rate: float = 0.15) -> DataFrame:
    """Failures of many users from one address, few for each user and few successes among them."""
    w = window_minutes * MINUTE
    failed_users = lambda v: F.collect_list(F.when(is_failure(), F.col("user_id"))).over(v)
    found = burst_candidates(events, ["ip_address"], w, {"n": _count(), "won": _count(F.col("success")), "tries": failed_users})
    names = F.array_distinct("tries")
    most = F.array_max(run_lengths(F.sort_array("tries")))
    found = found.where((F.col("won") / F.col("n") <= max_success_rate) & (F.size(names) >= min_users) & (most <= max_attempts_per_user))
    return _match(greedy_bursts(found, ["__key"], w), "password_spraying", "critical", F.col("ip_address"), F.col("n"), F.sort_array(names), failed=F.size("tries"))


def run_lengths(sorted_values: Column) -> Column:
    """Lengths of the runs of equal values of a sorted array, each as seen from its first place; linear in the array."""
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["last"] == x, a["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    return F.array(F.aggregate(sorted_values, state, step)["most"])


@rule("low_and_slow_campaign", "high")
def low_and_slow(events: DataFrame, min_users: int = 3, min_failures: int = 5, window_minutes: int = 180, min_span_minutes: int = 30, short_burst_minutes: int = 15, short_burst_cap: int = 3) -> DataFrame:
    """Failures of several users from one address, spread over a long window without short bursts.

    The largest short burst among a window's failures is the largest forward
    count of its rows, each cut off at the window's end.
    """
    span, short = min_span_minutes * MINUTE, short_burst_minutes * MINUTE
    fits = lambda c: (c["n"] >= min_failures) & (c["users"] >= min_users) & (c["span"] >= span) & ~c["crowded"]
    counts = {"n": F.count(F.lit(1)), "names": _names(), "span": F.max("__t") - F.min("__t")}
    found = window_bursts(events.where(is_failure()), F.col("ip_address"), window_minutes * MINUTE, fits, counts, crowd=(short, short_burst_cap))
    return _match(found, "low_and_slow_campaign", "high", F.col("__key"), F.col("n"), F.col("names"), span_minutes=F.floor(F.col("span") / MINUTE))


@rule("shared_infrastructure_burst", "critical")
def shared_infrastructure(events: DataFrame, min_users: int = 3, window_minutes: int = 15, require_failures: bool = False) -> DataFrame:
    """Several users from one address and network within the window."""
    w = window_minutes * MINUTE
    found = burst_candidates(events, ["ip_address", "asn"], w, {"n": _count(), "names": _users}, is_failure() if require_failures else None)
    found = greedy_bursts(found.where(F.size("names") >= min_users), ["__key"], w)
    return _match(found, "shared_infrastructure_burst", "critical", F.concat_ws("/", "ip_address", "asn"), F.col("n"), F.col("names"))


def evaluate(events: DataFrame, names: list[str] | None = None, parameters: dict[str, dict] | None = None) -> DataFrame:
    """The matches of all registered rules, or of some, in one table."""
    out = None
    for name in names or list(REGISTRY):
        found = REGISTRY[name][0](events, **(parameters or {}).get(name, {}))
        out = found if out is None else out.unionByName(found)
    return out


def _shared_starts(events: DataFrame, min_users: int, window_minutes: int) -> tuple[DataFrame, DataFrame]:
    return burst_starts(events, F.col("ip_address"), window_minutes * MINUTE, lambda c: c["users"] >= min_users)


def _shared(placed: DataFrame, taken: DataFrame, window_minutes: int, also: tuple[str, ...] = ()) -> DataFrame:
    found = burst_sets(placed, taken, window_minutes * MINUTE, {"n": F.count(F.lit(1)), "names": _names()}, also=also)
    out = _match(found, "shared_ip", "medium", F.col("__key"), F.col("n"), F.col("names"), also=also)
    return out.withColumn("severity", F.when(F.size(F.split("users", ",")) >= 5, "high").otherwise("medium"))


def _timed_starts(events: DataFrame, min_users: int, window_minutes: int) -> tuple[DataFrame, DataFrame]:
    one = F.when(F.col("timestamp").isNotNull(), "all")  # a literal would leave the join and the buckets would be shuffled again
    return burst_starts(events, one, window_minutes * MINUTE, lambda c: c["users"] >= min_users, columns=("ip_address",))


def _timed(placed: DataFrame, taken: DataFrame, window_minutes: int, also: tuple[str, ...] = ()) -> DataFrame:
    counts = {"n": F.count(F.lit(1)), "names": _names(), "ips": F.size(F.collect_set("ip_address"))}
    found = burst_sets(placed, taken, window_minutes * MINUTE, counts, also=also)
    return _match(found, "timing_burst", "high", F.lit("all"), F.col("n"), F.col("names"), also=also, unique_ips=F.col("ips"))


def correlate_by_ip(events: DataFrame, min_users: int = 3, window_minutes: int = 30) -> DataFrame:
    """Clusters of users that share an address within the window."""
    return _shared(*_shared_starts(events, min_users, window_minutes), window_minutes)


def correlate_by_timing(events: DataFrame, min_users: int = 3, window_minutes: int = 5) -> DataFrame:
    """Clusters of events of several users within a short window, whatever else they share."""
    return _timed(*_timed_starts(events, min_users, window_minutes), window_minutes)


def correlate_by_failures(events: DataFrame, min_users: int = 3, min_failures: int = 3) -> DataFrame:
    """One cluster of all users with several failures, if there are enough of them: users, failures, first failure."""
    users = events.where(is_failure()).groupBy("user_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first")).where(F.col("n") >= min_failures)
    one = users.agg(F.count("*").alias("n_users"), F.sum("n").alias("n_events"), F.min("first").alias("first")).where(F.col("n_users") >= min_users)
    return one.select(F.lit("shared_failure_pattern").alias("correlation"), "n_users", "n_events", micros("first").alias("first_at"))


def correlate(events: DataFrame, min_users: int = 3, ip_minutes: int = 30, timing_minutes: int = 5, min_failures: int = 3) -> DataFrame:
    """Clusters of all three correlations: those of a match with ``cluster_id``, numbered from 1 by strategy, then time.

    Numbers run over the starts of clusters, which are narrow and few beside
    the events, in one window; rows and users are gathered afterwards.
    """
    shared, shared_at = _shared_starts(events, min_users, ip_minutes)
    timed, timed_at = _timed_starts(events, min_users, timing_minutes)
    failing = events.where(is_failure()).groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "event_index")).alias("first")).where(F.col("n") >= min_failures)
    one = failing.agg(F.sort_array(F.collect_list("user_id")).alias("names"), F.sum("n").alias("n_events"), F.min("first").alias("first")).where(F.size("names") >= min_users)
    failed_at = one.select(F.lit("all").alias("__k"), F.lit(0).cast("long").alias("__p"), micros("first.timestamp").alias("__from"), F.col("first.event_index").alias("__first"))
    starts = [x.withColumn("__strategy", F.lit(i)) for i, x in enumerate((shared_at, timed_at, failed_at))]
    numbered = Window.partitionBy().orderBy("__strategy", "__from", "__first", "__k")
    starts = starts[0].unionByName(starts[1]).unionByName(starts[2]).withColumn("cluster_id", F.row_number().over(numbered))
    shared_at, timed_at, failed_at = (starts.where(F.col("__strategy") == i).drop("__strategy") for i in range(3))
    also = ("cluster_id",)
    failed = one.join(failed_at, (micros("first.timestamp") == F.col("__from")) & (F.col("first.event_index") == F.col("__first")) & (F.col("__k") == "all") & (F.col("__p") == 0))
    failed = _match(failed, "shared_failure_pattern", "medium", F.lit("all"), F.col("n_events"), F.col("names"), first=F.col("first")["event_index"], at=F.col("first")["timestamp"], also=also)
    return _shared(shared, shared_at, ip_minutes, also).unionByName(_timed(timed, timed_at, timing_minutes, also)).unionByName(failed)
