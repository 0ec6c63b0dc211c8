"""Causal features of an event from strictly earlier events of its user. Each function adds its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import cyclic, flag, median
from tidewatch.operators.patterns import DAY, HOUR, attach, before, micros, prior_distinct, sliding, with_order
from tidewatch.operators.rules import is_failure

USER = "user_id"
#: Seconds that stand for "never before", and the most events that a velocity counts.
NEVER, MOST = 86400.0, 1000


def ordered(events: DataFrame) -> DataFrame:
    """Events with the order key of their user and ``seen``: how many came before."""
    w = Window.partitionBy(USER).orderBy("ord")
    return with_order(events, USER).withColumn("seen", F.row_number().over(w) - 1)


def _last(n: int):
    return Window.partitionBy(USER).orderBy("ord").rowsBetween(-n, -1)


def temporal(df: DataFrame) -> DataFrame:
    """hour_sin, hour_cos, day_of_week, is_weekend; whether the hour (to 2 h) and the weekday occur among the last 20."""
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    sin, cos = cyclic(hour.cast("double"), 24)
    near = F.exists(F.collect_list(hour).over(_last(20)), lambda h: (F.abs(h - hour) <= 2) | (F.abs(h - hour) >= 22))
    known = F.array_contains(F.collect_list(day).over(_last(20)), day)
    df = df.withColumns({"__near": near, "__known": known})
    return df.withColumns(
        {
            "hour_sin": sin,
            "hour_cos": cos,
            "day_of_week": day.cast("double"),
            "is_weekend": flag(day >= 5),
            "is_typical_hour": flag((F.col("seen") == 0) | F.col("__near")),
            "is_typical_day": flag((F.col("seen") == 0) | F.col("__known")),
        }
    ).drop("__near", "__known")


def velocity(df: DataFrame) -> DataFrame:
    """Earlier events of the last hour and day, seconds since the last, and their mean step over the last day."""
    recent = sliding(df, F.col(USER), {"h": HOUR, "d": DAY}, first=("d",)).select("event_index", F.col("h").alias("__h"), F.col("d").alias("__d"), F.col("d_first").alias("__lo"))
    last = F.lag(micros()).over(Window.partitionBy(USER).orderBy("ord"))
    df = df.withColumn("__hi", last).withColumn("__s", (micros() - F.col("__hi")) / 1e6)
    df = attach(df, recent, __h=0, __d=0)
    step = F.when(F.col("__d") >= 2, (F.col("__hi") - F.col("__lo")) / 1e6 / (F.col("__d") - 1)).otherwise(NEVER)
    return df.withColumns(
        {
            "events_last_hour": F.least("__h", F.lit(MOST)).cast("double"),
            "events_last_day": F.least("__d", F.lit(MOST)).cast("double"),
            "time_since_last_event": F.when(F.col("__s") > 0, F.least("__s", F.lit(NEVER))).otherwise(NEVER),
            "avg_inter_event_time": F.least(step, F.lit(NEVER)),
        }
    ).drop("__h", "__d", "__s", "__lo", "__hi")


def _novel(df: DataFrame, value: str, name: str, unique: str) -> DataFrame:
    """``name``: 1 if the value is known, missing, or the user's first; ``unique``: different values so far, 1 at least."""
    df = prior_distinct(df, USER, value, "__n")
    known = flag((F.col("__n_new") == 0) | (F.col("seen") == 0))
    return df.withColumns({name: known, unique: F.greatest("__n", F.lit(1)).cast("double")}).drop("__n", "__n_new")


def geographic(df: DataFrame, threats: DataFrame | None = None) -> DataFrame:
    """Known address, country, network; different ones so far; how often the address changes; listed ones."""
    df = _novel(df, "ip_address", "is_known_ip", "unique_ips_24h")
    df = _novel(df, "country_code", "is_known_country", "unique_countries_24h")
    df = _novel(df, "asn", "is_known_asn", "unique_asns_24h")
    df = df.withColumn("ip_change_frequency", F.when(F.col("seen") == 0, 0.0).otherwise(F.col("unique_ips_24h") / F.greatest("seen", F.lit(1))))
    return listed(df, threats)


def listed(df: DataFrame, threats: DataFrame | None) -> DataFrame:
    """is_threat_ip, is_threat_asn, is_threat_country: 1 if (kind, indicator) lists it and it isn't the user's first event."""
    kinds = (("ip", "ip_address"), ("asn", "asn"), ("country", "country_code"))
    if threats is None:
        return df.withColumns({f"is_threat_{kind}": F.lit(0.0) for kind, _ in kinds})
    for kind, column in kinds:
        some = threats.where(F.col("kind") == kind).select(F.col("indicator").alias("__i")).distinct()
        df = df.join(some, F.col(column) == F.col("__i"), "left").withColumn(f"is_threat_{kind}", flag(F.col("__i").isNotNull() & (F.col("seen") > 0))).drop("__i")
    return df


def device(df: DataFrame) -> DataFrame:
    df = _novel(df, "device_fingerprint", "is_known_device", "unique_devices_24h")
    return _novel(df, "user_agent", "is_known_user_agent", "unique_user_agents_24h")


def session(df: DataFrame) -> DataFrame:
    """A duration against the last 100 known ones, of which there must be three: its z-score and its ratio to their median."""
    # rows with a duration are apart from those without, which need no frame
    own = Window.partitionBy(USER, F.col("session_duration_seconds").isNull()).orderBy("ord").rowsBetween(-100, -1)
    df = df.withColumn("__last", F.collect_list("session_duration_seconds").over(own))
    n, x = F.size("__last"), F.col("session_duration_seconds")
    mean = F.aggregate("__last", F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
    df = df.withColumns({"__mean": mean, "__mid": median(F.array_sort("__last"))})
    std = F.sqrt(F.aggregate("__last", F.lit(0.0), lambda a, v: a + (v - F.col("__mean")) * (v - F.col("__mean"))) / F.greatest(n, F.lit(1)))
    known = (F.col("seen") > 0) & x.isNotNull() & (n >= 3) & (F.col("__mid") != 0)
    df = df.withColumn("__std", std)
    z = F.when(known & (F.col("__std") > 0), (x - F.col("__mean")) / F.nullif(F.col("__std"), F.lit(0.0))).otherwise(0.0)
    ratio = F.when(known, x / F.greatest("__mid", F.lit(1.0))).otherwise(1.0)
    return df.withColumns({"session_duration_zscore": z, "session_duration_ratio": ratio}).drop("__last", "__mean", "__mid", "__std")


def auth(df: DataFrame) -> DataFrame:
    """Failure, five times the rate of earlier failures, success after many failures, a method new to a user who has had some."""
    rate = F.avg(is_failure().cast("double")).over(before(USER))
    df = prior_distinct(df, USER, "auth_method", "__m").withColumn("__rate", F.coalesce(rate, F.lit(0.0)))
    return df.withColumns(
        {
            "is_failure": flag(is_failure()),
            "failure_streak": F.col("__rate") * 5,
            "failed_then_success": flag(F.col("success") & (F.col("__rate") > 0.3)),
            "is_unusual_auth_method": flag((F.col("__m_new") == 1) & (F.col("__m") > 0)),
        }
    ).drop("__m", "__m_new", "__rate")


def entropy(df: DataFrame) -> DataFrame:
    """Entropy of the sets of earlier addresses, devices (agents if there are none) and countries: all members weigh the same."""
    for value, name in (("ip_address", "__i"), ("device_fingerprint", "__d"), ("user_agent", "__u"), ("country_code", "__c")):
        df = prior_distinct(df, USER, value, name).drop(f"{name}_new")
    bits = lambda c: F.log2(F.greatest(c, F.lit(1)).cast("double"))
    devices = F.when(F.col("__d") > 0, F.col("__d")).otherwise(F.col("__u"))
    return df.withColumns({"ip_entropy": bits(F.col("__i")), "device_entropy": bits(devices), "country_entropy": bits(F.col("__c"))}).drop("__i", "__d", "__u", "__c")


def peer(df: DataFrame, hour_mean: float = 12.0, hour_std: float = 6.0, events_mean: float = 5.0, events_std: float = 3.0) -> DataFrame:
    hour = F.abs(F.hour("timestamp") - hour_mean) / max(hour_std, 1e-9)
    pace = F.when(F.col("seen") == 0, 0.0).otherwise(F.abs(F.col("seen") - events_mean) / max(events_std, 1e-9))
    return df.withColumns({"peer_hour_deviation": hour, "peer_velocity_deviation": pace})


def travel(df: DataFrame) -> DataFrame:
    """1 if the country is new to a user with two events or more, one of them less than an hour ago."""
    since = micros() - F.lag(micros()).over(Window.partitionBy(USER).orderBy("ord"))
    df = prior_distinct(df, USER, "country_code", "__c").withColumn("__s", since)
    soon = (F.col("__s") > 0) & (F.col("__s") < HOUR)
    return df.withColumn("impossible_travel_flag", flag((F.col("seen") >= 2) & (F.col("__c_new") == 1) & (F.col("__c") > 0) & soon)).drop("__c", "__c_new", "__s")


GROUPS = {"temporal": temporal, "velocity": velocity, "geographic": geographic, "device": device, "session": session, "auth": auth, "entropy": entropy, "peer": peer, "travel": travel}
NAMES = {
    "temporal": ("hour_sin", "hour_cos", "day_of_week", "is_weekend", "is_typical_hour", "is_typical_day"),
    "velocity": ("events_last_hour", "events_last_day", "time_since_last_event", "avg_inter_event_time"),
    "geographic": ("is_known_ip", "is_known_country", "is_known_asn", "unique_ips_24h", "unique_countries_24h", "unique_asns_24h", "ip_change_frequency", "is_threat_ip", "is_threat_asn"),
    "device": ("is_known_device", "is_known_user_agent", "unique_devices_24h", "unique_user_agents_24h"),
    "session": ("session_duration_zscore", "session_duration_ratio"),
    "auth": ("is_failure", "failure_streak", "failed_then_success", "is_unusual_auth_method"),
    "entropy": ("ip_entropy", "device_entropy", "country_entropy"),
    "peer": ("peer_hour_deviation", "peer_velocity_deviation"),
    "travel": ("impossible_travel_flag",),
}


def build(events: DataFrame, groups: list[str] | None = None, threats: DataFrame | None = None) -> DataFrame:
    """event_index, user_id and the features of the given groups; all windows share one partitioning by user."""
    df = ordered(events)
    chosen = groups or list(GROUPS)
    for g in chosen:
        df = GROUPS[g](df, threats) if g == "geographic" else GROUPS[g](df)
    return df.select("event_index", USER, *[F.col(n) for g in chosen for n in NAMES[g]])


def profiles(events: DataFrame) -> DataFrame:
    """One row per user: counts, first and last time, known sets, median duration, failure rate."""
    return events.groupBy(USER).agg(
        F.count("*").alias("n_events"),
        F.count(F.when(is_failure(), 1)).alias("n_failures"),
        micros(F.min("timestamp")).alias("first_seen"),
        micros(F.max("timestamp")).alias("last_seen"),
        *[F.concat_ws(",", F.sort_array(F.collect_set(c))).alias(f"known_{n}") for c, n in (("ip_address", "ips"), ("country_code", "countries"), ("asn", "asns"), ("device_fingerprint", "devices"))],
        F.percentile("session_duration_seconds", 0.5).alias("median_duration"),
        F.avg(is_failure().cast("double")).alias("failure_rate"),
    )


def peer_statistics(events: DataFrame) -> DataFrame:
    """Mean and spread (1 at least) of hours over events and of events over users."""
    users = events.groupBy(USER).agg(F.count("*").alias("n"), F.sum(F.hour("timestamp")).alias("h"), F.sum(F.hour("timestamp") * F.hour("timestamp")).alias("h2"))
    one = users.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("h2").alias("h2"), F.avg("n").alias("events_mean"), F.greatest(F.stddev_pop("n"), F.lit(1.0)).alias("events_std"))
    mean = F.col("h") / F.col("n")
    return one.select(mean.alias("hour_mean"), F.greatest(F.sqrt(F.col("h2") / F.col("n") - mean * mean), F.lit(1.0)).alias("hour_std"), "events_mean", "events_std")
