"""Seeded synthetic attacks: rows made from a base row of a target and appended to the events.

All choices come from hashes of the seed, so a seed gives the same attack
whatever the order or partitioning of the events. Injected rows carry
``synthetic`` and ``injection_type`` and get event_index values from 1e12 up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_INDEX = 1_000_000_000_000
#: Address blocks that injected attackers come from.
BLOCKS = ("185.220.101", "91.240.118", "45.155.205", "193.32.162")


class Dice:
    """Hash-drawn values for row number ``i`` of an injection."""

    def __init__(self, seed: int):
        self.seed = seed

    def number(self, name: str, low: int, high: int, i: Column | None = None) -> Column:
        parts = [F.lit(self.seed), F.lit(name)] + ([i] if i is not None else [])
        return F.lit(low) + F.pmod(F.xxhash64(*parts), F.lit(high - low + 1))

    def choice(self, name: str, values: tuple[str, ...], i: Column | None = None) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.number(name, 0, len(values) - 1, i) + 1).cast("int"))

    def address(self, name: str, i: Column | None = None) -> Column:
        return F.concat(self.choice(f"{name}-block", BLOCKS, i), F.lit("."), self.number(name, 1, 254, i).cast("string"))

    def network(self, name: str, i: Column | None = None) -> Column:
        return F.concat(F.lit("ASN-"), self.number(name, 64000, 64511, i).cast("string"))


def target_user(events: DataFrame, seed: int, among: list[str] | None = None) -> str | None:
    users = events.where(F.col("user_id").isin(*among)) if among else events
    picked = users.agg(F.min_by("user_id", F.xxhash64(F.lit(seed), "user_id"))).first()[0]
    return picked if picked is not None or not among else target_user(events, seed)


def _shift(seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros("timestamp") + (seconds * 1_000_000).cast("long"))


def _base(rows: DataFrame, seed: int) -> DataFrame:
    """One row of ``rows``, chosen by a hash of its index."""
    names = rows.columns
    one = rows.agg(F.min_by(F.struct(*names), F.xxhash64(F.lit(seed), "event_index")).alias("r")).where("r IS NOT NULL")
    return one.select("r.*")


def _copies(base: DataFrame, n: int) -> DataFrame:
    return base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.lit(n > 0))


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by time, numbered: the attack is of that size by definition."""
    first = rows.orderBy("timestamp", "event_index").limit(n)
    packed = first.agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_index", *[c for c in rows.columns if c not in ("timestamp", "event_index", "raw_fields")]))).alias("r"))
    return packed.select(F.posexplode("r").alias("i", "r")).select("i", "r.*").withColumn("raw_fields", F.create_map().cast("map<string,string>"))


def volume_spike(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    n = int(min(window, own.limit(window).count()) * max(1.0, m))
    rows = _numbered(own, window).withColumnRenamed("i", "j")
    total = F.greatest(F.lit(1), F.lit(rows.count()))
    draws = own.sparkSession.range(n).select(F.col("id").alias("i")).withColumn("j2", F.pmod(F.xxhash64(F.lit(d.seed), F.lit("draw"), "i"), total))
    return draws.join(F.broadcast(rows), F.col("j") == F.col("j2")).drop("j", "j2")  # the sample has ``window`` rows at most


def temporal_shift(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    rows = _numbered(own, window)
    day = F.date_trunc("day", "timestamp")
    inside = F.pmod(F.unix_micros("timestamp"), F.lit(60_000_000))
    at = F.unix_micros(day) + (int(m) % 24) * 3_600_000_000 + d.number("minute", 0, 59, F.col("i")) * 60_000_000 + inside
    return rows.withColumn("timestamp", F.timestamp_micros(at))


def credential_stuffing(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    rows = _copies(_base(own, d.seed), max(window, int(m * 10)))
    return rows.withColumns({"ip_address": d.address("ip", F.col("i")), "event_type": F.lit("failed_login"), "success": F.lit(False)})


def asn_shift(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    rows = _numbered(own, window)
    changed = F.col("i") < max(1, int(rows.count() * min(1.0, m / 2.0)))
    return rows.withColumns({"ip_address": F.when(changed, d.address("ip", F.col("i"))).otherwise(F.col("ip_address")), "asn": F.when(changed, d.network("asn", F.col("i"))).otherwise(F.col("asn"))})


def burst_attack(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    n = max(10, int(window * m))
    return _copies(_base(own, d.seed), n).withColumns({"ip_address": d.address("ip"), "timestamp": _shift(F.col("i") / max(n - 1, 1) * 60.0)})


def session_hijack(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    base = _base(own, d.seed).withColumn("session_id", F.concat(F.lit("hijack-"), "user_id"))
    victim = _copies(base, max(3, int(m) + 1)).withColumns({"auth_method": F.lit("token_refresh"), "event_type": F.lit("session_refresh"), "mfa_used": F.lit(True), "timestamp": _shift(60 + F.col("i") * 4)})
    thief = base.withColumns({"ip_address": d.address("ip"), "user_agent": d.choice("agent", ("python-requests/2.31", "curl/8.7.1", "HeadlessChrome/122.0")), "device_fingerprint": F.concat(F.lit("hijacked-"), d.number("device", 1000, 9999).cast("string")), "country_code": d.choice("country", ("RU", "NL", "SG")), "asn": d.network("asn"), "mfa_used": F.lit(False)})
    first = F.col("i") == 0
    refresh = _copies(thief, max(6, int(8 * m))).withColumns({"auth_method": F.when(first, "password").otherwise("token_refresh"), "event_type": F.when(first, "login").otherwise("session_refresh"), "timestamp": _shift(62 + F.col("i") * 3)})
    replay = _copies(thief, max(8, int(10 * m))).withColumns({"auth_method": F.lit("token_refresh"), "event_type": F.lit("session_refresh"), "timestamp": _shift(120 + F.col("i") % 5)})
    used = _copies(thief, max(2, int(m) + 1)).withColumns({"auth_method": F.lit("api_key"), "event_type": F.lit("privileged_action"), "timestamp": _shift(240 + F.col("i") * 60)})
    out = None
    for k, part in enumerate((victim, refresh, replay, used)):
        part = part.withColumn("i", F.col("i") + k * 1_000_000)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("success", F.lit(True))


def mfa_bypass(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    n = max(2, int(m))
    base = _base(own, d.seed).withColumns({"ip_address": d.address("ip"), "device_fingerprint": F.concat(F.lit("mfa-bypass-"), d.number("device", 100, 999).cast("string"))})
    last = F.col("i") == n
    return _copies(base, n + 1).withColumns(
        {
            "event_type": F.when(last, "login").otherwise("mfa_failure"),
            "success": last,
            "mfa_used": ~last,
            "auth_method": F.when(last, "password").otherwise("mfa"),
            "failure_reason": F.when(~last, "otp_invalid"),
            "country_code": F.when(last, d.choice("country", ("NL", "RU", "SG"))).otherwise(F.col("country_code")),
            "asn": F.when(last, d.network("asn")).otherwise(F.col("asn")),
            "timestamp": _shift((F.col("i") * 2 + last.cast("int")) * 60),
        }
    )


def low_and_slow(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    i = F.col("i")
    return _copies(_base(own, d.seed), max(6, int(8 * m))).withColumns(
        {
            "timestamp": _shift((i * 6 + d.number("hour", 0, 2, i)) * 3600),
            "country_code": d.choice("country", ("NL", "DE", "US", "GB"), i),
            "ip_address": d.address("ip", i % 2),
            "device_fingerprint": F.concat(F.lit("slow-drift-"), (i % 2).cast("string")),
            "asn": F.concat(F.lit("ASN-"), (64490 + i % 3).cast("string")),
            "auth_method": F.lit("password"),
            "success": F.lit(True),
        }
    )


def _users(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` users by name, numbered."""
    return events.select("user_id").distinct().orderBy("user_id").limit(n).agg(F.array_sort(F.collect_list("user_id")).alias("u")).select(F.posexplode("u").alias("i", "who"))


def password_spraying(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    base = _base(events, d.seed)
    rows = base.crossJoin(F.broadcast(_users(events, max(3, int(4 * m) + 2))))  # one row by a few users
    return rows.withColumns({"user_id": F.col("who"), "ip_address": d.address("ip"), "device_fingerprint": F.lit("spray-device"), "country_code": F.lit("RU"), "event_type": F.lit("failed_login"), "success": F.lit(False), "asn": F.lit("ASN-64496"), "mfa_used": F.lit(False), "timestamp": _shift(F.col("i") * 45)}).drop("who")


def coordinated_campaign(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    users = _users(events, max(3, int(5 * m))).withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = _base(events, d.seed).crossJoin(F.broadcast(users)).withColumn("k", F.col("i") * 2 + F.col("phase"))  # one row by a few users
    late = F.col("phase") == 1
    return rows.withColumns(
        {"user_id": F.col("who"), "ip_address": d.address("ip", F.col("phase")), "device_fingerprint": F.concat(F.lit("campaign-device-"), d.number("device", 10, 99).cast("string")), "country_code": F.lit("NL"), "asn": F.lit("ASN-64496"), "auth_method": F.lit("password"), "event_type": F.when(late, "login").otherwise("failed_login"), "success": late, "timestamp": _shift(F.col("i") * 60 + F.col("phase") * 35 + d.number("second", 0, 8, F.col("k")))}
    ).drop("who", "phase", "i").withColumnRenamed("k", "i")


def identity_drift(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    i = F.col("i")
    cycle = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return _numbered(own, max(window, 5)).withColumns({"country_code": cycle(("US", "SG", "BR", "ZA", "JP")), "device_fingerprint": F.concat(F.lit("drift-"), (i % 5 + 1).cast("string")), "auth_method": F.when(i % 2 == 1, "api_key").otherwise("password"), "ip_address": d.address("ip", i), "asn": F.concat(F.lit("ASN-"), (64480 + i % 10).cast("string")), "success": F.lit(True)})


def temporal_jitter(own: DataFrame, events: DataFrame, m: float, window: int, d: Dice) -> DataFrame:
    i = F.col("i")
    seconds = d.number("jitter", 90, max(300, int(1800 * max(m, 1.0))), i) * F.when(i % 2 == 1, -1).otherwise(1)
    return _numbered(own, max(window, 8)).withColumns({"timestamp": _shift(seconds), "ip_address": d.address("ip", i), "device_fingerprint": F.concat(F.lit("jitter-device-"), (i % 3).cast("string"))})


TYPES: dict[str, Callable] = {
    f.__name__: f
    for f in (volume_spike, temporal_shift, credential_stuffing, asn_shift, burst_attack, session_hijack, mfa_bypass, low_and_slow, password_spraying, coordinated_campaign, identity_drift, temporal_jitter)
}


def inject(events: DataFrame, kind: str, magnitude: float = 2.0, window: int = 50, seed: int = 42, users: list[str] | None = None) -> DataFrame:
    """``events`` and the injected rows, marked by ``synthetic`` and ``injection_type``. No events, nothing injected."""
    if kind not in TYPES:
        raise ValueError(f"unknown injection {kind!r}; there are {sorted(TYPES)}")
    marked = events.withColumns({"synthetic": F.lit(False), "injection_type": F.lit(None).cast("string")})
    target = target_user(events, seed, users)
    if target is None:
        return marked
    own = events.where(F.col("user_id") == target)
    rows = TYPES[kind](own, events, magnitude, window, Dice(seed)).withColumns({"event_index": F.lit(FIRST_INDEX) + F.col("i"), "synthetic": F.lit(True), "injection_type": F.lit(kind)})
    return marked.unionByName(rows.select(*marked.columns))
