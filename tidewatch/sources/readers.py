"""Readers of login logs (CSV, JSON, JSON Lines, parquet, host-event text) into the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.schema import ALIASES, EVENT, FALSE_WORDS, TIME_FORMATS, TRUE_WORDS


def resolve(columns: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical name to source column: exact alias matches first, then ones that differ in case."""
    found = dict(overrides or {})
    lowered = {}
    for c in columns:
        lowered.setdefault(c.lower(), c)
    for name, aliases in ALIASES.items():
        if name in found:
            continue
        hit = next((a for a in aliases if a in columns), None) or next((lowered[a] for a in aliases if a in lowered), None)
        if hit:
            found[name] = hit
    return found


def parse_timestamp(value: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e12, else the first of the known formats that fits, else any ISO form; null if none does."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > 1e12, number / 1000).otherwise(number)
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(F.timestamp_micros((seconds * 1000000).cast("long")), text.try_cast("timestamp"), *parsed)


def parse_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def canonical(df: DataFrame, overrides: dict[str, str] | None = None, index: str | None = None) -> DataFrame:
    """Any table of logins in the canonical schema; rows without a time or a user are dropped.

    ``index`` names a column that numbers the rows; without it rows are
    numbered in reading order. Columns that aren't canonical go to
    ``raw_fields``.
    """
    at = resolve(df.columns, overrides)

    def source(name: str) -> Column | None:
        return F.col(f"`{at[name]}`") if name in at else None

    def text(name: str) -> Column:
        c = source(name)
        return F.lit(None).cast("string") if c is None else F.nullif(c.cast("string"), F.lit(""))

    if "timestamp" not in at or "user_id" not in at:
        raise ValueError("the log has no column for the time or the user")
    kind = df.schema[at["timestamp"]].dataType
    when = source("timestamp").cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else parse_timestamp(source("timestamp"))
    used = set(ALIASES)
    extra = [c for c in df.columns if c not in used and c != index]
    raw = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda k, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    boolean = lambda n: F.lit(None).cast("boolean") if source(n) is None else parse_boolean(source(n))
    duration = F.lit(None).cast("double") if source("session_duration_seconds") is None else source("session_duration_seconds").cast("string").try_cast("double")
    out = df.select(
        (F.col(f"`{index}`").cast("long") if index else F.monotonically_increasing_id()).alias("event_index"),
        when.alias("timestamp"),
        text("user_id").alias("user_id"),
        F.lower(F.coalesce(text("event_type"), F.lit("login"))).alias("event_type"),
        text("ip_address").alias("ip_address"),
        text("asn").alias("asn"),
        F.upper(text("country_code")).alias("country_code"),
        *[text(c).alias(c) for c in ("user_agent", "device_fingerprint", "session_id")],
        duration.alias("session_duration_seconds"),
        text("auth_method").alias("auth_method"),
        boolean("mfa_used").alias("mfa_used"),
        boolean("success").alias("success"),
        text("failure_reason").alias("failure_reason"),
        raw.alias("raw_fields"),
    )
    return out.where("timestamp IS NOT NULL AND user_id IS NOT NULL").select([f.name for f in EVENT.fields])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of events, an object with ``events`` or ``logs``, or one event."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    for wrapper in ("events", "logs"):
        if wrapper in df.columns and isinstance(df.schema[wrapper].dataType, T.ArrayType):
            return df.select(F.inline(wrapper))
    return df


def read_host_events(spark: SparkSession, path: str, base_time: str = "2010-01-01 00:00:00", limit: int | None = None) -> DataFrame:
    """Nine-field host authentication text (offset seconds, users, computers, types, result); bad lines are skipped.

    ``limit`` counts input lines, not events.
    """
    lines = spark.read.text(path)
    if limit is not None:
        lines = lines.limit(limit)
    f = F.split("value", ",")
    offset = F.trim(F.get(f, F.lit(0))).try_cast("long")
    word = F.upper(F.trim(F.get(f, F.lit(8))))
    user = F.trim(F.get(f, F.lit(1)))
    ok = word.isin("SUCCESS", "SUCC", "TRUE", "1")
    names = ["source_user", "source_computer", "destination_computer", "logon_type", "auth_orientation", "success_token"]
    places = [2, 3, 4, 6, 7, 8]
    raw = F.create_map(*[x for n, p in zip(names, places, strict=True) for x in (F.lit(n), F.trim(F.get(f, F.lit(p))))])
    null = F.lit(None).cast("string")
    out = lines.where((F.size(f) >= 9) & offset.isNotNull() & (user != "")).select(
        F.monotonically_increasing_id().alias("event_index"),
        F.timestamp_micros(F.unix_micros(F.lit(base_time).cast("timestamp")) + (offset * 1000000).cast("long")).alias("timestamp"),
        F.substring_index(user, "@", 1).alias("user_id"),
        F.when(ok, "login").otherwise("failed_login").alias("event_type"),
        null.alias("ip_address"),
        null.alias("asn"),
        null.alias("country_code"),
        null.alias("user_agent"),
        F.nullif(F.trim(F.get(f, F.lit(3))), F.lit("")).alias("device_fingerprint"),
        null.alias("session_id"),
        F.lit(None).cast("double").alias("session_duration_seconds"),
        F.nullif(F.trim(F.get(f, F.lit(5))), F.lit("")).alias("auth_method"),
        F.lit(None).cast("boolean").alias("mfa_used"),
        ok.alias("success"),
        null.alias("failure_reason"),
        raw.alias("raw_fields"),
    )
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_events(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Dispatch on the suffix: .csv, ``*auth*.txt``, .json, .jsonl or .ndjson, .parquet; anything else is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".csv"):
        return canonical(spark.read.csv(path, header=True), overrides)
    if name.endswith(".txt") and "auth" in name:
        return read_host_events(spark, path)
    if name.endswith(".json"):
        return canonical(read_json(spark, path), overrides)
    if name.endswith((".jsonl", ".ndjson")):
        return canonical(spark.read.option("primitivesAsString", True).json(path), overrides)
    if name.endswith(".parquet"):
        return canonical(spark.read.parquet(path), overrides)
    raise ValueError(f"unknown kind of log: {path}")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """(kind, indicator) of a threat list: one a line, # starts a comment; AS numbers, two-letter countries, addresses."""
    line = F.trim(F.substring_index("value", "#", 1))
    kind = F.when(F.upper(line).rlike("^AS[0-9]+$"), "asn").when(line.rlike("^[A-Za-z]{2}$"), "country").when(line.rlike("[.:]"), "ip")
    value = F.when(kind == "ip", line).otherwise(F.upper(line))
    return spark.read.text(path).select(kind.alias("kind"), value.alias("indicator")).where("kind IS NOT NULL").distinct()


def stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as canonical events: types, places and devices are derived from its columns.

    Its times have no zone and are read as UTC, which this sets for the session.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return adapt(spark.read.parquet(f"{sf_dir}/events.parquet"))


def adapt(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kinds = {"error": "failed_login", "signup": "mfa_failure", "click": "login", "view": "session_refresh"}
    kind = F.lit("privileged_action")
    for was, now in kinds.items():
        kind = F.when(F.col("event_type") == was, now).otherwise(kind)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("event_index"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        user.alias("user_id"),
        kind.alias("event_type"),
        F.concat(F.lit("10.0.0."), (k % 4).cast("string")).alias("ip_address"),
        F.concat(F.lit("AS"), (k % 3 + 64500).cast("string")).alias("asn"),
        F.element_at(F.array(*[F.lit(c) for c in ("US", "NG", "RU", "DE", "JP")]), k % 5 + 1).alias("country_code"),
        F.concat(F.lit("ua-"), (k % 4).cast("string")).alias("user_agent"),
        F.concat(F.lit("dev-"), (k % 7).cast("string")).alias("device_fingerprint"),
        F.concat(F.lit("s-"), user, F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.col("value").alias("session_duration_seconds"),
        F.lit(None).cast("string").alias("auth_method"),
        (k % 2 == 0).alias("mfa_used"),
        (~F.col("event_type").isin("error", "signup")).alias("success"),
        F.lit(None).cast("string").alias("failure_reason"),
        F.create_map().cast("map<string,string>").alias("raw_fields"),
    )
