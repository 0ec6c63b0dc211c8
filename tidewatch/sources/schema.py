"""The canonical authentication event and the names that other logs give its columns."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names by which logs call the canonical columns, the preferred first.
ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date", "ts", "@timestamp"),
    "user_id": ("user_id", "user", "username", "user_name", "email", "userid", "subject"),
    "event_type": ("event_type", "event", "action", "activity", "eventname", "eventName"),
    "ip_address": ("ip_address", "ip", "source_ip", "src_ip", "remote_addr", "client_ip"),
    "asn": ("asn", "as_number", "autonomous_system", "as_org"),
    "country_code": ("country_code", "country", "geo_country", "cc"),
    "user_agent": ("user_agent", "useragent", "ua", "http_user_agent"),
    "device_fingerprint": ("device_fingerprint", "device_id", "fingerprint", "device"),
    "session_id": ("session_id", "session", "sid", "sessionId"),
    "session_duration_seconds": ("session_duration", "duration", "duration_seconds", "session_duration_seconds"),
    "auth_method": ("auth_method", "auth_type", "authentication_method", "method"),
    "mfa_used": ("mfa_used", "mfa", "multi_factor", "two_factor", "2fa"),
    "success": ("success", "outcome", "result", "status"),
    "failure_reason": ("failure_reason", "reason", "error", "error_message"),
}

EVENT = T.StructType(
    [
        T.StructField("event_index", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("asn", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("session_duration_seconds", T.DoubleType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("mfa_used", T.BooleanType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("raw_fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

FAILURES = ("failed_login", "mfa_failure")
TRUE_WORDS = ("true", "success", "1", "yes", "pass", "passed")
FALSE_WORDS = ("false", "failure", "0", "no", "fail", "failed")
#: Spark's own cast reads every ISO form; these are the others.
TIME_FORMATS = ("dd/MMM/yyyy:HH:mm:ss Z", "MMM d HH:mm:ss")
