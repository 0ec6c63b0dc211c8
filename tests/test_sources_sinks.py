import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_patterns_rules import events  # noqa: F401
from tidewatch.sinks import formats, integrity
from tidewatch.sources import readers


def test_csv_with_aliases(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("Time,UserName,action,src_ip,country,MFA,outcome,duration,extra\n2026-01-01 09:00:00,ann,LOGIN,1.2.3.4,us,yes,fail,12.5,q\n1767258000,bob,,,,,,,\n1767258000000,cy,,,,,,,\nnonsense,dan,,,,,,,\n2026-01-01T09:00:00Z,,,,,,,,\n")
    rows = {r["user_id"]: r for r in readers.read_events(spark, str(p)).collect()}
    assert set(rows) == {"ann", "bob", "cy"}
    a = rows["ann"]
    assert (a["event_type"], a["country_code"], a["mfa_used"], a["success"], a["session_duration_seconds"], a["ip_address"]) == ("login", "US", True, False, 12.5, "1.2.3.4")
    assert a["raw_fields"]["extra"] == "q"
    assert rows["bob"]["timestamp"] == rows["cy"]["timestamp"]
    assert rows["bob"]["event_type"] == "login" and rows["bob"]["success"] is None


def test_json_variants(spark, tmp_path):
    event = {"timestamp": "2026-01-01T09:00:00Z", "user": "ann", "success": True}
    shapes = {"array": [event, event], "events": {"events": [event]}, "logs": {"logs": [event]}, "one": event}
    for name, shape in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
    counts = {n: readers.read_events(spark, str(tmp_path / f"{n}.json")).count() for n in shapes}
    assert counts == {"array": 2, "events": 1, "logs": 1, "one": 1}
    (tmp_path / "log.jsonl").write_text(json.dumps(event) + "\n\n" + json.dumps(event) + "\n")
    assert readers.read_events(spark, str(tmp_path / "log.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.read_events(spark, str(tmp_path / "log.xml"))


def test_host_events(spark, tmp_path):
    p = tmp_path / "auth_part.txt"
    p.write_text("time,u,su,sc,dc,at,lt,ao,s\n1,U1@D,U2@D,C1,C2,NTLM,Network,LogOn,Success\n2,U3@D,U3@D,C3,C4,Kerberos,?,LogOn,Fail\nbad\nx,U@D,U,C,C,a,b,c,Success\n")
    rows = readers.read_events(spark, str(p)).orderBy("timestamp").collect()
    assert [(r["user_id"], r["event_type"], r["device_fingerprint"], r["auth_method"], r["timestamp"]) for r in rows] == [("U1", "login", "C1", "NTLM", datetime(2010, 1, 1, 0, 0, 1)), ("U3", "failed_login", "C3", "Kerberos", datetime(2010, 1, 1, 0, 0, 2))]
    assert rows[0]["raw_fields"]["destination_computer"] == "C2"


def test_indicators(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("# list\n1.2.3.4 # bad\nas123\nru\n\nplain\n")
    assert {tuple(r) for r in readers.read_indicators(spark, str(p)).collect()} == {("ip", "1.2.3.4"), ("asn", "AS123"), ("country", "RU")}


@pytest.fixture()
def results(events):  # noqa: F811
    df = events([("a|b=c\nd", 0, {}), ("bob", 1, {})])
    return df.withColumns({"score": F.lit(-0.6), "confidence": F.lit(0.9), "is_anomaly": F.col("event_index") == 0})


def test_lines_are_sanitised(results):
    (line,) = [r["value"] for r in formats.cef(results).collect()]
    assert "\n" not in line and r"suser=a\|b\=c d cs1=login" in line and "|10|" in line
    (line,) = [r["value"] for r in formats.syslog(results).collect()]
    assert line.startswith("<82>1 2026-01-01T09:00:00Z - tidewatch") and "\n" not in line
    objects = [r["value"] for r in formats.stix_objects(results).collect()]
    assert json.loads(formats.stix_bundle(objects))["objects"][0]["x_event_type"] == "login"


def test_reports_and_envelopes(spark, results, tmp_path):
    summary = spark.createDataFrame([("u", 10, 6, 0.6, -0.2, "critical")], "user_id string, n_events long, n_anomalies long, anomaly_rate double, min_score double, risk string")
    assert "| u | 10 | 6 | 60.00% | critical | F |" in formats.report(summary)
    assert formats.timeline(results).splitlines()[9].endswith("2")
    assert formats.unwrap(formats.envelope("x", {"a": 1})) == {"a": 1} and formats.unwrap([1]) == [1]
    formats.write_csv(results.withColumn("list", F.array(F.lit(1))), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).count() == 2


def test_manifest_and_mirror(tmp_path, spark):
    p = tmp_path / "model.json"
    integrity.atomic_write(str(p), '{"a": 1}')
    integrity.write_manifest([str(p)], str(tmp_path / "m.json"), b"key")
    assert integrity.verify_manifest(str(tmp_path / "m.json"), str(tmp_path), b"key") == []
    integrity.atomic_write(str(p), '{"a": 2}')
    assert integrity.verify_manifest(str(tmp_path / "m.json"), str(tmp_path), b"key") == ["model.json"]
    with pytest.raises(ValueError):
        integrity.verify_manifest(str(tmp_path / "m.json"), str(tmp_path), b"other")
    p.write_text("broken")
    assert integrity.safe_load(str(p)) == {"a": 1}
    with pytest.raises(ValueError):
        integrity.inside("../x", str(tmp_path))
    assert integrity.digests(spark, str(tmp_path)).where("sha256 IS NOT NULL").count() >= 2


def test_encryption_and_chain(spark, tmp_path):
    key = integrity.new_key()
    df = spark.createDataFrame([("secret",)], "value string")
    hidden = integrity.encrypted(df, "value", key)
    assert hidden.first()["value"] != "secret" and integrity.decrypted(hidden, "value", key).first()["value"] == "secret"
    log = integrity.ChainedLog(str(tmp_path / "log"), b"k")
    log.append({"a": 1})
    log.append({"a": 2})
    assert len(integrity.ChainedLog(str(tmp_path / "log"), b"k").read()) == 2
    lines = (tmp_path / "log").read_text().splitlines()
    (tmp_path / "log").write_text("\n".join(lines[1:]) + "\n")
    with pytest.raises(ValueError):
        log.read()
