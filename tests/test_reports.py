"""The reports, from priced events."""

import json

from pyspark.sql import functions as F

from tokenloom.operators import reports

EVENTS = "seq long, source string, ts long, model string, session string, project string, input_tokens long, output_tokens long, cache_read long, cache_write_5m long, cache_write_1h long, total long, cost decimal(38,6), priced_tokens long, unpriced_tokens long, observed_on array<string>"
DAY = 1751155200  # 2025-06-29, 00:00
DEVICES = "device_id string, name string, host string, is_local boolean, available boolean, exporter_version string, generated_at long, problem string"


def parts(spark, rows):
    found = reports.buckets(spark.createDataFrame(rows, EVENTS))
    missing = spark.createDataFrame([(m,) for m in sorted({r[3] for r in rows if r[14] and r[3]})], "model string")
    return found, missing, spark.createDataFrame([(len(rows), 1, 0)], "events long, duplicates long, synthetic long")


ROWS = [
    (0, "claude", DAY + 60, "big", "s1", "/p", 1000, 200, 0, 0, 0, 1200, 2_000_000, 1200, 0, ["d1"]),
    (1, "codex", DAY - 86_400 + 7200, "odd", "s2", None, 10, 20, 30, 0, 0, 60, 0, 0, 60, ["d1", "d2"]),
    (2, "claude", 0, None, "", "/p", 1, 1, 1, 1, 1, 5, 0, 0, 5, []),
]


def with_decimals(rows):
    from decimal import Decimal

    return [(*r[:12], Decimal(r[12]), *r[13:]) for r in rows]


def test_json_document(spark):
    found, missing, scan = parts(spark, with_decimals(ROWS))
    devices = spark.createDataFrame([("d1", "anvil", None, True, True, None, 0, None)], DEVICES)
    doc = json.loads(reports.json_document(found, devices, missing, scan, "2025-06-29", 99).first().json)
    assert (doc["window_days"], doc["generated_ts"], doc["unpriced_models"], doc["scan"]["duplicates"]) == (None, 99, ["odd"], 1)
    assert (doc["total"]["tokens"]["total"], doc["total"]["requests"], doc["total"]["sessions"], doc["total"]["cost_usd"]) == (1265, 3, 2, 2.0)
    assert doc["today"]["requests"] == 1 and doc["today"]["last_ts"] == DAY + 60
    assert [b["label"] for b in doc["by_model"]] == ["big", "odd", "unknown"] and [b["label"] for b in doc["by_project"]] == ["/p", "unknown"]
    assert sorted((b["label"], b["device"]) for b in doc["by_device"]) == [("@shared", "Shared"), ("d1", "anvil")]
    assert [b["date"] for b in doc["daily"]] == ["2025-06-28", "2025-06-29"] and [b["hour"] for b in doc["by_hour"]] == list(range(24)) and doc["by_hour"][2]["requests"] == 1
    assert doc["devices"] == [{"id": "d1", "name": "anvil", "ssh_host": None, "local": True, "available": True, "exporter_version": None, "synced_ts": None, "problem": None}]
    idle = json.loads(reports.json_document(found, devices, missing, scan, "2025-01-01", 99).first().json)
    assert idle["today"] is None


def test_text(spark):
    lines = [r.line for r in reports.text_lines(*parts(spark, with_decimals(ROWS)), "2025-06-29", DAY + 3600).collect()]
    assert lines[0] == "summary — all time" and lines[3] == "            1,265      $2.00+          3         2   TOTAL"
    assert [line.split() for line in lines if line.endswith(("Claude", "Codex", "today"))] == [["1,205", "$2.00+", "2", "1", "Claude"], ["60", "—", "1", "1", "Codex"], ["1,200", "$2.00", "1", "1", "today"]]
    assert "    big                1,200       $2.00" in lines and "    /p                 1,205      $2.00+  59m ago" in lines
    assert any(line == "  5% of tokens are on a model with no price on file: odd" for line in lines) and lines[-1] == "  scanned 3 events · 1 duplicates · 0 synthetic"


def test_nothing(spark):
    found, missing, scan = parts(spark, [])
    devices = spark.createDataFrame([], DEVICES)
    doc = json.loads(reports.json_document(found.where(F.lit(True)), devices, missing, scan, "2025-06-29", 99).first().json)
    assert doc["by_model"] == [] and doc["daily"] == [] and len(doc["by_hour"]) == 24
    assert "By model" not in " ".join(r.line for r in reports.text_lines(found, missing, scan, "2025-06-29", 1).collect() if r.line)
