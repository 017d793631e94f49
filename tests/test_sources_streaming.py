"""File sources, sinks and Structured Streaming forms."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import streaming
from ledgerloom.functions import misc, text
from ledgerloom.operators import aggregates, reports, sweep
from ledgerloom.sources import scenarios, tables


def test_images_and_manifest(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504e470d0a1a0a") + b"x")
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "c.jpg").write_bytes(bytes.fromhex("ffd8ff") * 10)
    got = {r["path"].rsplit("/", 1)[1]: r for r in tables.read_images(spark, str(tmp_path), max_bytes=20).collect()}
    assert got["a.png"]["kind"] == "png" and got["a.png"]["reject_reason"] is None and got["b.txt"]["reject_reason"] == "UNSUPPORTED_TYPE" and got["c.jpg"]["reject_reason"] == "TOO_LARGE"
    assert got["b.txt"]["sha256"] == hashlib.sha256(b"hello").hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "cases": [{"id": "G01", "n": 3}, {"id": "S02", "n": None}]}))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "m.json"), schema).collect()] == [("G01", 3), ("S02", None)]


def test_extraction_of_odd_rows(spark):
    rows = [("1", "Rs 100", "20 Aug 2026", None), ("2", "junk", "never", None), ("3", "Rs 5", "20 Aug 2026", "REFUSED"), ("4", None, None, "TIMEOUT"), ("5", None, None, None)]
    raw = spark.createDataFrame(rows, "claim_id string, amount string, timestamp string, error_kind string").selectExpr("*", "'P' AS provider", "'s' AS sender_name", "cast(null as string) AS receiver_name", "'r' AS reference_id")
    got = {r["claim_id"]: r for r in tables.extract_claims(raw).collect()}
    assert got["1"]["amount_minor"] == 10000 and got["1"]["date_inferred"] and got["1"]["confidences"]["amount"] == 1.0
    assert got["2"]["amount_minor"] is None and got["2"]["confidences"]["amount"] == 0.5 and got["3"]["notes"] == ["refused"] and got["3"]["amount_minor"] is None
    assert got["4"]["notes"] == ["degraded:timeout"] and "amount" not in got["5"]["confidences"]


def test_scenarios(spark, tmp_path):
    if scenarios.yaml is None:
        return
    (tmp_path / "s.yaml").write_text("scenarios:\n- name: one\n  expected_status: VERIFIED\n  expected_reasons: [A]\n")
    assert scenarios.load_scenarios(spark, str(tmp_path / "s.yaml")).first()["expected_reasons"] == ["A"]


def test_plausibility_and_helpers(spark):
    d = spark.createDataFrame([(1080, 2400, {"Software": "Adobe Photoshop 24"}), (100, 100, {"Software": "camera"})], "w int, h int, m map<string,string>")
    assert [tuple(r) for r in d.select(tables.plausible_ratio(F.col("w"), F.col("h")), tables.editor_signature(F.col("m"))).collect()] == [(True, True), (False, False)]
    one = spark.range(1)
    lit = lambda x: one.select(x.alias("x")).first()["x"]
    assert lit(misc.demo_time(F.lit(-30))) == misc.DEMO_NOW_S - 1800 and lit(misc.hamming_hex(F.lit("ff"), F.lit("0f"))) == 4
    assert lit(misc.stable_id(F.lit("a"))) == lit(misc.stable_id(F.lit("a"))) and lit(text.as_uuid(F.lit("nope"))) is None
    assert lit(text.iban_check("GB", F.lit("WEST12345698765432"))) == "82" and lit(text.reference_check_digit(F.lit("EP123"))) == 6
    assert lit(text.earlier_order_ref(F.array(F.lit("PROOF_PREVIOUSLY_SUBMITTED:S1")), F.lit(""), F.lit("x"))) == "S1"
    assert lit(text.earlier_order_ref(F.array().cast("array<string>"), F.lit("see ORD-1001 and ORD-1002"), F.lit("ORD-1001"))) == "ORD-1002"
    assert lit(text.grounded(F.lit("EP 12"), F.lit("ref: ep-12"))) is True and lit(text.grounded(F.lit("zz"), F.lit("ref"))) is None
    assert "| a |" in reports.markdown(spark.createDataFrame([("a",)], "x string"), "T")


def test_sweep_and_flips(spark):
    swept = spark.createDataFrame([("k", 0.1, False, 5, 2, 0), ("k", 0.2, True, 0, 0, 0), ("q", 1.0, False, 5, 0, 1), ("z", 1.0, False, 5, 0, 0)], "knob string, value double, refused boolean, cases long, status_flips long, explanation_flips long")
    assert {r["knob"]: r["kind"] for r in sweep.sensitivity(swept).collect()} == {"k": "exercised", "q": "explanation_only", "z": "inert"}
    flips = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (5.0, True)], "value double, moved boolean")
    assert tuple(aggregates.nearest_flips(flips, 3.0).first()) == (2.0, 5.0)


def test_streams(spark, tmp_path):
    rows = [(1, "o1", f"2026-01-01 00:0{i % 6}:00", "M", f"k{i % 2}") for i in range(7)] + [(2, "o2", "2026-01-01 00:01:00", "M", "k9")]
    spark.createDataFrame(rows, "id long, order_id string, t string, merchant_id string, key string").withColumn("ts", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r["order_id"], r["attempts"]) for r in run(streaming.attempts_window(stream()), "many", "complete")] == [("o1", 7)]
    assert len(run(streaming.unique_requests(stream()), "once", "append")) == 3
    batches = []
    q = streaming.decide_stream(stream(), lambda d: d.select("id"), lambda d, b: batches.append((b, d.count())), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(n for _, n in batches) == 8
    feed = spark.createDataFrame([("t1", "r1", "2026-01-01 01:00:00"), ("t2", "r2", "2026-01-02 00:00:00")], "txn_id string, feed_ref string, x string").select("txn_id", "feed_ref", F.to_timestamp("x").alias("feed_ts"))
    claims = spark.createDataFrame([("c1", "r1"), ("c2", "r2")], "claim_id string, ref string").withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    assert {r["claim_id"]: r["txn_id"] for r in streaming.await_feed(claims, feed).collect()} == {"c1": "t1", "c2": None}


def test_decision_sink(spark, tmp_path):
    evidence = "array<struct<field:string,code:string,label:string,score:double,agreement:string>>"
    d = spark.createDataFrame([("c", "VERIFIED", "LOW", 1.0, ["A"], "t", "R090", None, "fp", [("amount", "AMT_EXACT", "l", 1.0, "AGREE")])], f"claim_id string, status string, risk string, confidence double, reasons array<string>, matched_txn_id string, fired_rule_id string, violation string, policy_fingerprint string, evidence {evidence}")
    for batch in ("b1", "b2", "b1"):  # a batch that comes again replaces itself
        tables.write_decisions(d, str(tmp_path), batch)
    assert spark.read.parquet(f"{tmp_path}/attempts").count() == 2
    tables.write_decisions(d, str(tmp_path / "one"), "b1")
    tmp_path = tmp_path / "one"
    assert spark.read.parquet(f"{tmp_path}/attempts").count() == 1 and spark.read.parquet(f"{tmp_path}/evidence").first()["code"] == "AMT_EXACT"


def test_time_to_live_in_batches(spark):
    rows = [("M", "k", h) for h in (0, 1, 23, 24, 30, 49)] + [("M", "q", 5)]
    d = spark.createDataFrame(rows, "merchant_id string, key string, h int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    assert sorted((r["key"], r["h"]) for r in streaming.unique_requests(d).collect()) == [("k", 0), ("k", 24), ("k", 49), ("q", 5)]


def test_fallback_and_images(spark, tmp_path):
    schema = "claim_id string, amount string, error_kind string"
    first = spark.createDataFrame([("1", "Rs 1", None), ("2", None, "TIMEOUT"), ("3", None, "REFUSED"), ("4", None, "TIMEOUT")], schema)
    second = spark.createDataFrame([("1", "x", None), ("2", "Rs 2", None), ("3", "Rs 3", None)], schema)
    assert {r["claim_id"]: r["amount"] for r in tables.extract_with_fallback(first, second).collect()} == {"1": "Rs 1", "2": "Rs 2", "3": None, "4": None}
    (tmp_path / "a.webp").write_bytes(b"RIFF\x01\x02\x03\x04WEBPxx")
    (tmp_path / "b.wav").write_bytes(b"RIFF\x01\x02\x03\x04WAVExx")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in tables.read_images(spark, str(tmp_path)).collect()} == {"a.webp": "webp", "b.wav": None}
