from datetime import datetime, timedelta

from textloom.sources import sinks
from textloom.streaming import ledger


def test_chat_and_demonstrations(spark, tmp_path):
    m = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    sinks.export_chat(m, str(tmp_path / "chat"))
    rows = {r.conversation_id: r for r in spark.read.json(str(tmp_path / "chat")).collect()}
    assert rows[1].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>assistant" and rows[1].message_count == 2
    d = spark.range(400).selectExpr("sha2(cast(id as string), 256) as content_hash", "'user' as source")
    sinks.export_demonstrations(d, str(tmp_path / "demo"))
    train, out = (spark.read.json(str(tmp_path / "demo" / x)).count() for x in ("train", "held_out"))
    assert train + out == 400 and 20 < out < 70
    sinks.export_demonstrations(d, str(tmp_path / "none"), sources=[], fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "none" / "train")).count() == 0


def test_feedback_beats_audit(spark):
    e = spark.createDataFrame([(1, "s", 5, 6, 0), (2, "s", 5, None, 0), (3, "s", None, None, 0)], "event_id int, session_id string, audit_id int, feedback_id int, ts int")
    s = spark.createDataFrame([("s", "c", "h")], "session_id string, client string, host string")
    a = spark.createDataFrame([(5, "old", "new")], "audit_id int, before string, after string")
    f = spark.createDataFrame([(6, "good", 1)], "feedback_id int, text string, rating int")
    got = {r.event_id: (r.kind, r.response, r.after) for r in sinks.feedback_pairs(e, s, a, f).collect()}
    assert got == {1: ("feedback", "good", None), 2: ("audit", "old", "new")}


def test_reports_and_contexts(spark):
    df = spark.createDataFrame([(2, "b|c"), (1, "a")], "id int, t string")
    assert "b\\|c" in sinks.markdown_report("T", df) and sinks.build_context(df, "id", "t") == "a\n\nb|c"
    c = spark.createDataFrame([("k", ["h1", "h2"]), ("j", ["h3"])], "key string, hashes array<string>")
    assert [r.key for r in sinks.stale_contexts(c, spark.createDataFrame([("h2",)], "hash string")).collect()] == ["k"]
    assert sinks.context_key("d", "m", ["b", "a"]) == sinks.context_key("d", "m", ["a", "b"]) != sinks.context_key("d", "m", ["a"])


def test_ledger(spark):
    t0 = datetime(2024, 1, 1)
    led = spark.createDataFrame([], ledger.RUNS)
    led = ledger.start(ledger.start(led, "r1", "h", "d", t0), "r2", "h", "d", t0 + timedelta(minutes=1))
    led = ledger.progress(led, "r2", t0 + timedelta(minutes=9))
    after = ledger.reclaim(led, t0 + timedelta(minutes=10), 300)
    assert {r.run_id: r.status for r in after.collect()} == {"r1": "failed", "r2": "running"}
    assert [r.run_id for r in ledger.resumable(after, "d").collect()] == ["r2"]
    assert [r.run_id for r in ledger.resumable(ledger.finish(after, "r2", t0), "d").collect()] == ["r1"]
    src = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    scans = spark.createDataFrame([("a", t0), ("b", t0 + timedelta(hours=1))], "source string, scanned_at timestamp")
    assert sorted(r.source for r in ledger.due(src, scans, t0 + timedelta(minutes=61), 600).collect()) == ["a", "c"]
