"""The logs as streams give what the batch operators give."""

import json

from pyspark.sql import functions as F

from landlace.streaming import logs


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(stream, mode, name, folder):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).start()
    q.processAllAvailable()
    q.stop()


def test_latest_decision(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    row = lambda s, p, d: {"seq": s, "ts": f"2024-01-01T00:{s:02d}:00", "pair": p, "officer": "o", "decision": d}
    write(data, "a.json", [row(1, 1, "accept"), row(2, 2, "reject")])
    write(data, "b.json", [row(3, 1, "reject")])
    run(logs.latest(logs.read(spark, str(data), per_trigger=1)), "complete", "latest", tmp_path / "c")
    assert {(r["pair"], r["decision"]) for r in spark.table("latest").collect()} == {(1, "reject"), (2, "reject")}


def test_windows_and_lockouts(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    row = lambda s, u, e, sec: {"seq": s, "ts": f"2024-01-01T00:{sec // 60:02d}:{sec % 60:02d}", "user_id": u, "event": e}
    rows = [row(i, 1, "failed", 10 * i) for i in range(5)] + [row(10 + i, 2, "failed", 10 * i) for i in range(3)] + [row(13, 2, "success", 35)] + [row(14 + i, 2, "failed", 40 + 10 * i) for i in range(3)]
    write(data, "a.json", rows)
    run(logs.lockouts(logs.read(spark, str(data), logs.ACCESS)), "append", "locked", tmp_path / "c")
    assert [(r["user_id"], r["seq"]) for r in spark.table("locked").collect()] == [(1, 4)]


def test_windowed_counts(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    write(data, "a.json", [{"seq": 1, "ts": "2024-01-01T00:10:00", "pair": 1, "officer": "o", "decision": "accept"}])
    write(data, "b.json", [{"seq": 2, "ts": "2024-01-01T05:00:00", "pair": 1, "officer": "o", "decision": "accept"}])
    run(logs.per_window(logs.read(spark, str(data), per_trigger=1)), "append", "hours", tmp_path / "c")
    got = spark.table("hours").select(F.hour("start").alias("h"), "n").collect()
    assert [(r["h"], r["n"]) for r in got] == [(0, 1)]
