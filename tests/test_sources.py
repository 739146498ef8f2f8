"""Journal, stored state, CSV, settings, streams and the controller."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.flags import BySize
from tidemark.sources import csv, journal, state, tables
from tidemark.storage import exists, shared_folder
from tidemark.streaming import journal as streams
from tidemark.streaming import ring
from tidemark.streaming.controller import Controller, Timer

LINES = ['{"t":1,"d":2}', '  {"t":1,"d":2} ', '{"t":1,"d":2} junk', '{"t":NaN,"d":2}', "{'t':1,'d':2}", '{"t":1,"t":5,"d":2}', "[1,2]", '[{"t":1,"d":2}]', "7", "null", '"x"', '{"t":"1","d":2}', '{"t":true,"d":2}', '{"t":1,"d":2,"x":[{"y":null}]}', '{"t":-1,"d":-2}', '{"t":1.5,"d":2.25}', '{"d":2,"t":1}', "", "   ", '{"t":1}', '{"t":1,"d":null}', '{"t":1,"d":2},{"t":3,"d":4}', '{"t":1,"d":2}}', '{"t":1 "d":2}', "{t:1,d:2}", '{"t":1e3,"d":2}', '{"t":1,"d":2,}', '{"T":1,"D":2}', "{}", '{"t":{"a":1},"d":2}']


def strict(line):
    try:
        x = json.loads(line, parse_constant=lambda _: math.nan)
    except ValueError:
        return None
    good = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    return (float(x["t"]), float(x["d"])) if isinstance(x, dict) and good(x.get("t")) and good(x.get("d")) else None


def test_journal_lines(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, value string")
    got = {r.i: (r.ts_ms, r.delta_ms) for r in journal.parse(rows).collect()}
    assert got == {i: strict(x) for i, x in enumerate(LINES) if strict(x)}


def test_journal_file(spark):
    path = f"{shared_folder(spark, 'test')}/journal"
    assert journal.read(spark, path).count() == 0
    slices = spark.createDataFrame([(1, 1000), (2, 1000)], "ts_ms long, delta_ms long")
    journal.append(slices, path)
    journal.append(slices.limit(1), path)
    assert journal.read(spark, path).agg(F.sum("delta_ms")).first()[0] == 3000
    journal.truncate(spark, path)
    assert not exists(spark, path)


def test_state_files(spark):
    folder = shared_folder(spark, "test")
    first, second = state.JsonFile(spark, f"{folder}/a"), state.JsonFile(spark, f"{folder}/b")
    assert state.load_first(spark, [first, second]).first().total_ms == 0
    kept = state.fresh(spark).withColumn("total_ms", F.lit(42).cast("long"))
    second.save(kept)
    loaded = state.load_first(spark, [first, second])
    assert loaded.first().total_ms == 42
    second.save(loaded.withColumn("total_ms", F.col("total_ms") + 1))  # over the file that it is read from
    assert second.load().first().total_ms == 43
    spark.createDataFrame([('{"version":"1","totalMs":5}',)], "value string").coalesce(1).write.mode("overwrite").text(first.path)
    assert first.load() is None

    class Broken(state.JsonFile):
        def save(self, state):
            raise OSError("full")

    assert state.save_all(kept, [Broken(spark, f"{folder}/c"), first], 7) == [False, True]
    assert first.load().first().last_saved_ms == 7
    first.delete()
    assert not first.is_available()


def test_state_payloads(spark):
    rows = [("a", '{"version":1,"totalMs":5,"sessions":[{"startMs":1,"endMs":3,"durationMs":2}]}'), ("b", '{"version":1}'), ("c", "nonsense"), ("d", '{"version":1,"totalMs":"5"}'), ("e", None)]
    got = state.decode(spark.createDataFrame(rows, "ws_id string, value string")).collect()
    assert [(r.ws_id, r.total_ms, r.is_enabled, r.sessions[0].duration_ms) for r in got] == [("a", 5, True, 2)]
    registry = spark.createDataFrame([('{"version":1,"totalMs":9,"workspaces":{"w":{"name":"n","uri":"u","totalMs":9,"lastSyncedAt":4}}}',), ("x",)], "value string")
    assert [tuple(r) for r in state.decode_global(registry).collect()] == [("w", "n", "u", 9, 4)]
    assert state.empty_sync_log(spark).columns == ["ws_id", "name", "uri", "total_ms", "synced_at"]


def test_fallback(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "ws_id string, total_ms long")
    got = state.fallback([make(("a", 1)), make(("a", 2), ("b", 3)), make(("a", 0), ("b", 0), ("c", 0))]).orderBy("ws_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0), ("b", 3, 1), ("c", 0, 2)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("w", 1000, 3000, 2000), ("w", 0, 500, 500)], tables.SESSION)
    text = csv.CsvExporter("Report").export(df, "mine, too", 2500, 1_706_616_000_001)
    assert text == "# Report: mine, too\n# Generated: 2024-01-30T12:00:00.001Z\n# Total: 2500ms\n\nSession Start,Session End,Duration (ms)\n1970-01-01T00:00:00.000Z,1970-01-01T00:00:00.500Z,500\n1970-01-01T00:00:01.000Z,1970-01-01T00:00:03.000Z,2000"
    with pytest.raises(ValueError):
        csv.CsvExporter().export(df, "a\nb", 0, 0)
    csv.write(df, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2


def test_settings():
    assert Config.read({"max_sessions": 5, "odd": 1, "enabled": None}) == Config(max_sessions=5)
    for bad in ({"ring_buffer_capacity": 63}, {"max_sessions": -1}, {"status_bar_format": "x"}):
        with pytest.raises(ValueError):
            Config.read(bad)


def test_journal_stream_goes_on_where_it_stopped(spark):
    folder = shared_folder(spark, "test")
    journal.append(spark.createDataFrame([(1, 1000)], "ts_ms long, delta_ms long"), f"{folder}/in")
    for more in (1, 2):
        streams.to_table(streams.journal_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
        assert spark.read.parquet(f"{folder}/out").count() == more
        journal.append(spark.createDataFrame([(2, 1000)], "ts_ms long, delta_ms long"), f"{folder}/in")
    streams.to_journal(streams.journal_stream(spark, f"{folder}/in"), f"{folder}/copy", f"{folder}/check2", once=True).awaitTermination()
    assert journal.read(spark, f"{folder}/copy").count() == 3
    assert streams.heartbeat(spark).isStreaming


def test_flusher_writes_when_due(spark):
    folder = shared_folder(spark, "test")
    flusher = streams.Flusher(spark, f"{folder}/wait", f"{folder}/journal", BySize(0.5), capacity=4)
    one = spark.createDataFrame([(1, 1000)], "ts_ms long, delta_ms long")
    assert [flusher.push(one, i, i * 1000) for i in range(5)] == [0, 2, 0, 2, 0]
    assert flusher.flush_all(9) == 1 and flusher.flush_all(9) == 0
    assert journal.read(spark, f"{folder}/journal").count() == 5


def test_save_each(spark):
    folder = shared_folder(spark, "test")
    journal.append(spark.createDataFrame([(1, 1000)], "ts_ms long, delta_ms long"), f"{folder}/in")
    streams.save_each(streams.journal_stream(spark, f"{folder}/in"), lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/{i}"), f"{folder}/check", once=True).awaitTermination()
    assert spark.read.parquet(f"{folder}/out/0").count() == 1


def test_ring_stream_equals_batch(spark):
    from tidemark.operators import retention

    folder = shared_folder(spark, "test")
    rows = spark.createDataFrame([(f"w{i % 2}", i, 1000) for i in range(9)], tables.SLICE)
    rows.write.parquet(f"{folder}/in")
    before = {k: spark.conf.get(k, None) for k in ring.SETTINGS}
    for k, v in ring.SETTINGS.items():
        spark.conf.set(k, v)
    try:
        out = ring.ring_stream(spark.readStream.schema(tables.SLICE).parquet(f"{folder}/in"), 3)
        streams.save_each(out, lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/{i}"), f"{folder}/check", once=True).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    key = lambda df: sorted(map(tuple, df.select("ws_id", "ts_ms", "delta_ms", "overwritten").collect()))
    assert key(spark.read.parquet(f"{folder}/out/0")) == key(retention.ring(rows, 3))


def test_controller():
    seen = []
    c = Controller(Timer(), Config(), seen.append)
    c.start(10)
    c.start(20)
    assert c.stop(30) == 20 and c.stop(40) == 0
    c.start(50)
    c.configure(60, global_disabled=True)
    assert c.state == "disabled" and c.timer.total_ms == 30
    c.configure(70, global_disabled=False)
    assert c.state == "running" and c.timer.elapsed_ms(75) == 5
    c.new_period(80)
    assert c.timer.total_ms == 0 and len(c.timer.sessions) == 3 and c.state == "running"
    c.configure(90, max_sessions=1)
    c.stop(100)
    assert len(c.timer.sessions) == 1 and "saving" in seen
