"""Edge cases of the operators against values worked out by hand or by a plain model."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import format as fmt
from tidemark.functions import text, time
from tidemark.operators import aggregates, dashboard, flags, retention, timer, workspaces
from tidemark.sources import tables

DAY = 86_400_000
NOON = 1_706_616_000_000  # 2024-01-30 12:00 UTC


def ms(*parts):
    return int(datetime(*parts[:6], tzinfo=timezone.utc).timestamp()) * 1000 + (parts[6] if len(parts) > 6 else 0)


def sessions(spark, rows):
    return spark.createDataFrame([(w, s, s + d, d) for w, s, d in rows], tables.SESSION)


def column(spark, values, f, kind="long"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_days_and_weeks_at_their_edges(spark):
    at = [ms(2024, 2, 4, 23, 59, 59, 999), ms(2024, 2, 5, 0, 0, 0), ms(2024, 2, 29, 12, 0, 0), ms(2023, 12, 31, 23, 0, 0), ms(2024, 1, 1, 0, 0, 0), -1, 0]
    assert column(spark, at, time.day_key) == ["2024-02-04", "2024-02-05", "2024-02-29", "2023-12-31", "2024-01-01", "1969-12-31", "1970-01-01"]
    assert column(spark, at, lambda c: time.day_key(time.week_start(c))) == ["2024-01-29", "2024-02-05", "2024-02-26", "2023-12-25", "2024-01-01", "1969-12-29", "1969-12-29"]
    assert column(spark, at[:2], time.weekday) == ["日", "一"]
    assert column(spark, [at[0]], time.iso) == ["2024-02-04T23:59:59.999Z"]
    assert column(spark, [at[0]], time.clock) == ["23:59:59.999"]


def model_duration(v):
    s = v // 1000
    h, m, s = s // 3600, int((abs(s) % 3600) * (1 if s >= 0 else -1)), s
    m = m // 60
    s = int(abs(s) % 60) * (1 if s >= 0 else -1)
    return " ".join(([f"{h}h"] if h > 0 else []) + ([f"{m}m"] if m > 0 else []) + [f"{s}s"])


def test_durations(spark):
    at = [0, 999, 1000, 59_999, 60_000, 3_599_999, 3_600_000, 3_661_000, 90_061_000, -1, -61_000]
    assert column(spark, at, fmt.duration) == [model_duration(v) for v in at]
    assert column(spark, [3_661_000, 60_000, 5_000, 3_600_000], fmt.compact) == ["1h 1m", "1m 0s", "5s", "1h 0m"]
    assert column(spark, [1_800_000], lambda c: fmt.dual(c, c * 4)) == ["今日 30m 0s · 累计 2h 0m"]
    assert column(spark, [None], fmt.duration) == [None]


def test_status_bar(spark):
    modes = ["today-total", "total-today", "compact", "odd"]
    bar = lambda on: column(spark, modes, lambda m: fmt.status_bar(m, F.lit(60_000), F.lit(3_600_000), F.lit(on)), "string")
    assert bar(True) == ["$(watch) 今日 1m 0s · 累计 1h 0m", "$(watch) 累计 1h 0m · 今日 1m 0s", "$(watch) 1m 0s", None]
    assert bar(False) == [None] * 4
    assert column(spark, modes, fmt.next_mode, "string") == ["total-today", "compact", "today-total", "today-total"]
    assert column(spark, [-1.0, 0.5, 3.0], fmt.clamp, "double") == [0.0, 0.5, 1.0]


def test_text(spark):
    assert column(spark, ["FILE:///A/b///", "x", "/", ""], text.workspace_id, "string") == ["file:///a/b", "x", "", ""]
    assert column(spark, ["<a & b>"], text.escape_html, "string") == ["&lt;a &amp; b&gt;"]
    assert column(spark, ["debug", "warn", "error"], lambda c: text.logged(c, "warn"), "string") == [False, True, True]
    assert column(spark, ["zh-CN", "zh", "en", "ja"], text.locale, "string") == ["zh-CN", "zh-CN", "en", "en"]
    assert text.fill("{0} of {1}, {2}", "a", 3) == "a of 3, {2}"


def test_sums_agree_with_each_other(spark):
    rng = random.Random(3)
    rows = [(f"w{rng.randrange(4)}", ms(2024, 1, 1, 0, 0, 0) + rng.randrange(40 * DAY), rng.randrange(10_000_000)) for _ in range(300)]
    df = sessions(spark, rows)
    total = sum(d for _, _, d in rows)
    assert aggregates.sum_slices(tables.slices(df)).first()[0] == total
    for stats in (aggregates.daily_stats(df), aggregates.weekly_stats(df), aggregates.daily_stats(df, ["ws_id"]), aggregates.daily_stats(aggregates.split_midnight(df))):
        assert stats.agg(F.sum("total_ms")).first()[0] == total
    days: dict[str, list[int]] = {}
    for _, s, d in rows:
        day = (datetime(1970, 1, 1) + timedelta(milliseconds=s)).strftime("%Y-%m-%d")
        days.setdefault(day, []).append(d)
    assert [tuple(r) for r in aggregates.daily_stats(df).collect()] == [(k, sum(v), len(v)) for k, v in sorted(days.items())]


def test_nothing_in_gives_zero(spark):
    none = sessions(spark, [])
    assert aggregates.sum_slices(tables.slices(none)).first()[0] == 0
    seven = aggregates.last_seven_days(none, NOON)
    assert [r.total_ms for r in seven.collect()] == [0] * 7
    chart = aggregates.chart(seven).collect()
    assert {(r.is_empty, r.scale_ms, r.height_pct) for r in chart} == {(True, 1, 2.0)}
    assert aggregates.daily_stats(none).count() == aggregates.weekly_stats(none).count() == 0


def test_open_session_counts_differently_today_and_in_the_week(spark):
    evening = NOON - 14 * 3_600_000  # 22:00 the day before
    for start, today, last in ((NOON - 1000, 1000, 1000), (evening, 0, 14 * 3_600_000), (0, 0, 0)):
        state = spark.createDataFrame([("w", start)], "ws_id string, current_start_ms long")
        none = sessions(spark, [])
        assert aggregates.today_ms(none, state, NOON).first().today_ms == today
        elapsed = NOON - start if start else 0
        assert aggregates.last_seven_days(none, NOON, elapsed).collect()[-1].total_ms == last


def test_a_session_over_midnight_belongs_to_its_start(spark):
    df = sessions(spark, [("w", ms(2024, 1, 29, 23, 0, 0), 2 * 3_600_000)])
    assert [(r.date, r.total_ms) for r in aggregates.daily_stats(df).collect()] == [("2024-01-29", 7_200_000)]
    assert [(r.date, r.total_ms) for r in aggregates.daily_stats(aggregates.split_midnight(df)).collect()] == [("2024-01-29", 3_600_000), ("2024-01-30", 3_600_000)]


def log(spark, rows):
    return spark.createDataFrame([(w, w.upper(), w, t, at) for w, t, at in rows], tables.SYNC)


def test_latest_record_wins(spark):
    rows = log(spark, [("a", 5, 1), ("b", 7, 2), ("a", 0, 3), ("c", 7, 1), ("c", 7, 4)])
    assert [(r.ws_id, r.total_ms) for r in workspaces.ranking(rows).collect()] == [("c", 7), ("b", 7), ("a", 0)]
    assert tuple(workspaces.snapshot(rows).first()) == (14, 3)
    assert [r.place for r in workspaces.top(rows, 2).collect()] == [1, 2]
    assert workspaces.list_shown(rows).first()[0] and not workspaces.list_shown(rows.where("ws_id = 'a'")).first()[0]
    more = workspaces.sync(rows, log(spark, [("d", 1, 9)]))
    assert workspaces.snapshot(more).first().workspace_count == 4


@pytest.mark.parametrize("most,left", [(0, 5), (-1, 5), (1, 1), (4, 4), (5, 5), (6, 5)])
def test_trim(most, left, spark):
    df = sessions(spark, [("w", i * 10, i) for i in range(5)])
    kept = [r.start_ms for r in retention.trim(df, most).orderBy("start_ms").collect()]
    assert kept == [i * 10 for i in range(5)][-left:]


@pytest.mark.parametrize("capacity", [1, 3])
def test_ring_keeps_the_newest(capacity, spark):
    for pushed in {0, 1, capacity - 1, capacity, capacity + 1, 2 * capacity}:
        df = spark.createDataFrame([("w", i, 1000) for i in range(pushed)], tables.SLICE)
        held = retention.ring(df, capacity).orderBy("ts_ms").collect()
        assert [r.ts_ms for r in held] == list(range(pushed))[-capacity:]
        assert all(r.overwritten == max(0, pushed - capacity) for r in held)
    assert retention.peek_last(df, 0).count() == 0
    with pytest.raises(ValueError):
        retention.ring(df, 0)


@pytest.mark.parametrize("since,added", [(0, 0), (1, 1), (DAY - 1, DAY - 1), (DAY, 0), (-5, 0)])
def test_compensation_is_guarded(since, added, spark):
    state = spark.createDataFrame([("w", 100, NOON - since, 0)], "ws_id string, total_ms long, current_start_ms long, last_saved_ms long")
    none = spark.createDataFrame([], tables.SLICE)
    assert timer.recover(state, none, NOON).first().total_ms == 100 + added


def test_recovery_counts_again_or_once(spark):
    state = spark.createDataFrame([("w", 1000 + 60_000, NOON - 100_000, NOON - 40_000)], "ws_id string, total_ms long, current_start_ms long, last_saved_ms long")
    slices = spark.createDataFrame([("w", NOON - 100_000 + i * 1000, 1000) for i in range(1, 91)], tables.SLICE)
    assert timer.recover(state, slices, NOON).first().total_ms == 1000 + 60_000 + 90_000 + 100_000
    assert timer.recover_exact(state, slices).first().total_ms == 1000 + 90_000


def test_pairs_ignore_repeats(spark):
    marks = [("w", 0, "stop"), ("w", 1, "start"), ("w", 2, "start"), ("w", 5, "stop"), ("w", 6, "stop"), ("w", 7, "start"), ("v", 3, "start"), ("v", 4, "stop")]
    rows = timer.pairs(spark.createDataFrame(marks, "ws_id string, at_ms long, kind string")).orderBy("ws_id").collect()
    assert [(r.ws_id, r.start_ms, r.end_ms) for r in rows] == [("v", 3, 4), ("w", 1, 5)]


def test_checkpoint_and_snapshot(spark):
    state = spark.createDataFrame([("w", 10, NOON - 5, 0), ("v", 10, 0, 0)], "ws_id string, total_ms long, current_start_ms long, last_saved_ms long")
    assert {r.ws_id: (r.session_elapsed_ms, r.current_total_ms) for r in timer.snapshot(state, NOON).collect()} == {"w": (5, 15), "v": (0, 10)}
    assert {r.ws_id: (r.total_ms, r.current_start_ms, r.last_saved_ms) for r in timer.checkpoint(state, NOON).collect()} == {"w": (15, NOON - 5, NOON), "v": (10, 0, NOON)}


def test_a_period_keeps_history(spark):
    df = sessions(spark, [("w", 10, 1), ("w", 20, 2)])
    periods = spark.createDataFrame([("w", 15)], "ws_id string, period_start_ms long")
    assert tuple(timer.period_totals(df, periods).first()) == ("w", 2, 3, 2)


def test_switches(spark):
    rows = spark.createDataFrame([(e, g) for e in (True, False) for g in (True, False)], "e boolean, g boolean")
    got = {(r.e, r.g): (r.c, r.s) for r in rows.select("e", "g", flags.should_count(F.col("e"), F.col("g")).alias("c"), flags.state(F.col("e"), F.col("g")).alias("s")).collect()}
    assert got == {(True, True): (False, "globally-disabled"), (True, False): (True, "enabled"), (False, True): (False, "globally-disabled"), (False, False): (False, "workspace-disabled")}


def test_flush_columns_equal_objects(spark):
    cases = [(n, c, e) for c in (0, 10) for n in (0, 1, 5, 10) for e in (0, 9_999, 10_000)]
    rows = spark.createDataFrame(cases, "n int, c int, e int")
    n, c, e = (F.col(x) for x in "nce")
    for r in rows.select("n", "c", "e", flags.due_by_time(n, e).alias("t"), flags.due_by_size(n, c).alias("s"), flags.due(n, c, e).alias("b")).collect():
        assert r.t == flags.ByTime().should_flush(r.n, r.c, r.e)
        assert r.s == flags.BySize().should_flush(r.n, r.c, r.e)
        assert r.b == flags.ByEither().should_flush(r.n, r.c, r.e)
    assert flags.BySize(7).should_flush(10, 10, 0) and not flags.BySize(7).should_flush(9, 10, 0)


def test_dashboard_lists(spark):
    df = sessions(spark, [("w", NOON - 1000, 10)])
    state = spark.createDataFrame([("w", 10, 0)], "ws_id string, total_ms long, current_start_ms long")
    rows = log(spark, [("w", 1, 1), ("v", 5, 1)])
    row = dashboard.nested(dashboard.dashboard(df, state, rows, "w", NOON), aggregates.last_seven_days(df, NOON), workspaces.ranking(rows)).first()
    assert row.today_ms == 10 and row.workspace_count == 2 and row.max_sessions == 1000
    assert [w.name for w in row.workspace_list] == ["V", "W"] and [d.total_ms for d in row.daily_stats] == [0] * 6 + [10]
