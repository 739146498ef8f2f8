"""The time-tracking queries over the event table, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import text
from ..functions.text import workspace_id
from ..functions.time import DAY_MS, WEEKDAYS, iso
from ..operators import aggregates, dashboard, flags, retention, timer, workspaces
from ..sources import csv, journal, state, tables
from ..storage import shared_folder
from ..streaming import journal as streams
from ..streaming import lifecycle
from ..streaming import ring as rings

#: The clock of all queries: 2024-01-30 12:00 UTC. A checkpoint stands half a day before, a period began on 2024-01-16.
AS_OF, CHECKPOINT, PERIOD = 1_706_616_000_000, 1_706_572_800_000, 1_705_363_200_000
KEEP, PEEK, RING, TOP = 10, 5, 3, 10
ONE = "file:///ws/2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Tables of the SQL side: s sessions, o open sessions, st stored state, y sync records, l the latest of them.
_WITH = f"""WITH s AS (SELECT event_id, 'file:///ws/' || user_id AS ws_id, user_id, epoch_us(ts) // 1000 AS start_ms, CAST(round(value * 1000) AS BIGINT) AS duration_ms, epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) AS end_ms FROM events),
o AS (SELECT ws_id, CASE WHEN user_id % 2 = 0 THEN max(start_ms) ELSE 0 END AS current_start_ms FROM s GROUP BY ws_id, user_id),
st AS (SELECT s.ws_id, CAST(coalesce(sum(CASE WHEN end_ms <= {CHECKPOINT} THEN duration_ms END), 0) AS BIGINT) AS total_ms, max(current_start_ms) AS current_start_ms FROM s JOIN o ON s.ws_id = o.ws_id GROUP BY s.ws_id),
y AS (SELECT regexp_replace(lower(CASE WHEN event_id % 2 = 0 THEN 'FILE:///WS/' ELSE 'file:///ws/' END || user_id || CASE WHEN event_id % 3 = 0 THEN '//' ELSE '' END), '/+$', '') AS ws_id, 'ws ' || user_id AS name, CAST(round(value * 1000) AS BIGINT) AS total_ms, epoch_us(ts) // 1000 AS synced_at FROM events),
l AS (SELECT * FROM (SELECT *, min(synced_at) OVER (PARTITION BY ws_id) AS first_seen, row_number() OVER (PARTITION BY ws_id ORDER BY synced_at DESC, total_ms DESC) AS r FROM y) WHERE r = 1)
"""


def _day(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _WITH + sql
        return f

    return add


def _sessions(spark, sf_dir, **between) -> DataFrame:
    return tables.sessions(tables.read(spark, sf_dir, "events"), **between)


def _state(spark, sf_dir) -> DataFrame:
    """ws_id, total_ms, current_start_ms, last_saved_ms: what was stored at the checkpoint."""
    rows = _sessions(spark, sf_dir)
    done = rows.groupBy("ws_id").agg(F.coalesce(F.sum(F.when(F.col("end_ms") <= CHECKPOINT, F.col("duration_ms"))), F.lit(0)).cast("long").alias("total_ms"))
    return done.join(tables.open_sessions(rows), "ws_id").withColumn("last_saved_ms", F.lit(CHECKPOINT).cast("long"))


def _log(spark, sf_dir) -> DataFrame:
    return tables.sync_log(tables.read(spark, sf_dir, "events"))


@query("SELECT CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms FROM s")
def sum_slices(spark, sf_dir):
    return aggregates.sum_slices(tables.slices(_sessions(spark, sf_dir)))


@query(f"SELECT st.ws_id, CAST(total_ms + coalesce(a, 0) AS BIGINT) AS total_ms FROM st LEFT JOIN (SELECT ws_id, sum(duration_ms) AS a FROM s WHERE end_ms > {CHECKPOINT} GROUP BY ws_id) j ON st.ws_id = j.ws_id")
def merge_journal(spark, sf_dir):
    late = tables.slices(_sessions(spark, sf_dir)).where(F.col("ts_ms") > CHECKPOINT)
    return aggregates.merge_journal(_state(spark, sf_dir).select("ws_id", "total_ms"), late)


_TODAY = AS_OF - AS_OF % DAY_MS


@query(f"SELECT o.ws_id, CAST(coalesce(c, 0) + CASE WHEN current_start_ms >= {_TODAY} AND current_start_ms < {_TODAY + DAY_MS} THEN {AS_OF} - current_start_ms ELSE 0 END AS BIGINT) AS today_ms FROM o LEFT JOIN (SELECT ws_id, sum(duration_ms) AS c FROM s WHERE start_ms >= {_TODAY} AND start_ms < {_TODAY + DAY_MS} GROUP BY ws_id) t ON o.ws_id = t.ws_id")
def today_ms(spark, sf_dir):
    open_ = tables.open_sessions(_sessions(spark, sf_dir))
    return aggregates.today_ms(_sessions(spark, sf_dir, since_ms=_TODAY, until_ms=_TODAY + DAY_MS), open_, AS_OF)


@query(f"SELECT {_day('start_ms')} AS date, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS session_count FROM s GROUP BY 1")
def daily_stats(spark, sf_dir):
    return aggregates.daily_stats(_sessions(spark, sf_dir))


@query(f"SELECT ws_id, {_day('start_ms')} AS date, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS session_count FROM s GROUP BY 1, 2")
def daily_stats_by_workspace(spark, sf_dir):
    return aggregates.daily_stats(_sessions(spark, sf_dir), ["ws_id"])


@query("SELECT strftime(date_trunc('week', make_timestamp(start_ms * 1000)), '%Y-%m-%d') AS week_start, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS session_count FROM s GROUP BY 1")
def weekly_stats(spark, sf_dir):
    return aggregates.weekly_stats(_sessions(spark, sf_dir))


#: A session of all workspaces together that has been open since the evening before.
_OPEN = 14 * 3_600_000
_SEVEN = f"""c AS (SELECT {_TODAY} - i * {DAY_MS} AS at_ms FROM range(7) t(i)),
seven AS (SELECT at_ms, strftime(make_timestamp(at_ms * 1000), '%m-%d') AS label, {WEEKDAYS}[dayofweek(make_timestamp(at_ms * 1000)) + 1] AS weekday,
CAST(coalesce((SELECT sum(duration_ms) FROM s WHERE start_ms >= at_ms AND start_ms < at_ms + {DAY_MS}), 0) + CASE WHEN at_ms = {_TODAY} THEN {_OPEN} ELSE 0 END AS BIGINT) AS total_ms FROM c)
"""


def _seven(spark, sf_dir) -> DataFrame:
    return aggregates.last_seven_days(_sessions(spark, sf_dir, since_ms=_TODAY - 6 * DAY_MS, until_ms=_TODAY + DAY_MS), AS_OF, _OPEN)


@query()
def last7days(spark, sf_dir):
    return _seven(spark, sf_dir)


@query()
def week_total(spark, sf_dir):
    return aggregates.week_total(_seven(spark, sf_dir))


@query()
def last7days_chart(spark, sf_dir):
    return aggregates.chart(_seven(spark, sf_dir))


_WITH_SEVEN = _WITH.rstrip() + ",\n" + _SEVEN
ORACLE["last7days"] = _WITH_SEVEN + "SELECT * FROM seven"
ORACLE["week_total"] = _WITH_SEVEN + "SELECT CAST(sum(total_ms) AS BIGINT) AS week_total_ms FROM seven"
ORACLE["last7days_chart"] = _WITH_SEVEN + "SELECT *, greatest(max(total_ms) OVER (), 1) AS scale_ms, bool_and(total_ms = 0) OVER () AS is_empty, greatest(total_ms / greatest(max(total_ms) OVER (), 1) * 100, 2.0) AS height_pct FROM seven"


@query("SELECT ws_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS session_count FROM s GROUP BY ws_id")
def workspace_totals(spark, sf_dir):
    return aggregates.workspace_totals(_sessions(spark, sf_dir))


@query("SELECT ws_id, name, total_ms, synced_at, first_seen FROM l")
def global_latest_sync(spark, sf_dir):
    return workspaces.latest_sync(_log(spark, sf_dir)).drop("uri")


@query("SELECT CAST(sum(total_ms) AS BIGINT) AS total_ms, count(*) AS workspace_count FROM l")
def global_snapshot(spark, sf_dir):
    return workspaces.snapshot(_log(spark, sf_dir))


@query("SELECT ws_id, name, total_ms FROM l")
def workspace_rank(spark, sf_dir):
    return workspaces.ranking(_log(spark, sf_dir))


@query(f"SELECT * FROM (SELECT ws_id, name, total_ms, CAST(row_number() OVER (ORDER BY total_ms DESC, first_seen, ws_id) AS INTEGER) AS place FROM l) WHERE place <= {TOP}")
def workspace_top(spark, sf_dir):
    return workspaces.top(_log(spark, sf_dir), TOP)


@query("SELECT count(*) > 1 AS list_shown FROM l")
def workspace_list_shown(spark, sf_dir):
    return workspaces.list_shown(_log(spark, sf_dir))


@query("SELECT event_id, regexp_replace(lower(upper('file:///WS/') || user_id || repeat('/', CAST(event_id % 4 AS BIGINT))), '/+$', '') AS ws_id FROM events")
def normalize_workspace_id(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    uri = F.concat(F.lit("FILE:///WS/"), F.col("user_id").cast("string"), F.expr("repeat('/', cast(event_id % 4 as int))"))
    return events.select("event_id", workspace_id(uri).alias("ws_id"))


_LAST = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY ws_id ORDER BY {o}) AS r, count(*) OVER (PARTITION BY ws_id) AS n FROM s) WHERE r <= {n}"


@query(_LAST.format(c="ws_id, start_ms, end_ms, duration_ms", o="start_ms DESC, end_ms DESC, duration_ms DESC", n=KEEP))
def trim_sessions(spark, sf_dir):
    return retention.trim(_sessions(spark, sf_dir), KEEP)


@query(_LAST.format(c="ws_id, end_ms AS ts_ms, duration_ms AS delta_ms", o="end_ms DESC, duration_ms DESC", n=PEEK))
def peek_last(spark, sf_dir):
    return retention.peek_last(tables.slices(_sessions(spark, sf_dir)), PEEK)


@query(_LAST.format(c=f"ws_id, end_ms AS ts_ms, duration_ms AS delta_ms, greatest(n - {RING}, 0) AS overwritten", o="end_ms DESC, duration_ms DESC", n=RING))
def ring_retain(spark, sf_dir):
    return retention.ring(tables.slices(_sessions(spark, sf_dir)), RING)


_ELAPSED = f"CASE WHEN current_start_ms > 0 THEN {AS_OF} - current_start_ms ELSE 0 END"


@query(f"SELECT ws_id, total_ms, CAST({_ELAPSED} AS BIGINT) AS session_elapsed_ms, CAST(total_ms + {_ELAPSED} AS BIGINT) AS current_total_ms FROM st")
def timer_snapshot(spark, sf_dir):
    return timer.snapshot(_state(spark, sf_dir), AS_OF)


@query(f"SELECT ws_id, CAST(total_ms + {_ELAPSED} AS BIGINT) AS total_ms, current_start_ms, {AS_OF} AS last_saved_ms FROM st")
def timer_checkpoint(spark, sf_dir):
    return timer.checkpoint(_state(spark, sf_dir), AS_OF)


@query()
def dashboard_row(spark, sf_dir):
    return dashboard.dashboard(_sessions(spark, sf_dir), _state(spark, sf_dir), _log(spark, sf_dir), ONE, AS_OF)


ORACLE["dashboard_row"] = (
    _WITH
    + f"""SELECT st.ws_id, CAST(total_ms + {_ELAPSED} AS BIGINT) AS total_ms,
CAST((SELECT coalesce(sum(duration_ms), 0) FROM s WHERE ws_id = '{ONE}' AND start_ms >= {_TODAY} AND start_ms < {_TODAY + DAY_MS}) + CASE WHEN current_start_ms >= {_TODAY} AND current_start_ms < {_TODAY + DAY_MS} THEN {AS_OF} - current_start_ms ELSE 0 END AS BIGINT) AS today_ms,
(SELECT count(*) FROM s WHERE ws_id = '{ONE}') AS sessions_count,
CAST((SELECT coalesce(sum(duration_ms), 0) FROM s WHERE ws_id = '{ONE}' AND start_ms >= {_TODAY - 6 * DAY_MS} AND start_ms < {_TODAY + DAY_MS}) + {_ELAPSED} AS BIGINT) AS week_total_ms,
CAST((SELECT sum(total_ms) FROM l) AS BIGINT) AS global_total_ms, (SELECT count(*) FROM l) AS workspace_count, 'enabled' AS state,
true AS status_bar_enabled, true AS journal_enabled, true AS backup_to_file, 1024 AS ring_buffer_capacity, 10000 AS journal_flush_interval_ms, 60000 AS full_save_interval_ms, 1000 AS max_sessions
FROM st WHERE st.ws_id = '{ONE}'"""
)

_GUARD = f"CASE WHEN current_start_ms > 0 AND {AS_OF} - current_start_ms > 0 AND {AS_OF} - current_start_ms < {DAY_MS} THEN {AS_OF} - current_start_ms ELSE 0 END"
_JOURNAL = f"LEFT JOIN (SELECT ws_id, sum(duration_ms) AS j FROM s WHERE end_ms > {CHECKPOINT} - 3600000 {{more}} GROUP BY ws_id) j ON st.ws_id = j.ws_id"


def _journal(spark, sf_dir) -> DataFrame:
    """Slices since an hour before the checkpoint."""
    return tables.slices(_sessions(spark, sf_dir)).where(F.col("ts_ms") > CHECKPOINT - 3_600_000)


@query(f"SELECT st.ws_id, CAST(total_ms + coalesce(j, 0) + {_GUARD} AS BIGINT) AS total_ms FROM st " + _JOURNAL.format(more=""))
def recover_total_ref(spark, sf_dir):
    return timer.recover(_state(spark, sf_dir), _journal(spark, sf_dir), AS_OF)


@query("SELECT st.ws_id, CAST(total_ms + coalesce(j, 0) AS BIGINT) AS total_ms FROM st " + _JOURNAL.format(more=f"AND end_ms > {CHECKPOINT}"))
def recover_total_exact(spark, sf_dir):
    return timer.recover_exact(_state(spark, sf_dir), _journal(spark, sf_dir))


_MARK = "CASE WHEN event_id % 3 = 0 THEN 'stop' ELSE 'start' END"


@query(f"""SELECT ws_id, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM (SELECT ws_id, at_ms AS start_ms, kind, lead(at_ms) OVER (PARTITION BY ws_id ORDER BY at_ms, kind DESC) AS end_ms FROM
(SELECT 'file:///ws/' || user_id AS ws_id, epoch_us(ts) // 1000 AS at_ms, {_MARK} AS kind, lag({_MARK}, 1, 'stop') OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, {_MARK} DESC) AS b FROM events) WHERE kind <> b) WHERE kind = 'start' AND end_ms IS NOT NULL""")
def session_pairs(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_id") % 3 == 0, "stop").otherwise("start"))
    return timer.pairs(rows.select(F.concat(F.lit("file:///ws/"), F.col("user_id").cast("string")).alias("ws_id"), tables.to_ms("ts").alias("at_ms"), "kind"))


@query(f"SELECT ws_id, CAST(sum(CASE WHEN start_ms >= {PERIOD} + user_id % 7 * {DAY_MS} THEN duration_ms ELSE 0 END) AS BIGINT) AS total_ms, CAST(sum(duration_ms) AS BIGINT) AS history_ms, count(*) AS session_count FROM s GROUP BY ws_id")
def period_totals(spark, sf_dir):
    users = tables.read(spark, sf_dir, "events").select("user_id").distinct()
    periods = users.select(F.concat(F.lit("file:///ws/"), F.col("user_id").cast("string")).alias("ws_id"), (F.lit(PERIOD) + F.col("user_id") % 7 * DAY_MS).alias("period_start_ms"))
    return timer.period_totals(_sessions(spark, sf_dir), periods)


def _lines(spark, sf_dir) -> DataFrame:
    """A journal line of each event, some broken in one of several ways."""
    events = tables.read(spark, sf_dir, "events")
    t, d = tables.to_ms("ts").cast("string"), F.round(F.col("value") * 1000).cast("long").cast("string")
    good = F.concat(F.lit('{"t":'), t, F.lit(',"d":'), d, F.lit("}"))
    kind = F.col("event_id") % 10
    line = F.when(kind == 0, F.concat(good, F.lit(" junk"))).when(kind == 1, F.replace(good, F.lit('"'), F.lit("'"))).when(kind == 2, F.concat(F.lit("  "), good, F.lit(" "))).when(kind == 3, F.lit("")).when(kind == 4, F.concat(F.lit('{"t":"'), t, F.lit('","d":'), d, F.lit("}"))).when(kind == 5, F.concat(F.lit('{"t":NaN,"d":'), d, F.lit("}"))).when(kind == 6, F.concat(F.lit("["), good, F.lit("]"))).when(kind == 7, F.replace(good, F.lit("}"), F.lit(',"x":[1,{}]}'))).otherwise(good)
    return events.select("event_id", line.alias("value"))


@query("SELECT event_id, CAST(start_ms AS DOUBLE) AS ts_ms, CAST(duration_ms AS DOUBLE) AS delta_ms FROM s WHERE event_id % 10 IN (2, 7, 8, 9)")
def journal_parse(spark, sf_dir):
    return journal.parse(_lines(spark, sf_dir)).drop("value")


@query("""SELECT '{"t":' || end_ms || ',"d":' || duration_ms || '}' AS value FROM s""")
def journal_lines(spark, sf_dir):
    return journal.lines(tables.slices(_sessions(spark, sf_dir)))


@query("SELECT ws_id, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN sum(duration_ms) ELSE count(*) END::BIGINT AS total_ms, CASE WHEN user_id % 3 = 1 THEN 0 WHEN user_id % 3 = 2 THEN 1 ELSE 2 END AS source FROM s GROUP BY ws_id, user_id")
def storage_fallback(spark, sf_dir):
    """The first place has one workspace in three, the second has two, the last has an empty state for all."""
    rows = _sessions(spark, sf_dir)
    number = F.regexp_extract("ws_id", "([0-9]+)$", 1).cast("long") % 3
    first = rows.where(number == 1).groupBy("ws_id").agg(F.sum("duration_ms").cast("long").alias("total_ms"))
    second = rows.where(number != 0).groupBy("ws_id").agg(F.count(F.lit(1)).alias("total_ms"))
    fresh = rows.select("ws_id").distinct().withColumn("total_ms", F.lit(0).cast("long"))
    return state.fallback([first, second, fresh])


_FLUSH = "(SELECT event_id, event_id % 1025 AS n, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1024 END AS capacity, event_id * 37 % 20001 AS elapsed FROM events)"


@query(f"SELECT event_id, n > 0 AND elapsed >= 10000 AS by_time, CASE WHEN capacity > 0 THEN n / capacity >= 0.5 ELSE false END AS by_size, (n > 0 AND elapsed >= 10000) OR CASE WHEN capacity > 0 THEN n / capacity >= 0.5 ELSE false END AS by_either FROM {_FLUSH}")
def flush_decision(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1025).alias("n"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(1024).alias("capacity"), (F.col("event_id") * 37 % 20001).alias("elapsed"))
    n, capacity, elapsed = F.col("n"), F.col("capacity"), F.col("elapsed")
    return rows.select("event_id", flags.due_by_time(n, elapsed).alias("by_time"), flags.due_by_size(n, capacity).alias("by_size"), flags.due(n, capacity, elapsed).alias("by_either"))


@query("SELECT event_id, NOT (event_id % 3 = 0) AND (event_id % 2 = 0) AS counts, CASE WHEN event_id % 3 = 0 THEN 'globally-disabled' WHEN NOT (event_id % 2 = 0) THEN 'workspace-disabled' ELSE 'enabled' END AS state, CASE WHEN event_id % 3 = 0 THEN '{globally-disabled}' WHEN NOT (event_id % 2 = 0) THEN '{workspace-disabled}' ELSE '{enabled}' END AS badge FROM events".format_map(fmt.BADGES))
def disable_state(spark, sf_dir):
    enabled, off = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    now = flags.state(enabled, off)
    return tables.read(spark, sf_dir, "events").select("event_id", flags.should_count(enabled, off).alias("counts"), now.alias("state"), fmt.badge(now).alias("badge"))


_MS = "duration_ms * 97"
_H, _M, _S = (f"CAST(floor({_MS} / 3600000) AS BIGINT)", f"(CAST(floor({_MS} / 60000) AS BIGINT) % 60)", f"(CAST(floor({_MS} / 1000) AS BIGINT) % 60)")


def _compact_sql(ms: str) -> str:
    h, m, s = f"CAST(floor(({ms}) / 3600000) AS BIGINT)", f"(CAST(floor(({ms}) / 60000) AS BIGINT) % 60)", f"(CAST(floor(({ms}) / 1000) AS BIGINT) % 60)"
    return f"CASE WHEN {h} > 0 THEN {h} || 'h ' || {m} || 'm' WHEN {m} > 0 THEN {m} || 'm ' || {s} || 's' ELSE {s} || 's' END"


@query(f"SELECT event_id, CASE WHEN {_H} > 0 THEN {_H} || 'h ' ELSE '' END || CASE WHEN {_M} > 0 THEN {_M} || 'm ' ELSE '' END || {_S} || 's' AS text FROM s")
def format_duration(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", fmt.duration(F.round(F.col("value") * 1000).cast("long") * 97).alias("text"))


@query(f"SELECT event_id, {_compact_sql(_MS)} AS text FROM s")
def format_compact(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", fmt.compact(F.round(F.col("value") * 1000).cast("long") * 97).alias("text"))


_DUAL = f"'{fmt.TODAY} ' || {_compact_sql('duration_ms')} || '{fmt.BETWEEN}{fmt.TOTAL} ' || {_compact_sql(_MS)}"
_SWAP = f"'{fmt.TOTAL} ' || {_compact_sql(_MS)} || '{fmt.BETWEEN}{fmt.TODAY} ' || {_compact_sql('duration_ms')}"


@query(f"SELECT event_id, {_DUAL} AS text FROM s")
def format_dual(spark, sf_dir):
    ms = F.round(F.col("value") * 1000).cast("long")
    return tables.read(spark, sf_dir, "events").select("event_id", fmt.dual(ms, ms * 97).alias("text"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '{fmt.ICON}' || CASE event_id % 3 WHEN 0 THEN {_DUAL} WHEN 1 THEN {_SWAP} ELSE {_compact_sql('duration_ms')} END END AS text, CASE event_id % 3 WHEN 0 THEN 'total-today' WHEN 1 THEN 'compact' ELSE 'today-total' END AS next_mode FROM s")
def status_bar_text(spark, sf_dir):
    ms = F.round(F.col("value") * 1000).cast("long")
    mode = F.element_at(F.array(*map(F.lit, fmt.MODES)), (F.col("event_id") % 3).cast("int") + 1)
    rows = tables.read(spark, sf_dir, "events")
    return rows.select("event_id", fmt.status_bar(mode, ms, ms * 97, F.col("event_id") % 5 != 0).alias("text"), fmt.next_mode(mode).alias("next_mode"))


_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0') || 'Z'"


@query(f"SELECT ws_id, {_ISO.format('start_ms')} AS session_start, {_ISO.format('end_ms')} AS session_end, duration_ms FROM s")
def csv_export_rows(spark, sf_dir):
    return csv.rows(_sessions(spark, sf_dir))


@query(f"SELECT event_id, substr({_ISO.format('start_ms')}, 12, 12) AS clock FROM s")
def log_clock(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", F.substring(iso(tables.to_ms("ts")), 12, 12).alias("clock"))


@query("SELECT ws_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM s GROUP BY ws_id")
def stream_journal_replay(spark, sf_dir):
    """Slices go through a stream into a table (each batch once), which is then summed."""
    folder = shared_folder(spark, "replay")
    events = tables.read(spark, sf_dir, "events")
    stream = tables.slices(tables.sessions(streams.parquet_stream(spark, f"{sf_dir}/events.parquet", events.schema)))
    streams.to_table(stream, f"{folder}/slices", f"{folder}/checkpoint", once=True).awaitTermination()
    return aggregates.sum_slices(spark.read.schema(tables.SLICE).parquet(f"{folder}/slices"), ["ws_id"])


@query(f"""SELECT ws_id, {_day('day')} AS date, CAST(sum(least(end_ms, day + {DAY_MS}) - greatest(start_ms, day)) AS BIGINT) AS total_ms, count(*) AS session_count FROM
(SELECT ws_id, start_ms, end_ms, unnest(range(start_ms - start_ms % {DAY_MS}, greatest(start_ms, end_ms - 1) + 1, {DAY_MS})) AS day FROM s) GROUP BY 1, 2""")
def daily_stats_split(spark, sf_dir):
    """An extension: days with sessions cut at midnight."""
    return aggregates.daily_stats(aggregates.split_midnight(_sessions(spark, sf_dir)), ["ws_id"])


def _payloads(spark, sf_dir) -> DataFrame:
    """A stored JSON state for each event, some invalid in one of several ways."""
    events = tables.read(spark, sf_dir, "events")
    start, ms = tables.to_ms("ts"), F.round(F.col("value") * 1000).cast("long")
    number = lambda c: c.cast("string")
    session = F.concat(F.lit('[{"startMs":'), number(start), F.lit(',"endMs":'), number(start + ms), F.lit(',"durationMs":'), number(ms), F.lit("}]"))
    good = F.concat(F.lit('{"version":1,"totalMs":'), number(ms), F.lit(',"lastSavedAtMs":'), number(start), F.lit(',"isEnabled":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"sessions":'), session, F.lit("}"))
    kind = F.col("event_id") % 6
    return events.select("event_id", F.when(kind == 0, F.replace(good, F.lit('"version":1,'), F.lit(""))).when(kind == 1, F.concat(F.lit("not json "), good)).when(kind == 2, F.regexp_replace(good, '"totalMs":([0-9]+)', '"totalMs":"$1"')).otherwise(good).alias("value"))


@query("SELECT event_id, 1::BIGINT AS version, duration_ms AS total_ms, 0::BIGINT AS current_start_ms, start_ms AS last_saved_ms, event_id % 2 = 0 AS is_enabled, 1 AS session_count, duration_ms AS sessions_ms FROM s WHERE event_id % 6 >= 3")
def state_decode(spark, sf_dir):
    rows = state.decode(_payloads(spark, sf_dir))
    total = F.aggregate("sessions", F.lit(0).cast("long"), lambda a, x: a + x["duration_ms"])
    return rows.select("event_id", "version", "total_ms", "current_start_ms", "last_saved_ms", "is_enabled", F.size("sessions").alias("session_count"), total.alias("sessions_ms"))


@query("SELECT ws_id, name, total_ms, synced_at FROM l")
def registry_round_trip(spark, sf_dir):
    """The latest totals of all workspaces, saved as one registry, read back."""
    registry = state.Registry(spark, shared_folder(spark, "registry"))
    registry.save(workspaces.latest_sync(_log(spark, sf_dir)), AS_OF)
    return registry.load().select("ws_id", "name", "total_ms", "synced_at")


@query(_LAST.format(c=f"ws_id, end_ms AS ts_ms, duration_ms AS delta_ms, greatest(n - {RING}, 0) AS overwritten", o="end_ms DESC, duration_ms DESC", n=RING))
def ring_stream(spark, sf_dir):
    """What the ring buffers of a stream hold after it."""
    folder = shared_folder(spark, "ring")
    events = tables.read(spark, sf_dir, "events")
    before = {k: spark.conf.get(k, None) for k in rings.SETTINGS}
    for k, v in rings.SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = tables.slices(tables.sessions(streams.parquet_stream(spark, f"{sf_dir}/events.parquet", events.schema)))
        streams.save_each(rings.ring_stream(stream, RING), lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint", once=True).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(rings.OUTPUT).parquet(f"{folder}/out")


@query(f"""SELECT i AS line_no, ['# Time export: ws 2', '# Generated: 2024-01-30T12:00:00.000Z', '# Total: ' || (SELECT CAST(sum(duration_ms) AS BIGINT) FROM s WHERE ws_id = '{ONE}') || 'ms', '', 'Session Start,Session End,Duration (ms)'][i + 1] AS line FROM range(5) t(i)
UNION ALL SELECT 4 + row_number() OVER (ORDER BY start_ms, end_ms, duration_ms), {_ISO.format('start_ms')} || ',' || {_ISO.format('end_ms')} || ',' || duration_ms FROM s WHERE ws_id = '{ONE}'""")
def csv_file(spark, sf_dir):
    """The lines of one workspace's file."""
    own = _sessions(spark, sf_dir).where(F.col("ws_id") == ONE)
    total = own.agg(F.sum("duration_ms")).first()[0] or 0  # one row
    text = csv.CsvExporter().export(own, "ws 2", total, AS_OF)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")


@query("SELECT event_id, greatest(0.0, least(1.0, CAST(event_id % 200 - 50 AS DOUBLE) / 100)) AS ratio FROM events")
def clamp_ratio(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", fmt.clamp((F.col("event_id") % 200 - 50).cast("double") / 100).alias("ratio"))


@query("SELECT event_id, replace(replace(replace('<b title=\"' || event_id || '\">R&D &lt; ' || event_id || '</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM events")
def escape_text(spark, sf_dir):
    raw = F.concat(F.lit('<b title="'), F.col("event_id").cast("string"), F.lit('">R&D &lt; '), F.col("event_id").cast("string"), F.lit("</b>"))
    return tables.read(spark, sf_dir, "events").select("event_id", text.escape_html(raw).alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id || ' of ' || user_id || ': ' || event_id WHEN 1 THEN '{2} ' || user_id ELSE 'plain {x}' END AS text FROM events")
def fill_template(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events")
    template = F.element_at(F.array(F.lit("{0} of {1}: {0}"), F.lit("{2} {1}"), F.lit("plain {x}")), (F.col("event_id") % 3).cast("int") + 1)
    return rows.select("event_id", text.filled(template, F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string"))).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN 'zh-CN' ELSE 'en' END AS locale FROM events")
def locale_choice(spark, sf_dir):
    language = F.element_at(F.array(*map(F.lit, ["zh-cn", "zh", "en-US", "de"])), (F.col("event_id") % 4).cast("int") + 1)
    return tables.read(spark, sf_dir, "events").select("event_id", text.locale(language).alias("locale"))


@query("SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'warn' ELSE 'error' END AS level FROM events WHERE event_id % 4 >= 2")
def log_filter(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, text.LEVELS)), (F.col("event_id") % 4).cast("int") + 1)
    return tables.read(spark, sf_dir, "events").select("event_id", level.alias("level")).where(text.logged(F.col("level"), "warn"))


@query("SELECT CAST(sum(duration_ms) AS DOUBLE) AS total_ms, count(*) AS slices FROM s")
def flush_journal(spark, sf_dir):
    """All slices in three batches through a flusher that is replaced after the first; one batch comes twice."""
    folder = shared_folder(spark, "flush")
    rows = tables.slices(_sessions(spark, sf_dir)).select("ts_ms", "delta_ms", F.pmod(F.xxhash64("ws_id", "ts_ms"), F.lit(3)).alias("batch"))
    for i in (0, 1, 1, 2):
        flusher = streams.Flusher(spark, f"{folder}/waiting", f"{folder}/journal", flags.BySize(0.5), capacity=1024)
        flusher.push(rows.where(F.col("batch") == i).drop("batch"), i, i * 1000)
    flusher.flush_all(9_000)
    return journal.read(spark, f"{folder}/journal").agg(F.sum("delta_ms").alias("total_ms"), F.count(F.lit(1)).alias("slices"))


def _manager(spark, sf_dir, folder: str) -> lifecycle.SessionManager:
    """One workspace's manager, with its state at the checkpoint stored in the second of two places."""
    places = [state.JsonFile(spark, f"{folder}/{p}") for p in ("primary", "backup")]
    stored = _state(spark, sf_dir).where(F.col("ws_id") == ONE).select(F.lit(state.VERSION).cast("long").alias("version"), "total_ms", F.lit(0).cast("long").alias("current_start_ms"), "last_saved_ms", F.lit(True).alias("is_enabled"), F.expr("cast(array() as array<struct<start_ms:long,end_ms:long,duration_ms:long>>)").alias("sessions"), F.lit(None).cast("map<string,string>").alias("metadata"))
    places[1].save(stored)
    flusher = streams.Flusher(spark, f"{folder}/waiting", f"{folder}/journal")
    late = tables.slices(_sessions(spark, sf_dir)).where((F.col("ws_id") == ONE) & (F.col("ts_ms") > CHECKPOINT))
    flusher.take(late.select("ts_ms", "delta_ms"), CHECKPOINT)
    flusher.flush_all(CHECKPOINT)
    return lifecycle.SessionManager(spark, ONE, "ws 2", places, flusher, state.Registry(spark, f"{folder}/registry"))


_BASE = f"(SELECT CAST(coalesce(sum(duration_ms), 0) AS BIGINT) FROM s WHERE ws_id = '{ONE}')"


@query(f"SELECT {_BASE} AS base_ms, 90000::BIGINT AS elapsed_ms, {_BASE} + 90000 AS total_ms, 1::BIGINT AS session_count, 0::BIGINT AS journal_slices, {AS_OF + 90_000} AS saved_at, {_BASE} + 90000 AS registry_ms")
def session_life(spark, sf_dir):
    """A session recovers the stored total and its journal, starts, runs ninety seconds, ends, saves and empties the journal."""
    folder = shared_folder(spark, "life")
    manager = _manager(spark, sf_dir, folder)
    base = manager.start(AS_OF)
    manager.push(AS_OF + 1000, 1000)
    done = manager.end(AS_OF + 90_000)
    saved = state.load_first(spark, manager.providers).first()  # one row
    left = journal.read(spark, manager.flusher.path).count()
    row = (base, done.elapsed_ms, saved.total_ms, done.session_count, left, saved.last_saved_ms, manager.registry.load().first().total_ms)
    return spark.createDataFrame([row], "base_ms long, elapsed_ms long, total_ms long, session_count long, journal_slices long, saved_at long, registry_ms long")


@query(f"SELECT {_BASE} + 20000 AS total_ms, {AS_OF} AS current_start_ms, {AS_OF + 20_000} AS saved_at, 1::BIGINT AS journal_slices, {_BASE} + 20000 AS registry_ms, {AS_OF + 20_000} AS updated_at")
def save_now(spark, sf_dir):
    """Twenty seconds into a session: the journal is flushed since it is due, the state saved, the registry told; the session goes on."""
    folder = shared_folder(spark, "save")
    manager = _manager(spark, sf_dir, folder)
    manager.start(AS_OF)
    manager.push(AS_OF + 1000, 1000)
    manager.save_now(AS_OF + 20_000)
    saved = state.load_first(spark, manager.providers).first()  # one row
    row = (saved.total_ms, saved.current_start_ms, saved.last_saved_ms, journal.read(spark, manager.flusher.path).count(), manager.registry.load().first().total_ms, manager.registry.last_updated_ms())
    return spark.createDataFrame([row], "total_ms long, current_start_ms long, saved_at long, journal_slices long, registry_ms long, updated_at long")


@query()
def dashboard_record(spark, sf_dir):
    """The whole record; its lists as text."""
    row = dashboard.record(_sessions(spark, sf_dir), _state(spark, sf_dir), _log(spark, sf_dir), ONE, AS_OF)
    days = F.array_join(F.transform("daily_stats", lambda d: F.concat_ws(":", d["label"], d["weekday"], d["total_ms"].cast("string"))), ",")
    listed = F.array_join(F.transform("workspace_list", lambda w: F.concat_ws(":", w["name"], w["total_ms"].cast("string"))), ",")
    return row.withColumns({"daily_stats": days, "workspace_list": listed})


ORACLE["dashboard_record"] = ORACLE["dashboard_row"].replace(
    "AS max_sessions\nFROM st",
    f"""AS max_sessions, true AS is_enabled, false AS global_disabled,
(SELECT string_agg(strftime(make_timestamp(at_ms * 1000), '%m-%d') || ':' || {WEEKDAYS}[dayofweek(make_timestamp(at_ms * 1000)) + 1] || ':' || ms, ',' ORDER BY at_ms) FROM (SELECT at_ms,
 CAST(coalesce((SELECT sum(duration_ms) FROM s WHERE ws_id = '{ONE}' AND start_ms >= at_ms AND start_ms < at_ms + {DAY_MS}), 0) + CASE WHEN at_ms = {_TODAY} THEN (SELECT {_ELAPSED} FROM st WHERE ws_id = '{ONE}') ELSE 0 END AS BIGINT) AS ms FROM (SELECT {_TODAY} - i * {DAY_MS} AS at_ms FROM range(7) t(i)))) AS daily_stats,
(SELECT string_agg(name || ':' || total_ms, ',' ORDER BY total_ms DESC, name) FROM (SELECT * FROM l ORDER BY total_ms DESC, name LIMIT 1000)) AS workspace_list
FROM st""",
)
