"""Sessions on storage, what breaks off half-way, and what runs when."""

import logging

import pytest

from tidemark import storage
from tidemark.config import Config
from tidemark.functions import text
from tidemark.operators.flags import ByTime
from tidemark.sources import csv, journal, state, tables
from tidemark.storage import shared_folder
from tidemark.streaming import journal as streams
from tidemark.streaming.lifecycle import Scheduler, SessionManager

DAY = 86_400_000
NOON = 1_706_616_000_000


def slices(spark, *at):
    return spark.createDataFrame([(t, 1000) for t in at], "ts_ms long, delta_ms long")


def read(spark, folder):
    return sorted(r.ts_ms for r in journal.read(spark, f"{folder}/journal").collect())


def test_a_flusher_goes_on_where_another_was_killed(spark):
    folder = shared_folder(spark, "test")
    make = lambda: streams.Flusher(spark, f"{folder}/wait", f"{folder}/journal", ByTime(10))
    first = make()
    assert first.push(slices(spark, 1, 2), 0, 0) == 0 and first.push(slices(spark, 3), 1, 5) == 0
    second = make()
    assert second.waiting == 3
    assert second.push(slices(spark, 3), 1, 6) == 0 and second.waiting == 3  # the batch comes again
    assert second.push(slices(spark, 4), 2, 10) == 4 and read(spark, folder) == [1, 2, 3, 4]
    assert second.push(slices(spark, 4), 2, 30) == 0 and make().flush_all(40) == 0
    assert read(spark, folder) == [1, 2, 3, 4]


@pytest.mark.parametrize("after", ["intent", "written"])
def test_a_flush_that_breaks_off_is_done_again(after, spark, monkeypatch):
    folder = shared_folder(spark, "test")
    flusher = streams.Flusher(spark, f"{folder}/wait", f"{folder}/journal")
    flusher.push(slices(spark, 1, 2), 0, 0)

    def fail(*_):
        raise OSError("killed")

    with monkeypatch.context() as broken:
        if after == "intent":
            broken.setattr(journal, "replace", fail)
        else:
            save = flusher.manifest.save
            broken.setattr(flusher.manifest, "save", lambda r: save(r) if r["flushing"] is not None else fail())
        with pytest.raises(OSError):
            flusher.flush_all(1)
    again = streams.Flusher(spark, f"{folder}/wait", f"{folder}/journal")
    assert again.waiting == 0 and read(spark, folder) == [1, 2]
    assert again.flush_all(2) == 0 and again.push(slices(spark, 9), 1, 20_000) == 1 and read(spark, folder) == [1, 2, 9]


def test_a_document_is_replaced_as_a_whole(spark):
    document = storage.Document(spark, f"{shared_folder(spark, 'test')}/d")
    assert document.read() is None
    for words in ("one", "zwei\nü", ""):
        document.write(words)
        assert document.read() == words and len(document._versions()) == 1
    other = storage.Document(spark, document.path)
    versions = document._versions()
    document._versions = lambda: versions
    other.write("other")
    with pytest.raises(OSError):
        document.write("late")
    assert other.read() == "other"


def manager(spark, folder, **how):
    places = [state.JsonFile(spark, f"{folder}/{p}") for p in ("primary", "backup")]
    flusher = streams.Flusher(spark, f"{folder}/wait", f"{folder}/journal", ByTime(10_000))
    return SessionManager(spark, "w", "W", places, flusher, state.Registry(spark, f"{folder}/registry"), **how)


@pytest.mark.parametrize("exact,total", [(False, 5_000 + 2_000 + 9_000), (True, 5_000 + 1_000)])
def test_recovery_after_a_crash(exact, total, spark):
    folder = shared_folder(spark, "test")
    one = manager(spark, folder)
    assert one.start(NOON) == 0 and one.start(NOON + 1) == 0
    one.push(NOON + 4_000, 1000)
    one.checkpoint(NOON + 5_000)
    one.push(NOON + 6_000, 1000)
    one.try_flush(NOON + 6_000)
    one.flusher.flush_all(NOON + 6_000)
    two = manager(spark, folder, exact=exact)  # the first was killed
    assert two.recover(NOON + 9_000) == total
    assert read(spark, folder) == [] and two.recover(NOON + 10_000) == total


def test_a_session_ends_once_and_keeps_its_last_sessions(spark):
    folder = shared_folder(spark, "test")
    one = manager(spark, folder, config=Config(max_sessions=2))
    assert one.end(NOON).elapsed_ms == 0
    for i in range(3):
        one.start(NOON + i * 100)
        done = one.end(NOON + i * 100 + 10)
        assert done.elapsed_ms == 10 and done.total_ms == 10 * (i + 1)
    assert one.end(NOON + 999).elapsed_ms == 0
    saved = state.load_first(spark, one.providers).first()
    assert [s.start_ms for s in saved.sessions] == [NOON + 100, NOON + 200] and saved.total_ms == 30
    one.start(NOON + 1000)
    one.new_period(NOON + 1010)
    assert one.active and one.registry.load().first().total_ms == 0 and one.timer.sessions
    assert one.delete_all() == [True, True, True] and not one.providers[0].is_available()


def test_the_journal_stays_until_a_save_succeeds(spark):
    folder = shared_folder(spark, "test")
    one = manager(spark, folder)
    one.start(NOON)
    one.push(NOON + 1, 1000)
    for p in one.providers:
        p.save = lambda state: (_ for _ in ()).throw(OSError("full"))
    one.end(NOON + 50)
    assert read(spark, folder) == [NOON + 1]


def test_cadences(spark):
    folder = shared_folder(spark, "test")
    one, ticks = manager(spark, folder), []
    one.start(NOON)
    scheduler = Scheduler(one, lambda total, today: ticks.append((total, today)), beat_ms=20_000)
    assert scheduler.run_due(NOON) == []
    scheduler.start(NOON)
    ran = []
    one.checkpoint = lambda now: (_ for _ in ()).throw(OSError("full"))  # logged; nothing else stops
    clock = iter([NOON + s * 1000 for s in (5, 10, 20, 30, 60)])
    due = scheduler.run_due
    scheduler.run_due = lambda now: ran.append((now - NOON, due(now)))
    scheduler.run(lambda: next(clock, None))
    assert ran == [(5_000, []), (10_000, ["flush"]), (20_000, ["beat", "flush"]), (30_000, ["flush"]), (60_000, ["beat", "flush", "save"])]
    assert ticks == [(20_000, 20_000), (60_000, 60_000)]
    assert one.flusher.waiting + len(read(spark, folder)) == 2


def test_a_registry_that_is_broken_counts_as_empty(spark):
    registry = state.Registry(spark, f"{shared_folder(spark, 'test')}/r")
    assert registry.load().count() == 0 and registry.last_updated_ms() == 0
    registry.sync("a", "A", "u", 5, 7)
    registry.sync("b", "B", "u", 6, 8)
    registry.sync("a", "A", "u", 9, 9)
    assert sorted((r.ws_id, r.total_ms, r.synced_at) for r in registry.load().collect()) == [("a", 9, 9), ("b", 6, 8)]
    assert registry.last_updated_ms() == 9 and registry.available
    for bad, available in (('{"version": "1", "workspaces": {}}', True), ("[]", True), ("{", False)):
        registry.document.write(bad)
        assert registry.load().count() == 0 and registry.available == available
    registry.delete()
    assert registry.document.read() is None


def test_small_parts(spark, monkeypatch):
    text.set_level("warn")
    assert not logging.getLogger("tidemark.sources").isEnabledFor(logging.INFO)
    text.set_level("debug")
    rows = spark.createDataFrame([("w", i, i, 0) for i in range(3)], tables.SESSION)
    with pytest.raises(ValueError):
        csv.CsvExporter(most=2).export(rows, "w", 0, 0)
    folders = []
    with storage.temporary(spark):
        folders += [shared_folder(spark, "test") for _ in range(2)]
        assert all(storage.exists(spark, f) for f in folders)
    assert not any(storage.exists(spark, f) for f in folders)


def test_a_cluster_without_shared_storage_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Session, "test")
