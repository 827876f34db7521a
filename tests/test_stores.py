"""Stores that outlive the process: reopened, replayed, and left alone between writing and committing."""

from datetime import datetime

import pytest

from talewind.operators import session_store
from talewind.operators.redelivery import SeenMessages, identified
from talewind.operators.session_store import SessionStore, Taken, local_sessions
from talewind.spool import Home, Spool, shared_dir
from talewind.streaming.telemetry import each_batch
from tests.test_redelivery import SCHEMA

T0 = 1_400_000_000_000_000


def local(spark, *rows):
    return local_sessions(spark.createDataFrame([(k, T0 + s * 1_000_000, q) for k, s, q in rows], "key string, ts_us long, seq long"), ["key"], 300)


def table(store):
    return {(r.key, (r.start_us - T0) // 1_000_000, (r.end_us - T0) // 1_000_000, r.n_events) for r in store.read().collect()}


def test_sessions_are_reopened_and_a_replay_changes_nothing(spark, tmp_path):
    home = lambda: Home(spark, f"file://{tmp_path}/sessions")
    assert SessionStore(home()).ingest(local(spark, ("a", 0, 1), ("a", 10, 2), ("b", 0, 3)), 0)
    again = SessionStore(home())
    assert not again.ingest(local(spark, ("a", 0, 1), ("a", 10, 2), ("b", 0, 3)), 0) and again.version == 1
    assert again.ingest(local(spark, ("a", 310, 4)), 1)
    third = SessionStore(home())
    assert table(third) == {("a", 0, 310, 3), ("b", 0, 0, 1)}
    third.vacuum()
    assert table(SessionStore(home())) == {("a", 0, 310, 3), ("b", 0, 0, 1)}
    assert len([x for x in home().names() if x.startswith("manifest-")]) == 1


def test_sessions_of_a_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    home = Home(spark, f"file://{tmp_path}/sessions")
    SessionStore(home).ingest(local(spark, ("a", 0, 1)), 0)
    with monkeypatch.context() as m:
        m.setattr(session_store.Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            SessionStore(home).ingest(local(spark, ("a", 100, 2)), 1)
    store = SessionStore(home)
    assert table(store) == {("a", 0, 0, 1)}
    assert store.ingest(local(spark, ("a", 100, 2)), 1) and table(SessionStore(home)) == {("a", 0, 100, 2)}


def test_two_writers_of_one_version(spark, tmp_path):
    home = Home(spark, f"file://{tmp_path}/sessions")
    a, b = SessionStore(home), SessionStore(home)
    a.ingest(local(spark, ("a", 0, 1)), 0)
    with pytest.raises(RuntimeError):
        b.ingest(local(spark, ("b", 0, 1)), 1)
    assert table(SessionStore(home)) == {("a", 0, 0, 1)}


def message(seq, uuid, number):
    return (seq, uuid and f"{uuid:032x}", "h", "c", None if number is None else str(number), datetime(2020, 1, 1), 0)


def pairs(seen):
    return {(r.dup_seq, r.kept_seq) for r in seen.copies().collect()}


def test_messages_are_reopened_and_a_replay_changes_nothing(spark, tmp_path):
    home = lambda: Home(spark, f"file://{tmp_path}/seen")
    batch = lambda *rows: identified(spark.createDataFrame(list(rows), SCHEMA))
    one = batch(message(1, 1, 10), message(2, 2, None), message(3, None, 11))
    assert SeenMessages(home(), buckets=4).ingest(one, 0) and not SeenMessages(home()).ingest(one, 0)
    assert SeenMessages(home()).ingest(batch(message(4, 1, 12), message(5, None, 11), message(0, 2, 13)), 1)
    seen = SeenMessages(home())
    assert seen.buckets == 4 and pairs(seen) == {(4, 1), (5, 3), (2, 0)}
    assert {(r.lo, r.hi) for x in seen.ranges().collect() for r in x.ranges} == {(10, 13)}
    seen.compact()
    seen.vacuum()
    assert {len(v) for k, v in SeenMessages(home()).versions.state.items() if k != "buckets"} == {1}
    assert SeenMessages(home()).ingest(batch(message(6, 2, None), message(7, None, 10)), 2)
    assert pairs(SeenMessages(home())) == {(4, 1), (5, 3), (2, 0), (6, 0), (7, 1)}


def test_messages_of_a_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    home = Home(spark, f"file://{tmp_path}/seen")
    batch = lambda *rows: identified(spark.createDataFrame(list(rows), SCHEMA))
    SeenMessages(home).ingest(batch(message(1, 1, 10)), 0)
    with monkeypatch.context() as m:
        m.setattr(session_store.Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            SeenMessages(home).ingest(batch(message(2, 1, 11)), 1)
    assert pairs(SeenMessages(home)) == set()
    SeenMessages(home).ingest(batch(message(2, 1, 11)), 1)
    assert pairs(SeenMessages(home)) == {(2, 1)}


def test_batch_numbers_stay_ranges():
    taken = Taken()
    for i in (3, 1, 2, 7):
        taken = taken.and_(i)
    assert taken.ranges == [[1, 3], [7, 7]] and 2 in taken and 5 not in taken and taken.and_(None).ranges == taken.ranges


def test_a_stream_counts_every_batch_once(spark, tmp_path):
    spark.createDataFrame([("a", T0, 1), ("a", T0 + 5, 2)], "key string, ts_us long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in")
    home = Home(spark, f"file://{tmp_path}/sessions")
    take = lambda df, i: SessionStore(home).ingest(local_sessions(df, ["key"], 300), i)
    for checkpoint in ("one", "two"):  # a new checkpoint replays batch 0
        stream = spark.readStream.schema("key string, ts_us long, seq long").parquet(f"{tmp_path}/in")
        each_batch(stream, take, f"{tmp_path}/{checkpoint}").awaitTermination(120)
    assert [r.n_events for r in SessionStore(home).read().collect()] == [2]


def test_a_cluster_must_name_its_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()

        class sparkContext:
            master = "spark://head:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Sc:
                        @staticmethod
                        def getCheckpointDir():
                            class No:
                                @staticmethod
                                def isDefined():
                                    return False
                            return No
                    return Sc

    with pytest.raises(RuntimeError):
        shared_dir(Far)
    assert Spool(spark, "test").root


def test_hot_cells(spark):
    rows = [("h", T0 + (i % 7) * 100_000_000, i) for i in range(2000)] + [("h", T0 + 1_000_000_000, 5000), (None, T0, 1)]
    got = local_sessions(spark.createDataFrame(rows, "key string, ts_us long, seq long"), ["key"], 300).collect()
    assert {(r.key, r.n_events, r.min_seq, r.max_seq) for r in got} == {("h", 2000, 0, 1999), ("h", 1, 5000, 5000), (None, 1, 1, 1)}


def test_scratch_tables_go_when_they_are_no_longer_needed(spark):
    with Spool(spark, "test") as sp:
        first = sp.cut(spark.range(3))
        mark = sp.mark()
        second, third = sp.cut(spark.range(4)), sp.cut(spark.range(5))
        sp.drop_since(mark, third)
        assert (first.count(), third.count()) == (3, 5) and len(sp.names()) == 2
    assert sp.names() == [] and second is not None
