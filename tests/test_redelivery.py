import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from talewind.operators.redelivery import SeenMessages, identified
from talewind.operators.session_store import batches
from talewind.spool import Spool
from tests.test_components import roots

SCHEMA = "seq long, event_uuid string, host string, channel string, event_source_id string, timestamp timestamp, batch_id long"


def run(spark, spool, rows, rounds):
    seen = SeenMessages(Spool(spark, "test"))
    for b in batches(spark.createDataFrame(rows, SCHEMA), "batch_id", rounds):
        seen.ingest(identified(b))
    return {(r.dup_seq, r.kept_seq) for r in seen.copies().collect()}, seen


def brute(rows):
    first, edges = {}, []
    for seq, u, h, c, n, t, _ in rows:
        keys = []
        u = "".join(x for x in (u or "").lower() if x in "0123456789abcdef")
        if len(u) == 32 and set(u) != {"0"}:
            keys.append(u)
        h = (h or "").strip().split(".")[0].strip().lower()
        n = (n or "").strip()
        if h and c is not None and n.isdigit() and t is not None:
            keys.append((h, c, int(n), t))
        for k in keys:
            if k in first:
                edges.append((first[k], seq))
            else:
                first[k] = seq
    return roots(edges)


def test_random_streams_against_union_find(spark, spool):
    rng, t0 = random.Random(8), datetime(2020, 1, 1)
    rows = []
    for i in range(600):
        if rows and rng.random() < 0.3:
            _, u, h, c, n, t, _ = rng.choice(rows)
            what = rng.random()
            u = None if what < 0.2 else (u or "").upper().replace("-", "") or None
            n = None if 0.2 < what < 0.4 else n and f" 00{n}"
            h = h and f" {h.upper()}.corp "
        else:
            u, h, c = f"{rng.getrandbits(128):032x}", rng.choice(["a", "b", None]), rng.choice(["s", "t", None])
            u = f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}" if rng.random() < 0.9 else rng.choice([None, "", "0" * 32, "n/a"])
            n, t = rng.choice([str(rng.randrange(6000)), "x9", None]), t0 + timedelta(seconds=rng.randrange(40))
        rows.append((i, u, h, c, n, t, i // 100))
    want = brute(rows)
    assert want
    for rounds in (1, 4):
        got, _ = run(spark, spool, rows, rounds)
        assert got == want


def test_seen_ranges_stay_disjoint_and_maximal(spark, spool):
    rows = [(i, f"{i + 1:032x}", "h", "c", str(n), datetime(2020, 1, 1), b) for i, (n, b) in enumerate([(1, 0), (2, 0), (5, 0), (3, 1), (4, 1), (9000, 1)])]
    got, seen = run(spark, spool, rows, 2)
    assert got == set()
    assert {(r.lo, r.hi) for x in seen.ranges().collect() for r in x.ranges} == {(1, 5), (9000, 9000)}


def test_one_message_delivered_very_often(spark, spool):
    rows = [(i, "a" * 32, "h", "c", "7", datetime(2020, 1, 1), i % 3) for i in range(500)]
    got, _ = run(spark, spool, rows, 2)
    assert got == {(i, 0) for i in range(1, 500)}


def test_empty(spark, spool):
    assert run(spark, spool, [], 2)[0] == set()


def test_smaller_seq_comes_in_a_later_batch(spark, spool):
    t = datetime(2020, 1, 1)
    rows = [(3, "a" * 32, None, None, None, t, 0), (5, "a" * 32, None, None, None, t, 0), (1, "a" * 32, None, None, None, t, 1), (2, "a" * 32, None, None, None, t, 1)]  # by uuid
    rows += [(14, None, "h", "c", "7", t, 0), (13, None, "h", "c", "7", t, 0), (11, None, "h", "c", "7", t, 1)]  # by number, inside a seen range
    rows += [(22, "b" * 32, "h", "c", "x", t, None), (21, "b" * 32, "h", "c", "y", t, 1)]  # the late copy has no batch number
    assert run(spark, spool, rows, 2)[0] == {(2, 1), (3, 1), (5, 1), (13, 11), (14, 11), (22, 21)}


def test_batches_in_any_order_against_union_find(spark, spool):
    rng, t = random.Random(3), datetime(2020, 1, 1)
    rows = [(i, f"{rng.randrange(1, 150):032x}" if rng.random() < 0.6 else None, "h", "c", str(rng.randrange(150)), t, rng.choice([0, 1, 2, 3, None])) for i in range(300)]
    assert run(spark, spool, rows, 4)[0] == brute(rows)


def test_replayed_batch(spark, spool):
    b = identified(spark.createDataFrame([(4, "a" * 32, "h", "c", "7", datetime(2020, 1, 1), 0), (6, "a" * 32, "h", "c", "8", datetime(2020, 1, 1), 0)], SCHEMA))
    seen = SeenMessages(spool)
    seen.ingest(b)
    seen.ingest(b)
    assert {(r.dup_seq, r.kept_seq) for r in seen.copies().collect()} == {(6, 4)}
