import random

from pyspark.sql import functions as F

from talewind.operators.session_store import SessionStore, batches, local_sessions
from talewind.spool import Spool


def brute(rows, gap):
    out, by = set(), {}
    for k, t, s in rows:
        by.setdefault(k, []).append((t, s))
    for k, v in by.items():
        v.sort()
        cur = [v[0]]
        for a, b in zip(v, v[1:]):
            if b[0] - a[0] > gap * 1_000_000:
                out.add((k, cur[0][0], cur[-1][0], min(s for _, s in cur), max(s for _, s in cur), len(cur)))
                cur = []
            cur.append(b)
        out.add((k, cur[0][0], cur[-1][0], min(s for _, s in cur), max(s for _, s in cur), len(cur)))
    return out


def test_batches_in_any_order_give_the_same_table(spark):
    rng = random.Random(5)
    t0 = 1_400_000_000_000_000
    rows = [(rng.choice("aaab"), t0 + rng.randrange(40 * 86_400) // 200 * 200 * 1_000_000, i) for i in range(900)]
    rows += [("edge", t0, 5000), ("edge", t0 + 300_000_000, 5001), ("edge", t0 + 600_000_001, 5002), ("edge", t0 + 600_000_001, 5003)]
    rows += [("long", t0 + i * 250_000_000, 6000 + i) for i in range(3000)]  # one session across buckets and slots
    rng.shuffle(rows)
    sp = Spool(spark, "test")
    store = SessionStore(sp, 300, slot_s=3 * 86_400)
    for i in range(3):
        df = spark.createDataFrame(rows[i::3], "key string, ts_us long, seq long")
        store.ingest(local_sessions(df, ["key"], 300))
    again = SessionStore(sp, 300, slot_s=3 * 86_400)  # opened from the manifest alone
    assert {tuple(r) for r in again.read().select("key", "start_us", "end_us", "min_seq", "max_seq", "n_events").collect()} == brute(rows, 300)
    assert again.version == 3


def test_nothing_is_committed_for_an_empty_batch(spark, spool):
    store = SessionStore(spool)
    store.ingest(local_sessions(spark.createDataFrame([], "key string, ts_us long, seq long"), ["key"], 300))
    assert store.version == 0 and store.read().count() == 0


def test_batches_hold_every_row_once(spark):
    df = spark.range(50).withColumn("b", F.when(F.col("id") % 9 > 0, F.col("id") % 7))
    parts = batches(df, "b", 3)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(50))
    assert len(batches(df.filter("id < 0"), "b", 3)) == 1
