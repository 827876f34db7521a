import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talewind.llm import encoding, leakage, packing, repeats, splits
from talewind.spool import Spool

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# ---- splits
def test_groups_through_shared_names(spark, spool):
    rows = [(0, "a", None), (1, "b", "a"), (2, "c", "b"), (3, None, "z"), (4, None, None), (5, "z", None), (6, None, None)]
    got = {r.row_id: r.group_id for r in splits.related_groups(spark.createDataFrame(rows, "row_id long, x string, y string"), spool, ["x", "y"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 5: 3, 4: 4, 6: 6}
    assert splits.related_groups(spark.createDataFrame([], "row_id long, x string, y string"), spool, ["x", "y"]).count() == 0


def naive(sizes, shares):
    total = sum(s * n for s, n in sizes)
    lack, out = [total * x for x in shares], []
    for s, n in sizes:
        took = [0] * len(shares)
        for _ in range(n):
            i = max(range(len(shares)), key=lambda j: (round(lack[j], 6), -j))
            lack[i] -= s
            took[i] += 1
        out.append(took)
    return out


def test_runs_of_equal_groups_are_settled_like_one_by_one():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted({rng.randrange(1, 60): rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))}.items(), reverse=True)
        a, b = splits.assign(sizes, (0.8, 0.1, 0.1)), naive(sizes, (0.8, 0.1, 0.1))
        assert [sum(x) for x in a] == [n for _, n in sizes]
        load = lambda took: [sum(s * t[i] for (s, _), t in zip(sizes, took)) for i in range(3)]
        assert load(a) == load(b)


def test_splits_keep_groups_whole_and_meet_shares(spark, spool):
    rows = [(i, i // 40 if i < 400 else i) for i in range(1400)]
    got = splits.split_groups(spark.createDataFrame(rows, "row_id long, group_id long"), spool, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    n = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert len(got) == 1400 and all(len(s) == 1 for s in by.values()) and n == {"train": 1120, "validation": 140, "test": 140}
    empty = spark.createDataFrame([], "row_id long, group_id long")
    assert splits.split_groups(empty, spool, {"train": 1.0}).count() == 0


# ---- repeats
def brute_runs(rows, limit, gap_us):
    out, by = set(), {}
    for e, t, s, ev, pr in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append((t, s, ev, pr))
    for v in by.values():
        v.sort()
        runs = [[x] for x in v]

        def sim(a, b):
            if gap_us is not None and b[0][0] - a[-1][0] > gap_us:
                return -1
            if any(x[2] is None or x[3] is None for x in (*a, *b)):
                return -1
            return min(repeats.similarity((x[2], x[3]), (y[2], y[3])) for x in a for y in b)

        while True:
            best = max(((sim(a, b), -repeats.scatter(b[0][1]), -i) for i, (a, b) in enumerate(zip(runs, runs[1:]))), default=(-1, 0, 0))
            if best[0] < limit:
                break
            i = -best[2]
            runs[i : i + 2] = [runs[i] + runs[i + 1]]
        out |= {(min(x[1] for x in r), max(x[1] for x in r), len(r), r[0][0], r[-1][0]) for r in runs}
    return out


@pytest.mark.parametrize("limit,gap", [(1.0, None), (0.6, None), (0.6, 3)])
def test_runs_against_brute_force(spark, spool, limit, gap):
    rng = random.Random(int(limit * 10) + (gap or 0))
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None] + list(range(0, 900_000_000, 1_000_000))), i, rng.choice([1, 1, 1, 2, None]), rng.choice(["cmd.exe", "cmd.exe", "cmd64.exe", "zz", None])) for i in range(500)]
    rows += [("hot", 5_000_000 + i * 1_000_000, 10_000 + i, 1, "a") for i in range(700)]  # one run across all tasks
    df = spark.createDataFrame(rows, "entity string, ts_us long, step long, event_id int, program string").withColumn("n", F.lit(0))
    got = {(r.first_step, r.last_step, r.n, r.start_us, r.end_us) for r in repeats.collapse_runs(df, spool, limit, gap).collect()}
    assert got == brute_runs(rows, limit, None if gap is None else gap * 1_000_000)


def test_stretches_of_near_identical_events_over_batches_and_tasks(spark, spool):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rng = random.Random(1)
        rows = [("e", i * 1_000_000, i, rng.choice([1, 1, 2]), rng.choice(["cmd.exe", "cmd64.exe", "cmd.exe", "zz"][: 3 + (i % 97 == 0)])) for i in range(300)]
        df = spark.createDataFrame(rows, "entity string, ts_us long, step long, event_id int, program string")
        got = {(r.first_step, r.last_step, r.n, r.start_us, r.end_us) for r in repeats.collapse_runs(df, spool, 0.5).collect()}
        assert got == brute_runs(rows, 0.5, None)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_a_task_leaves_open_is_little_and_decides_alike():
    rng = random.Random(2)
    for trial in range(30):
        n = rng.randrange(2, 120)
        kinds = [frozenset([(rng.choice([1, 1, 2]), rng.choice(["cmd.exe", "cmd64.exe", "cmd6.exe"]))]) for _ in range(n)]
        lead, times = rng.sample(range(10_000), n), list(range(n))
        whole = repeats.agglomerate(kinds, times, list(times), lead, 0.5, None)
        at = rng.randrange(1, n)
        parts = [(0, at, False, True), (at, n, True, False)]
        runs = [[x + a for x in r] for a, b, lo, hi in parts for r in repeats.agglomerate(kinds[a:b], times[a:b], times[a:b], lead[a:b], 0.5, None, lo, hi)]
        again = repeats.agglomerate([frozenset().union(*(kinds[x] for x in r)) for r in runs], [times[r[0]] for r in runs], [times[r[-1]] for r in runs], [lead[r[0]] for r in runs], 0.5, None)
        assert [[x for i in g for x in runs[i]] for g in again] == whole
    n = 20_000  # every two neighbours equally similar
    kinds = [frozenset([(1, ("cmd.exe", "cmd64.exe")[i % 2])]) for i in range(n)]
    assert len(repeats.agglomerate(kinds, list(range(n)), list(range(n)), list(range(n)), 0.5, None, True, True)) < 40


def test_no_events(spark, spool):
    assert repeats.collapse_runs(spark.createDataFrame([], "entity string, ts_us long, step long, event_id int, program string"), spool).count() == 0


# ---- packing
def test_best_filling_is_the_best():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(0, 90)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.best_filling(counts, room)
        assert all(got[x] <= counts[x] for x in got)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_containers_hold_everything_once(spark, spool):
    rng = random.Random(6)
    items = [(i, rng.choice([None, 0, rng.randrange(1, 120), rng.randrange(1, 40), 100])) for i in range(1500)] + [(7, 33), (9000, 250), (9001, 300)]
    got = packing.pack(spark.createDataFrame(items, "item_id long, size long"), spool, 100).collect()
    load, whole = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r["size"]
        whole.setdefault(r.item_id, []).append((r.piece, r["size"]))
    total = sum(s or 0 for _, s in items)
    assert max(load.values()) <= 100 and sum(load.values()) == total
    assert sorted(whole[9000]) == [(0, 100), (1, 100), (2, 50)] and sorted(whole[9001]) == [(0, 100), (1, 100), (2, 100)]
    assert all(len(whole[k]) == 1 for k, s in items if s and s <= 100 and k != 7)
    assert len(load) <= -(-total // 100) + 2
    assert packing.pack(spark.createDataFrame([], "item_id long, size long"), spool, 100).count() == 0


# ---- leakage
def brute_leaks(docs, items, least):
    import regex

    ws = lambda t: regex.findall(r"[\p{L}\p{Nd}]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = ws(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        out |= {(d, i) for i, q in items for k in range(len(ws(q)) - least + 1) if tuple(ws(q)[k : k + least]) in grams}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["Alpha", "beta", "gämma", "Δέλτα", "e5", "ze"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 14)))) for i in range(12)] + [(50, None), (51, ""), (52, "beta ze beta"), (52, "e5 e5 e5 e5 e5")]
    docs = [(i, ", ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "BETA-ze_beta"), (103, "e5 " * 3000)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items, 3)
    for kw in ({}, {"shard_chars": 300, "item_pass": 5}):
        got = leakage.leaks(a, b, 3, **kw)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    left = {r.doc_id for r in leakage.without_leaks(a, leakage.leaks(a, b, 3)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert leakage.leaks(a.limit(0), b, 3).count() == 0 and leakage.leaks(a, b.limit(0), 3).count() == 0


def test_a_passage_in_very_many_texts_needs_little_memory():
    code = """
import resource
import pyarrow as pa
from talewind.llm.leakage import Items, Shard
passage = " ".join(f"w{i}" for i in range(30))
item = " ".join(f"v{i}" for i in range(200)) + f" {passage} " + " ".join(f"u{i}" for i in range(200))
got = Shard(pa.array([f"{i} a{i} {passage} c{i}" for i in range(50_000)], pa.large_string()), 12).match(Items.of([(5, item), (6, passage)]))
assert len(got) == 100_000 and set(got["longest"]) == {30} and set(got["item_word"]) == {0, 200}
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_000_000
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_any_slices_give_the_same_matches():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    shard = leakage.Shard(pa.array([text(rng.randrange(0, 80)) for _ in range(40)], pa.large_string()), 4)
    items = leakage.Items.of([(i, text(rng.randrange(0, 30))) for i in range(15)])
    whole = shard.match(items)
    rows = lambda d: sorted(map(tuple, d.to_numpy().tolist()))
    assert len(whole) and rows(whole) == rows(shard.match(items, queries=3, hits=7))


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five z")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "zero one two three four five six")], "item_id long, text string")
    r = leakage.leaks(docs, items, 3).collect()
    assert [tuple(x) for x in r] == [(1, 2, 5, 1, 2)]


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 3, 400)
    sa = leakage.suffix_array(code, 64)
    suffix = [tuple(code[i : i + 64]) for i in sa]
    assert suffix == sorted(suffix) and sorted(sa) == list(range(400))
    assert leakage.suffix_array(np.array([5]), 8).tolist() == [0]
    assert leakage.words(pa.array([None, "", "A_b"]))[0].to_pylist() == ["a", "b"]


# ---- encoding
CLEAN = ["Größere Schäden blieben während der Prüfung aus, die Störung wäre früher möglich gewesen.", "Le contrôle préalable reste nécessaire là où l’accès a été bloqué.", "Więcej szczegółów później, złośliwy moduł usunął ślady — część dostępna.",
         "Процесс был запущен много раз подряд после блокировки доступа.", "A análise não terminou; exceção em análise às duas.", "Plain words only.", "Costs ±3% → 5 µs, “quoted” text isn’t odd."]


def test_garbled_texts_are_found_and_restored(spark, spool):
    rng = random.Random(12)
    rows, truth = [], {}
    for i in range(400):
        text = " ".join(rng.choice(CLEAN) for _ in range(3))
        if i % 10 == 3:
            passage = rng.choice(CLEAN[:5])
            options = [c for c in encoding.CHAINS if (g := encoding.garble(passage, c)) is not None and g != passage and encoding.undo(g, c) == passage]
            truth[i] = f"{text} {passage}"
            text = f"{text} {encoding.garble(passage, rng.choice(options))}"
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, "na�ve"), (1003, "ascii")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = {r.doc_id: r for r in encoding.restore(docs, spool).collect()}
    assert set(got) == set(truth) | {1002}
    assert got[1002].n_lost == 1 and got[1002].text == "na�ve"
    right = sum(got[i].text == t for i, t in truth.items())
    assert right >= 0.9 * len(truth)
    assert {r.doc_id for r in encoding.garbled_documents(docs, spool).collect()} == set(got)


def mixed(rng, n, words):
    """Clean texts of ``words`` and, among every ten, one with a garbled sentence."""
    rows, bad = [], set()
    for i in range(n):
        text = " ".join(rng.choice(CLEAN) for _ in range(3)) + " " + " ".join(rng.choice(words) for _ in range(3))
        if i % 10 == 3:
            passage = rng.choice(CLEAN[:5])
            options = [c for c in encoding.CHAINS if (g := encoding.garble(passage, c)) is not None and g != passage and encoding.undo(g, c) == passage]
            text, _ = f"{text} {encoding.garble(passage, rng.choice(options))}", bad.add(i)
        rows.append((i, text))
    return rows, bad


def test_margin_is_validated_on_held_out_documents(spark):
    """The margin follows the data; on held-out documents precision and recall are at least 0.9, and so is recall of the common chains."""
    margins = []
    for words in (["vielleicht"], [f"{a}≈{b}µ" for a in "abcdefgh" for b in "stuvwxyz"] + ["ˆ±", "≠‰"]):
        rows, bad = mixed(random.Random(7), 500, words)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = encoding.garbled_words(docs, Spool(spark, "test"))
        got = {r.doc_id for r in found.each.join(found.words, ["word", "fold"], "left_semi").collect()}
        assert len(got & bad) >= 0.9 * len(got) and len(got & bad) >= 0.9 * len(bad)
        assert found.margin.wrongly_found <= 1e-4 and found.margin.low <= found.margin.margin
        share = encoding.restored_share(found).filter("n >= 20").collect()
        assert share and sum(r.share * r.n for r in share) >= 0.9 * sum(r.n for r in share)
        if found.margin.low < found.margin.high:
            assert all(r.share >= 0.9 for r in share if r.n >= 100)
        margins.append(found.margin.margin)
    assert margins[0] != margins[1]


def test_margin_is_validated_on_all_clean_words(spark):
    """Every chain is tried on every clean word, however many there are, by all models that have not seen one of its folds."""
    words = [f"{a}{b}{c}{d}n" for a in "bdfgklmprst" for b in "äöüéñ" for c in "bdlmnrst" for d in "aeo"]
    rows = [(i, " ".join([CLEAN[i % 5], *words[i % 660 * 2 : i % 660 * 2 + 2]])) for i in range(1000)]
    found = encoding.garbled_words(spark.createDataFrame(rows, "doc_id long, text string"), Spool(spark, "test"))
    clean = {r.word: r.n for r in found.clean.collect()}
    assert set(words) <= set(clean) and max(sum(x > 0 for x in n) for n in clean.values()) == encoding.FOLDS
    gains = [[] for _ in encoding.CHAINS]
    for w, n in clean.items():
        for i, chain in enumerate(encoding.CHAINS):
            g = encoding.garble(w, chain)
            if g is not None and g != w and encoding.undo(g, chain) == w:
                gains[i].append(min(found.model.use(f).score(w) - found.model.as_found(g) for f in range(encoding.FOLDS) if n[f]))
    got = {r.chain: (r.n, round(r.share, 9)) for r in encoding.restored_share(found).collect()}
    assert got == {i: (len(x), round(sum(y > found.margin.margin for y in x) / len(x), 9)) for i, x in enumerate(gains) if x}
    assert max(n for n, _ in got.values()) == len(clean) > 1300
    at = np.zeros((len(gains), 2001), np.int64)
    for i, x in enumerate(gains):
        np.add.at(at[i], np.clip(np.ceil(np.array(x) * 10), 0, 2000).astype(int), 1)
    assert encoding.settle(at[0] * 0, at, 1e-4, 0.9).high == found.margin.high


def test_settled_margin():
    clean, garbled = np.zeros(2001, np.int64), np.zeros(2001, np.int64)
    clean[[0, 30, 50]], garbled[[20, 150, 300]] = (90, 9, 1), (5, 5, 90)
    m = encoding.settle(clean, garbled, 0.0, 0.9)
    assert (m.low, m.high, m.margin, m.wrongly_found, m.found_of_garbled) == (5.0, 29.9, 17.4, 0.0, 0.9)
    assert encoding.settle(clean, garbled, 0.01, 0.9).low == 3.0
    weak, few = np.zeros(2001, np.int64), np.zeros(2001, np.int64)
    weak[[60, 80, 400]], few[10] = (5, 20, 75), 99
    assert encoding.settle(clean, np.stack([garbled, weak, few]), 0.0, 0.9).high == 7.9  # the weakest chain of enough words decides
    assert encoding.settle(garbled, clean, 0.0, 0.9).margin == 30.0  # nothing does both: few wrong finds come first
    none = np.zeros(2001, np.int64)
    assert encoding.settle(none, none, 0.0, 0.9).margin == 0.0 and encoding.settle(clean, none, 0.0, 0.9).margin == 5.0
    assert encoding.balanced(clean, garbled) == encoding.balanced(clean + np.bincount([900], minlength=2001) * 8, garbled) == 5.0


def test_odd_blanks_are_no_evidence(spark, spool):
    rows = [(i, " ".join(random.Random(i).choice(CLEAN) for _ in range(3))) for i in range(200)] + [(500, CLEAN[0].replace(" ", "\xa0")), (501, "Nur\u2009ein\u3000Wort.")]
    assert encoding.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string"), spool).count() == 0


def test_texts_of_one_id_and_without_id(spark, spool):
    rows = [(i, " ".join(random.Random(i).choice(CLEAN) for _ in range(3))) for i in range(300)]
    bad = encoding.garble(CLEAN[0], (("cp1252", "utf-8"),))
    rows += [(5, bad), (5, bad), (None, bad), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in encoding.garbled_documents(docs, spool).collect()} == {5, None}
    texts = [r.text for r in encoding.restore(docs, spool).collect() if r.doc_id == 5]
    assert len(texts) == 3 and bad not in texts and rows[5][1] in texts and max(map(texts.count, texts)) == 2


def test_only_garbled_texts(spark, spool):
    got = encoding.garbled_documents(spark.createDataFrame([(1, "GrÃ¶ÃŸe"), (2, "\ufffd")], "doc_id long, text string"), spool)
    assert 2 in {r.doc_id for r in got.collect()}  # nothing clean to learn from: the rest is undefined but for lost characters


def test_no_texts(spark, spool):
    assert encoding.garbled_documents(spark.createDataFrame([], "doc_id long, text string"), spool).count() == 0


def test_chains_invert_each_other():
    for chain in encoding.CHAINS:
        for text in CLEAN:
            g = encoding.garble(text, chain)
            if g is not None and g != text and (b := encoding.undo(g, chain)) is not None:
                assert b == text or len(b) != len(text) or chain[0][0] in ("cp1252", "cp1250", "cp1251", "cp866", "koi8_r", "latin-1", "mac_roman", "cp437", "cp850", "iso8859_2")
