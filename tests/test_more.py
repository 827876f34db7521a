"""Evaluation, dataset, forests, serial scores, requests, files and the engine."""

import ast
import json
import os
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from talewind.api import Engine
from talewind.operators import benign, evaluate, forest, graph, parse, retrieval, twin, ueba
from talewind.operators.attribution import Attribution, leave_one_group_out, platt, save_if_good, serve
from talewind.operators.dataset import build_dataset, scenario_records
from talewind.operators.incidents import follow_up
from talewind.sources import files
from talewind.spool import Home
from tests.test_telemetry import ACCESS, LOGON_A, LOGON_B, PROCESS, T, events

PACKAGE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "talewind")


def test_package_imports_no_tests():
    for folder, _, names in os.walk(PACKAGE):
        for name in (n for n in names if n.endswith(".py")):
            for node in ast.walk(ast.parse(open(os.path.join(folder, name)).read())):
                found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(x.split(".")[0] in ("tests", "pytest", "hypothesis") for x in found), name


# ---- forests and attribution
def test_forest_learns_and_is_the_same_every_time(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] > 0).astype(int) + 2 * (x[:, 3] > 0.5)).astype(np.int64)
    a, b = (forest.fit_forests(spark, x[:400], y[:400], 4, [np.arange(400), np.arange(0, 400, 2)], 40, 8, 1) for _ in range(2))
    assert (a[0].predict(x[400:]).argmax(1) == y[400:]).mean() > 0.85 and len(a[0].trees) == 40
    assert np.array_equal(a[1].predict(x), b[1].predict(x)) and np.allclose(a[0].predict(x).sum(1), 1)
    assert forest.balanced(np.array([0, 0, 0, 1]), 3).tolist() == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2])


def test_one_tree_splits_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 6, (30, 1)).astype(float), rng.integers(0, 2, 30)
        edges = forest.edges_of(x)
        t = forest.grow(forest.binned(x, edges), y, np.ones(30), 2, edges, 1, np.random.default_rng(5))
        pick = np.random.default_rng(5).integers(0, 30, 30)
        xs, ys = x[pick, 0], y[pick]

        def purity(c):
            parts = [ys[xs <= c], ys[xs > c]]
            return sum((np.bincount(p, minlength=2) ** 2).sum() / len(p) for p in parts) if all(map(len, parts)) else -1

        best = max((purity(c) for c in edges[0]), default=-1)
        if t.left[0] >= 0:
            assert purity(t.cut[0]) == pytest.approx(best)


def test_scaling_follows_the_share():
    s = np.random.default_rng(1).random(4000)
    y = np.random.default_rng(2).random(4000) < 1 / (1 + np.exp(-(6 * s - 3)))
    a, b = platt(s, y)
    assert abs(a - 6) < 1 and abs(b + 3) < 0.7


def test_calibration_of_the_classes_that_are_there(spark):
    rng = random.Random(0)
    rows = [(c + rng.gauss(0, 0.2), None if i == 3 else rng.random(), f"T{c}", "s0" if c == 2 else f"s{i % 4}") for c in range(3) for i in range(20)] + [(0.0, 0.0, None, "s1")]
    df = spark.createDataFrame(rows, "x double, y double, label string, grp string")
    m = Attribution(["x", "y"], trees=10, depth=4).fit(df, "label", "grp")
    assert {c for _, c in m.uncalibrated} == {"T2"} and any(s and s[0] for s in m.scalers)  # T2 lives in one group only
    got = m.predict(df).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 for r in got) and sum(r.pred == r.label for r in got) > 40
    one = Attribution(["x", "y"], trees=10, depth=4).fit(df.withColumn("grp", F.lit("only")), "label", "grp")
    assert len(one.forests) == 3 and any(s and s[0] for s in one.scalers)  # rows are held out where there are no groups
    p = leave_one_group_out(df, ["x", "y"], "label", "grp", trees=5, depth=3)
    assert p.count() == 60 and "T2" not in p.filter("group = 's0'").first().classes


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(float(i), f"T{i % 2}", f"g{i % 3}") for i in range(30)], "x double, label string, grp string")
    home = Home(spark, f"file://{tmp_path}/models")
    assert Attribution.load(home, "none.json") is None and serve(None, df).first().status == "model_unavailable"
    m = Attribution(["x"], trees=4, depth=3).fit(df, "label", "grp")
    assert save_if_good(m, home, "a.json", 0.30, [0.28], 0.1) is None and save_if_good(m, home, "a.json", 0.9, [0.28], 0.2) is None and home.names() == []
    assert save_if_good(m, home, "a.json", 0.9, [0.28], 0.1).endswith("a.json")
    back = Attribution.load(home, "a.json")
    assert back.version == "a.json" and [r.proba for r in back.predict(df).collect()] == [r.proba for r in m.predict(df).collect()]
    with pytest.raises(RuntimeError):
        m.save(home, "a.json")  # a name is written once


# ---- evaluation
def test_metrics_of_folds_and_together(spark):
    rows = [("g1", "a", "a", [0.9, 0.1], ["a", "b"]), ("g1", "b", "a", [0.6, 0.4], ["a", "b"]), ("g2", "c", "b", [0.3, 0.7], ["a", "b"]), ("g2", "b", "b", [0.2, 0.8], ["a", "b"])]
    p = spark.createDataFrame(rows, "group string, y string, pred string, proba array<double>, classes array<string>")
    f = {r.group: r for r in evaluate.fold_metrics(p, k=1).collect()}
    assert (f["g1"].n_test, f["g1"].top3, round(f["g1"].macro_f1, 6)) == (2, 0.5, round((2 / 3 + 0) / 2, 6))
    assert round(f["g1"].brier, 6) == round((0.02 + 0.72) / 2, 6) and round(f["g1"].ece, 6) == round((0.1 + 0.6) / 2, 6)
    assert round(f["g2"].brier, 6) == round((0.09 + 0.49 + 0.04 + 0.04) / 2, 6)  # a class the model lacks adds nothing
    r = evaluate.pooled(p, evaluate.fold_metrics(p))
    assert r["macro_f1_ci_lo"] <= r["macro_f1"] <= r["macro_f1_ci_hi"] and r["majority_macro_f1"] == pytest.approx(2 * 2 / 6 / 3)
    assert sum(n for *_, n in evaluate.random_counts([("a", "a", 10), ("b", "a", 5)], ["a", "b"])) == 15
    assert evaluate.pooled(p.limit(0), evaluate.fold_metrics(p.limit(0))) == {} and evaluate.fold_metrics(p.limit(0)).count() == 0


def test_strategies_and_support(spark):
    rows = [(f"s{i % 6}", "T1", i % 2 == 0, 0.3) for i in range(12)] + [("s0", "T2", True, 0.9), (None, "T1", None, None), ("s1", None, True, 0.9)]
    df = spark.createDataFrame(rows, "scenario string, target string, has boolean, score double")
    kept = evaluate.supported_targets(df, "target", "scenario", 5)
    assert {r.target for r in kept.collect()} == {"T1"} and kept.count() == 13
    a = {r.strategy: r for r in evaluate.strategy_audit(df.filter("target is not null"), "target", "scenario", F.col("has"), F.col("score")).collect()}
    assert [(a[s].samples, a[s].classes, a[s].skipped) for s in evaluate.STRATEGIES] == [(14, 2, False), (7, 2, False), (1, 1, True)]
    assert {tuple(r) for r in evaluate.target_policy(df, "target").collect()} == {("single", 14), ("several", 1)}


# ---- scores
def test_serial_scores_follow_the_rule(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.random() * (9 if rng.random() < 0.02 else 1), min(1.0, rng.random())) for s in "ab" for i in range(420)]
    df = spark.createDataFrame(rows, "site string, t int, x double, stat_score double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = {(r.site, r.t): r for r in ueba.serial_scores(df, ["x"], ["t"], "site", every=60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for site in "ab":
        held, model, trained = [], None, 0
        for n, (_, t, x, stat) in enumerate(sorted(r for r in rows if r[0] == site), 1):
            s = 0.5 if model is None else 1 / (1 + np.exp(5 * model.score_samples(np.array([[x]]))[0]))
            raw = 0.6 * stat + 0.4 * s
            assert got[site, t].is_anomalous == (raw >= 0.5) and abs(got[site, t].if_score - s) < 1e-9
            if raw < 0.5:
                held.append([x])
                if n % 60 == 0 and len(held) >= 50:
                    model, trained = ueba.IsolationForest(seed=42).fit(np.array(held[-5000:])), trained + 1
        assert trained >= 1


def test_trainer_scores(spark):
    df = spark.createDataFrame([(i, float(i % 3), 0.0, 0.0, 0.0) for i in range(50)], "t int, process_access_count double, registry_mod_count double, failed_login_count double, network_flow_count double").withColumn("b", F.floor(F.col("t") / 10))
    got = ueba.trainer_scores(df, ["t"], "b").orderBy("t").collect()
    assert got[0].score == 0.2 and all(r.z_event_count == 0 for r in got) and max(r.score for r in got) > 0.2


# ---- requests, graphs, retrieval, benign sources
def requests(spark, rows):
    return files.from_dicts(spark, rows) if rows else spark.createDataFrame([], "seq long, record map<string,string>")


def test_requests(spark):
    a, e = twin.normalized(requests(spark, [{"id": 1, "tier": 0}, {"asset_id": "b", "id": "no"}, {"id": 1, "tier": 2}]), requests(spark, [{"source": 1, "to": "b"}, {"from_asset": "b", "target_id": "1", "technique": "T1078"}]))
    assert {(r.asset_id, r.tier) for r in a.collect()} == {("1", 2), ("b", None)} and {(r.src, r.dst, r.technique) for r in e.collect()} == {("1", "b", None), ("b", "1", "T1078")}
    nodes, links = twin.export(a, twin.topology(a, e))
    assert {(r.asset_id, r.tier) for r in nodes.collect()} == {("1", 2), ("b", 3)} and {r.weight for r in links.collect()} == {1.0, 0.8}
    for assets, edges in (([{"name": "x"}], []), ([{"id": "a"}], [{"from": "a", "to": "gone"}]), ([{"id": "a"}], [{"from": "a"}])):
        with pytest.raises(ValueError):
            twin.normalized(requests(spark, assets), requests(spark, edges))


def test_contents_of_graphs(spark):
    f = spark.createDataFrame([(s, n, float(n) + (s == "c")) for s in "abc" for n in range(3)], "session string, node int, x double")
    e = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 2, 0), ("b", 1, 2, 0), ("b", 0, 1, 2)], "session string, a int, b int, type int")
    h = {r.session: r.hash for r in graph.content_hashes(f, e).collect()}
    assert h["a"] == h["b"] != h["c"] and len(h) == 3
    labels = spark.createDataFrame([("h1", "x"), ("h1", "y"), ("h2", "x"), ("h2", "x"), (None, None)], "hash string, label string")
    assert [(r.hash, r.n, r.n_labels) for r in graph.conflicts(labels, "label").collect()] == [("h1", 2, 2)]
    assert {(r.label, r.class_id) for r in graph.label_map(labels, "label").collect()} == {("unknown", 0), ("x", 1), ("y", 2)}


def test_vectors_of_some_sources(spark):
    v = spark.createDataFrame([(i, "s" if i % 3 else "t", [float(i), 1.0]) for i in range(30)], "vec_id long, source string, embedding array<double>")
    q = v.filter("vec_id = 10").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.cosine_search(v, q, 4, sources=["t"]).collect()
    assert len(got) == 4 and all(r.vec_id % 3 == 0 for r in got)


def test_only_benign_sources(spark):
    lines = spark.createDataFrame([("1,u,u,C1,C1,K,N,LogOn,Success",)], "value string")
    with pytest.raises(ValueError):
        benign.auth_features(lines, source="OTRF")


def test_general_dates(spark):
    texts = ["7 February 2021 at 10:00:05", "2021-02-07T10:00:05+02:00", "Sun, 7 Feb 2021 10:00:05 +0100", "2/7/2021 10:00:05 PM", "20210207T100005", "2021 Feb 7 10h00m05s", "10:00:05", "February 2021", "2021", "not a date 2021", ""]
    df = spark.createDataFrame([(i, {"EventID": "1", "UtcTime": t}) for i, t in enumerate(texts)], "seq long, record map<string,string>")
    got = {r.seq: (r.ts, r.reason) for r in parse.parse(df, general=True).collect()}
    at = lambda h: datetime(2021, 2, 7, h, 0, 5)
    assert [got[i][0] for i in range(6)] == [at(10), at(8), at(9), at(22), at(10), at(10)]
    assert [got[i][1] for i in range(6, 11)] == ["bad_timestamp"] * 2 + [got[8][1], "bad_timestamp", "no_timestamp"]
    plain = {r.seq: r.reason for r in parse.parse(df).collect()}
    assert plain[0] == "bad_timestamp" and plain[2] is None and plain[3] is None


# ---- files
def test_rows_of_several_files_are_numbered_densely(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(" a, b\n" + "".join(f"{i},{j}\n" for j in range(4)))
    got = files.csv_rows(spark, f"file://{tmp_path}").orderBy("ordinal").collect()
    assert [(r.ordinal, r.a, r.b) for r in got] == [(4 * i + j, str(i), str(j)) for i in range(3) for j in range(4)]


def scenario(tmp_path, name, mappings, raw, link=True):
    folder = tmp_path / "datasets" / "x"
    (folder / "_metadata").mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        z.writestr("e.json", "\n".join(map(json.dumps, raw)))
    files_ = f"files:\n- {{type: Host, link: 'http://h/datasets/x/{name}.zip'}}\n" if link else ""
    (folder / "_metadata" / f"{name}.yaml").write_text(f"id: {name}\ntitle: t\n{files_}attack_mappings: {json.dumps(mappings)}\n")


def test_dataset_of_archives(spark, spool, tmp_path):
    one, two = [{"technique": "T1003"}], [{"technique": "T1552", "sub-technique": "004"}, {"technique": "T1003"}]
    scenario(tmp_path, "one", one, [PROCESS, ACCESS, {"EventID": 4688, "UtcTime": T % 0}])
    scenario(tmp_path, "two", two, [PROCESS, LOGON_A, LOGON_B])  # the same host as in one
    scenario(tmp_path, "unlabelled", [], [PROCESS])
    scenario(tmp_path, "nothing", one, [{"EventID": "x"}])
    scenario(tmp_path, "unlinked", one, [PROCESS], link=False)
    scen = spool.cut(files.scenarios(spark, f"file://{tmp_path}"))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(f"file://{tmp_path}").select("path")
    rows, drops = build_dataset(scenario_records(spark, scen, archives), files.mappings_of(scen), spool)
    got = sorted((r.scenario_id, r.kind, r.train_target, r.y_primary, r.has_evidence, int(r.lsass_targeted_count), tuple(r.techniques)) for r in rows.collect())
    assert got == [("one", "tree", "T1003", "T1003", True, 1, ("T1003",))] + [("two", "logon", None, "T1003", False, 0, ("T1003", "T1552"))] * 2 + [("two", "tree", None, "T1003", True, 0, ("T1003", "T1552"))]
    assert {(r.reason, r.n) for r in drops.collect()} == {("no_parser", 1), ("malformed", 1)}
    with pytest.raises(ValueError):
        build_dataset(scenario_records(spark, scen, archives), files.mappings_of(scen), spool, source="LANL")
    none = scenario_records(spark, scen.limit(0), archives)
    assert none.count() == 0 and build_dataset(none, files.mappings_of(scen), spool)[0].count() == 0


# ---- engine
def test_engine(spark):
    m = spark.createDataFrame([("T1", "T2", 3, 1.0, ("s", 1))], "src string, dst string, support bigint, prob double, first_seen struct<scenario_id:string,pos:bigint>")
    docs = spark.createDataFrame([(1, ["T1.001"])], "doc_id long, technique_ids array<string>")
    e = Engine(spark, matrix=m, documents=docs)
    assert e.health() == {"status": "ok", "attribution_available": False, "prediction_available": True}
    got = e.ingest([PROCESS, ACCESS, LOGON_A, LOGON_B, {"EventID": 4688, "UtcTime": T % 0}])
    assert (got["parsed_events"], got["dropped"], len(got["incidents"])) == (4, 1, 3)
    assert all(i["attribution"]["status"] == "model_unavailable" and i["attribution"]["confidence"] is None and i["predicted_next"] == [] for i in got["incidents"])
    assert {i["host"] for i in got["incidents"]} == {"HOSTA", "HOSTB"} and e.ingest([])["incidents"] == []
    with pytest.raises(ValueError):
        e.ingest([], source="nowhere")
    assert e.update_topology([{"id": "web"}, {"id": "db", "tier": 0}], [{"from": "web", "to": "db"}]) == {"status": "ok", "nodes": 2, "edges": 1}
    assert e.blast_radius("web") == {"reachable_count": 1, "critical_reachable": 1} and e.blast_radius("gone") is None
    with pytest.raises(ValueError):
        e.update_topology([{"id": "web"}], [{"from": "web", "to": "gone"}])
    assert e.topology()["edges"] == [{"src": "web", "dst": "db", "technique": "T1021", "weight": 1.0}]


def test_follow_up(spark):
    m = spark.createDataFrame([("T1", "T2", 3, 1.0, ("s", 1))], "src string, dst string, support bigint, prob double, first_seen struct<scenario_id:string,pos:bigint>")
    named = spark.createDataFrame([("T1.001", 5)], "technique string, doc_id long")
    asked = spark.createDataFrame([("T1",), ("T1",), ("T7",), (None,)], "technique string")
    assert {(r.technique, len(r.steps), r.evidence) for r in follow_up(m, named, asked).collect()} == {("T1", 1, True), ("T7", 0, False)}
    assert events(spark, [PROCESS]).count() == 1
