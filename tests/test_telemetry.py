import json
import math
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from talewind.operators import benign, evaluate, features, graph, labels, parse, retrieval, sessions, transitions, twin, ueba
from talewind.operators.attribution import Attribution, leave_one_group_out, serve
from talewind.operators.hygiene import Hygiene, correlations
from talewind.plans import reference
from talewind.sources import files
from talewind.streaming.telemetry import gap_sessions, running_scores

T = "2021-01-01 10:00:%06.3f"
PROCESS = {"EventID": 1, "UtcTime": T % 0, "Hostname": "HOSTA", "ProcessGuid": "{proc-a}", "ProcessId": "100", "Image": "C:/Windows/powershell.exe", "CommandLine": "powershell -enc AAAA", "ParentImage": "C:/Windows/explorer.exe", "Hashes": "SHA1=ab=c, MD5 = 1 ,x,MD5=2"}
ACCESS = {"EventID": 10, "UtcTime": T % 5, "Hostname": "HOSTA", "SourceProcessGUID": "{proc-a}", "SourceImage": "C:/Windows/powershell.exe", "TargetProcessGUID": "{proc-lsass}", "TargetProcessId": "8", "TargetImage": "C:/Windows/lsass.exe"}
LOGON_A = {"EventID": 4624, "UtcTime": T % 1, "Hostname": "HOSTA", "TargetUserSid": "S-1", "TargetUserName": "alice", "TargetLogonId": "0x111", "LogonType": "2"}
LOGON_B = {"EventID": 4624, "UtcTime": T % 2, "Hostname": "HOSTB", "TargetUserName": "bob", "TargetDomainName": "D", "TargetLogonId": "0x222", "LogonType": "3"}
SYSTEM = {"EventID": 4624, "UtcTime": T % 3, "Hostname": "HOSTA", "TargetUserName": "SYSTEM", "TargetLogonId": "0x3e7"}


def events(spark, raw):
    return parse.kept(parse.parse(files.from_dicts(spark, raw)))


def build(spark, spool, raw, gap_s=300):
    ev = spool.cut(events(spark, raw))
    return ev, spool.cut(sessions.build_sessions(ev, spool, gap_s))


def test_drop_reasons_and_time_spellings(spark):
    raw = [{"EventID": 1, "Hostname": "H"}, {"EventID": 4688, "UtcTime": T % 0}, {"EventID": "x"}, {}, {"EventID": " 1 ", "UtcTime": T % 0}, {"EventID": 1.7, "UtcTime": T % 0}, {"EventID": "1_0"}, {"EventID": 1, "UtcTime": "10:00"},
           {"EventID": 1, "UtcTime": "", "EventTime": "Jan 1 2021 10:00"}, {"EventID": 1, "UtcTime": "2021-01-01T10:00:00.1234567Z"}, {"EventID": 1, "UtcTime": "2021-01-01 12:00:00+02:00"}]
    p = {r.seq: r for r in parse.parse(files.from_dicts(spark, raw)).collect()}
    assert [p[i].reason for i in range(11)] == ["no_timestamp", "no_parser", "malformed", "malformed", "silent_mismatch", "silent_mismatch", "malformed", "bad_timestamp", None, None, None]
    assert p[10].ts == p[8].ts == datetime(2021, 1, 1, 10) and p[9].ts.microsecond == 123456 and p[8].host == "Unknown"
    assert {(r.reason, r.event_id, r.n) for r in parse.drop_counts(parse.parse(files.from_dicts(spark, raw[:3]))).collect()} == {("no_timestamp", 1, 1), ("no_parser", 4688, 1), ("malformed", None, 1)}


def test_entities_and_edges(spark):
    e = {r.seq: r for r in parse.entities(events(spark, [PROCESS, ACCESS, LOGON_A, LOGON_B, {**PROCESS, "ProcessGuid": ""}, {"EventID": 13, "UtcTime": T % 0, "TargetObject": r"HKLM\A\B\v", "EventType": "DeleteValue", "ProcessId": "4", "Hostname": "H"}])).collect()}
    assert e[0].entity_id == "proc_{proc-a}" and json.loads(e[0].attributes["hashes"]) == {"SHA1": "ab=c", "MD5": "2"}
    assert (e[2].entity_id, e[3].entity_id, e[4].entity_id) == ("user_S-1", "user_d\\bob", "proc_hosta_100_1609495200.0")
    a = e[5].attributes
    assert (a["hive"], a["key_path"], a["value_name"], a["operation"]) == ("HKLM", "A\\B", "v", "Delete")
    g = {(r.src, r.rel, r.dst) for r in parse.edges(events(spark, [PROCESS, ACCESS, LOGON_A, {**PROCESS, "ParentProcessGuid": parse.ZERO_GUID}])).collect()}
    assert g == {("proc_{proc-a}", "accessed_process", "proc_{proc-lsass}")}


def test_sessions_of_two_hosts(spark, spool):
    ev, m = build(spark, spool, [PROCESS, ACCESS, LOGON_A, LOGON_B])
    t = {(r.kind, r.host, r.n_events) for r in sessions.session_table(m).collect()}
    assert t == {("tree", "HOSTA", 2), ("logon", "HOSTA", 1), ("logon", "HOSTB", 1)}
    assert sessions.ownership_violations(m).count() == 0
    ends = {r.entity_id for r in sessions.session_entities(ev, m).collect()}
    found = sessions.session_edges(ev, m).collect()
    assert len(found) == 1 and all(r.src in ends and r.dst in ends for r in found)


def test_gap_logon_and_tree_rules(spark, spool):
    at = lambda s, **k: {"EventID": 4103, "UtcTime": f"2021-01-01 10:{s // 60:02d}:{s % 60:02d}", "Hostname": "G", **k}
    raw = [at(0), at(300), at(601), {**SYSTEM, "SubjectLogonId": "0x9"}, SYSTEM,
           {**PROCESS, "ProcessGuid": " {x} ", "ParentProcessGuid": "{y}"}, {**PROCESS, "ProcessGuid": "{y}", "ParentProcessGuid": "{x}"}, {**PROCESS, "ProcessGuid": "{s}", "ParentProcessGuid": "{s}"},
           {**PROCESS, "ProcessGuid": "{o}", "ParentProcessGuid": "{gone}"}, {**PROCESS, "ProcessGuid": "{o}", "UtcTime": T % 30}]
    ev, m = build(spark, spool, raw)
    got = {r.seq: (r.kind, r.session) for r in m.collect()}
    assert got[0] == got[1] == ("gap", 0) and got[2] == ("gap", 2)  # exactly 300 s does not split
    assert got[3] == ("logon", 3) and got[4][0] == "gap"  # a built-in logon falls through to the next field
    assert {got[i][0] for i in (5, 6, 7)} == {"gap"}  # loops have no root
    assert got[9] == ("tree", 9) and got[8][0] == "gap"  # the last creation record of a guid counts
    nodes = {r.guid: r for r in sessions.process_trees(sessions.process_nodes(ev), spool).collect()}
    assert not nodes["{o}"].is_orphan and nodes["{x}"].root_seq is None
    assert build(spark, spool, [])[1].count() == 0


def test_features(spark):
    ev = events(spark, [PROCESS, ACCESS]).withColumn("s", F.lit(1))
    r = features.session_features(features.feature_inputs(ev), "s").first()
    assert (r.lsass_targeted_count, r.process_access_count, r.proc_powershell, r.window_duration, r.is_off_hours, r.max_command_line_length) == (1, 1, 2, 5.0, 0.0, 20)
    assert len(features.FEATURES) == 103 and list(features.feature_columns()) == list(features.FEATURES) == sorted(features.FEATURES)
    assert features.session_features(features.feature_inputs(ev), "s").select(features.evidence().alias("e")).first().e


def test_labels(spark):
    m = [("g", "T1552", "004", ["TA0006"]), ("g", "T1606", "002", ["TA0001"]), ("g", "T1078", "004", None), ("g", "T1114", None, ["TA0009"]), ("g", "", None, None)]
    x = labels.label_sets(spark.createDataFrame(m, "scenario_id string, technique string, sub_technique string, tactics array<string>"))
    r = x.first()
    assert set(r.techniques) == {"T1552", "T1606", "T1078", "T1114"} and "T1552.004" in r.sub_techniques and set(r.tactics) == {"TA0006", "TA0001", "TA0009"}
    with pytest.raises(ValueError):
        labels.check_benign(x, "LANL")
    rows = spark.createDataFrame([(str(i), ["T1003"]) for i in range(3)] + [("9", ["T1999"]), ("8", [])], "scenario_id string, techniques array<string>")
    p = {r.scenario_id: r.projected for r in labels.project(rows, labels.label_space(rows, 3), "scenario_id").collect()}
    assert p == {"0": ["T1003"], "1": ["T1003"], "2": ["T1003"], "9": ["unsupported_class"], "8": []}


def test_transitions(spark):
    steps = spark.createDataFrame([("a", i, t) for i, t in enumerate(["T1.1", "", "T1.2", "T2", "T1", "T2"])] + [("b", 0, "T9"), ("b", 1, "T8")], "scenario_id string, pos int, technique string")
    seq = transitions.sequences(steps)
    assert [r.technique for r in seq.filter("scenario_id = 'a'").orderBy("pos").collect()] == ["T1", "T2", "T1", "T2"]
    m = transitions.matrix(transitions.multistage(seq))
    assert {(r.src, r.dst, r.support, r.prob) for r in m.collect()} == {("T1", "T2", 2, 1.0), ("T2", "T1", 1, 1.0)}
    meta = spark.createDataFrame([("b", "Compound", None)], "scenario_id string, type string, title string")
    assert transitions.multistage(seq, meta).filter("scenario_id = 'b'").count() == 2
    back = transitions.from_json(spark, transitions.to_json(m, 1))
    asked = spark.createDataFrame([("T1.001",), ("T7",)], "technique string")
    got = {r.technique: r.steps for r in transitions.predict(back, asked).collect()}
    assert got["T1.001"][0].technique == "T2" and got["T7"] == [] and transitions.predict(None, asked).first().steps == []


def test_twin(spark, spool):
    assets = spark.createDataFrame([("web", 3), ("app", 2), ("db", 1), ("dc", 0), ("lone", None)], "asset_id string, tier int")
    edges = spark.createDataFrame([(0, "web", "app", "T1021"), (1, "app", "db", "T1078"), (2, "app", "dc", "T1021.002"), (3, "app", "nowhere", None)], "seq int, src string, dst string, technique string")
    g = twin.topology(assets, edges)
    starts = assets.filter("asset_id in ('web', 'lone')").select("asset_id")
    r = twin.reach(g, starts, spool)
    assert {(x.start, x.asset, round(x.cost, 3)) for x in r.collect()} == {("web", "app", 1.0), ("web", "db", 1.8), ("web", "dc", 2.0)}
    assert {tuple(x) for x in twin.blast_radius(r, assets, starts).collect()} == {("web", 3, 2), ("lone", 0, 0)}
    c = twin.critical_paths(r, assets).orderBy("rank").collect()
    assert [(x.asset, x.total_cost, x.path) for x in c] == [("db", 1.8, ["web", "app", "db"]), ("dc", 2.0, ["web", "app", "dc"])]
    changed = twin.modify(g, [{"op": "harden_node", "node_id": "app"}, {"op": "remove_edge", "from_asset": "app", "to_asset": "dc"}, {"op": "add_edge", "from_asset": "db", "to_asset": "dc"}])
    assert {(x.asset, round(x.cost, 3)) for x in twin.reach(changed, starts, spool).collect()} == {("app", 2.5), ("db", 3.3), ("dc", 4.8)}
    with pytest.raises(ValueError):
        twin.topology(assets, edges.limit(0))


def test_random_reach_against_relaxation(spark, spool):
    rng = random.Random(3)
    e = {(rng.randrange(30), rng.randrange(30)): rng.choice([0.8, 1.0, 1.5, 2.0, 9.0]) for _ in range(90)}
    g = spark.createDataFrame([(a, b, "T", w) for (a, b), w in e.items() if a != b], "src int, dst int, technique string, weight double")
    best = {0: 0.0}
    for _ in range(40):
        for (a, b), w in e.items():
            if a in best and best[a] + w <= 10 + 1e-9 and best[a] + w < best.get(b, 99) - 1e-12:
                best[b] = best[a] + w
    got = {r.asset: round(r.cost, 6) for r in twin.reach(g, spark.createDataFrame([(0,)], "asset_id int"), spool).collect()}
    assert got == {k: round(v, 6) for k, v in best.items() if k}


def test_running_z_matches_the_recurrence(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([0.1, 5.0, 100 + rng.random(), None]), i // 40) for i in range(200)] + [("c", 500 + i, 0.1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "e string, o int, x double, b int")
    state, want = {}, {}
    for e, o, x, _ in rows:
        n, mean, m2 = state.get(e, (0, 0.0, 0.0))
        x = x or 0.0
        sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
        want[o] = (x - mean) / sd if sd > 1e-12 else 0.0
        n, d = n + 1, x - mean
        mean += d / n
        state[e] = (n, mean, m2 + d * (x - mean))
    for bucket in (None, "b"):
        got = {r.o: r.z_x for r in ueba.zscores(df, "e", ["o"], ["x"], bucket).collect()}
        assert all(abs(got[o] - z) < 1e-6 for o, z in want.items())
    s = ueba.scores(ueba.zscores(df, "e", ["o"], ["x"]), ["x"]).collect()
    assert all(r.is_anomalous == (0.6 * min(1, min(abs(r.z_x), 10) / 6) + 0.2 >= 0.5) for r in s)


def test_isolation_forest_ranks_outliers():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (400, 3)), [[9, 9, 9]]])
    s = ueba.IsolationForest().fit(x).score_samples(x)
    assert s.argmin() == 400 and (s < 0).all() and (s >= -1).all()


def test_forest_is_trained_on_the_last_rows(spark, monkeypatch):
    seen, fit = [], ueba.IsolationForest.fit
    monkeypatch.setattr(ueba.IsolationForest, "fit", lambda self, x: seen.append(x) or fit(self, x))
    df = spark.createDataFrame([(i, float(i % 5 == 0), float(i % 7), i % 50 == 49) for i in range(1000)], "t long, a double, b double, is_anomalous boolean")
    got = ueba.with_forest(df, ["a", "b"], df, ["t"], limit=300)
    want = [[float(i % 5 == 0), float(i % 7)] for i in range(999, -1, -1) if i % 50 != 49][:300]  # every vector keeps its share
    assert seen[0].tolist() == want and got.select("if_score").distinct().count() > 1


def test_hygiene(spark):
    rng = random.Random(1)
    rows = [(v := rng.random(), 2 * v, 1.0, rng.random(), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, ["proc_x", "proc_y", "flat", "net_y", "vmware_tools_flag"])
    h = Hygiene().fit(df, df.columns)
    assert h.kept == ["proc_x", "net_y"] and Hygiene.loads(h.dumps()).transform(df).columns == h.kept
    with pytest.raises(RuntimeError):
        Hygiene().transform(df)


def test_correlations_keep_rows_with_nulls(spark):
    rows = [(float(i), float(2 * i), None) for i in range(1, 9)] + [(0.0, float("nan"), 5.0), (float("nan"), None, 6.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = np.corrcoef(np.array([[0.0 if v is None or v != v else v for v in r] for r in rows]).T)
    assert np.allclose(correlations(df, ["a", "b", "c"]), want)
    assert Hygiene().fit(df, df.columns).correlated == ["b"]


def test_metrics(spark):
    p = spark.createDataFrame([("a", [0.9, 0.1]), ("b", [0.2, 0.8])], "y string, proba array<double>").withColumn("pred", evaluate.predicted(["a", "b"]))
    assert evaluate.top_k(p, ["a", "b"], 1).first()[0] == 1.0 and evaluate.macro(p).first().macro_f1 == 1.0
    assert abs(evaluate.brier(p, ["a", "b"]).first()[0] - (0.02 + 0.08) / 2) < 1e-12 and abs(evaluate.calibration_error(p).first()[0] - 0.15) < 1e-12
    none = p.limit(0)
    assert evaluate.top_k(none, ["a", "b"]).first()[0] == 0.0 and evaluate.calibration_error(none).first()[0] == 0.0
    with pytest.raises(ValueError):
        evaluate.no_leakage(p, p, "y")
    point, lo, hi = evaluate.bootstrap([("a", "a", 40), ("a", "b", 10), ("b", "b", 50)], evaluate.macro_f1_of_counts)
    assert lo <= point <= hi
    assert evaluate.group_folds([("a", 5), ("b", 3), ("c", 3)], 2) == {"a": 0, "b": 1, "c": 1} and evaluate.may_persist(0.5, [0.3], 0.1) and not evaluate.may_persist(0.34, [0.3], 0.1)


def test_attribution(spark):
    rng = random.Random(0)
    rows = [(c + rng.gauss(0, 0.2), rng.random(), 1.0, f"T{c}", f"s{i % 4}") for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, k double, label string, grp string")
    m = Attribution(["x", "y", "k"], trees=5, depth=3).fit(df, "label", "grp")
    got = serve(m, df).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 and len(r.top) == 3 for r in got) and sum(r.technique == r.label for r in got) > 50
    assert serve(None, df).first().status == "model_unavailable"
    with pytest.raises(RuntimeError):
        Attribution(["x"]).predict(df)
    assert leave_one_group_out(df, ["x", "y", "k"], "label", "grp", trees=3, depth=2, calibrate=False).count() == 60


def test_attribution_query_runs_the_whole_job(spark, monkeypatch, tmp_path):
    got = {}

    def spy(rows, features, label, group, **model):
        got.update(rows=rows, features=features, group=group, model=Attribution(features, **model))
        return rows.select(F.col(group).alias("group"), F.col(label).alias("y"), F.col(label).alias("pred"), F.array(F.lit(1.0)).alias("proba"))

    monkeypatch.setattr(reference, "leave_one_group_out", spy)
    spark.createDataFrame([(i, [float(i + j) for j in range(64)], i % 3) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert reference.attribution_loso(spark, str(tmp_path)).count() == 20
    m = got["model"]
    assert len(got["features"]) == 64 and (m.trees, m.depth, m.calibrate) == (300, 10, True)
    first = got["rows"].filter("f00 = 4").first()
    assert [first[f] for f in got["features"]] == [4.0 + j for j in range(64)] and got["rows"].select("grp").distinct().count() == 5


def test_benign(spark):
    lines = ["1,u,u,C1,C1,K,N,LogOn,Success", "2,u,u,C1,C2,K,N,LogOn,Failure", "3,short"]
    assert benign.auth_features(spark.createDataFrame([(x,) for x in lines], "value string")).first().features == {"auth_count": 2.0, "auth_fail": 1.0, "remote_auth": 1.0}
    f = spark.createDataFrame([(0, "1.5", "BENIGN"), (1, "2", "DDoS")], ["ordinal", " Flow Duration", " Label"])
    assert [(r.activity_id, r.features["Flow Duration"], r.features["Flow Bytes/s"]) for r in benign.flow_features(f, "ordinal").collect()] == [("cicids::0", 1.5, 0.0)]
    n = spark.createDataFrame([(0, "3", "x", "normal"), (1, "4", "y", "scan"), (2, "-", "z", "Normal")], ["ordinal", "bytes", "proto", "type"])
    assert [r.features for r in benign.network_features(n, "ordinal").collect()] == [{"bytes": 3.0}]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "attack", "T1003 credential dumping from lsass memory", ["T1003"]), (2, "cve", "remote services over smb", ["T1021", "T1003"]), (3, "cve", None, None)], "doc_id long, source string, text string, technique_ids array<string>")
    q = spark.createDataFrame([(7, "credential dumping from LSASS"), (8, " ")], "query_id long, text string")
    got = retrieval.tfidf_search(docs, q).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(7, 1)] and retrieval.tfidf_search(docs, q, sources=["cve"]).count() == 0 and retrieval.tfidf_search(docs.limit(0), q).count() == 0
    assert {tuple(r) for r in retrieval.by_technique(docs).collect()} == {("T1003", 1), ("T1003", 2), ("T1021", 2)}
    pack = retrieval.evidence_packages(docs, spark.createDataFrame([("T1021", "credential dumping")], "technique string, text string")).collect()
    assert {(r.doc_id, r.how) for r in pack} == {(2, "exact"), (1, "similar")}
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)] + [(99, [0.0, 0.0]), (100, None)], "vec_id long, embedding array<double>")
    best = retrieval.cosine_search(v, v.filter("vec_id in (0, 99)").withColumnRenamed("vec_id", "query_id"), 2, block=1).collect()
    assert {(r.query_id, r.vec_id) for r in best} == {(0, 0), (0, 3), (99, 0), (99, 1)}


def test_graphs(spark, spool):
    child = {**PROCESS, "ProcessGuid": "{c}", "ParentProcessGuid": "{proc-a}", "IntegrityLevel": "High", "UtcTime": T % 2}
    ev, m = build(spark, spool, [PROCESS, child, {"EventID": 11, "UtcTime": T % 3, "Hostname": "HOSTA", "ProcessGuid": "{c}", "TargetFilename": "C:\\a.exe"}])
    n = graph.node_index(sessions.session_entities(ev, m))
    e = graph.edge_list(sessions.session_edges(ev, m), n)
    f = graph.node_features(n, graph.degrees(n, e))
    assert len(f.columns) == 31 and f.count() == 3 and e.count() == 2 and graph.invalid_graphs(f, e).count() == 0
    r = {x.node: x for x in f.collect()}
    assert r[1].process_depth_log1p == 0.0 and r[0].integ_high == 1.0 and r[0].process_depth_log1p > 0 and r[2].is_executable == 1.0 and r[2].node_in_degree_log1p > 0
    w = graph.class_weights(spark.createDataFrame([("a",)] * 8 + [("b",)] * 24 + [("c",)], "y string"), "y").collect()
    assert [(x.label, x.class_id, round(x.weight, 4)) for x in w] == [("a", 0, 2.0), ("b", 1, 0.6667)]


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", '{"EventID": 1, "UtcTime": "2021-01-01 10:00:00", "n": null}\n\nnot json\n')
        z.writestr("skip.txt", "no")
    r = files.records(files.zipped_lines(spark, str(tmp_path)), "path", "member", "line_no").orderBy("seq").collect()
    assert [x.seq for x in r] == [1, 2] and [x.bad_json for x in r] == [False, True] and r[0].record == {"EventID": "1", "UtcTime": "2021-01-01 10:00:00"}
    meta = tmp_path / "datasets" / "q" / "_metadata"
    meta.mkdir(parents=True)
    (meta / "s.yaml").write_text("title: t\ntype: compound\nfiles:\n- {type: Host, link: 'http://h/Security-Datasets/master/d/x.zip'}\n- {type: Network, link: n}\nattack_mappings:\n- {technique: T1552, sub-technique: '004', tactics: [TA0006]}\n")
    (meta / "bad.yaml").write_text(": : :\n- [")
    s = files.scenarios(spark, str(tmp_path))
    assert [(x.scenario_id, x.links) for x in s.collect()] == [("s", ["http://h/Security-Datasets/master/d/x.zip"])]
    assert labels.label_sets(files.mappings_of(s)).first().sub_techniques == ["T1552.004"]
    assert files.resolve_links(s, files.manifest(spark, str(tmp_path))).first().path.endswith("x.zip")
    stix = {"objects": [{"type": "attack-pattern", "name": n, "external_references": [{"source_name": "o"}, {"source_name": "mitre-attack", "external_id": "T1"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "p"}]} for n in ("old", "new")]}
    (tmp_path / "stix.json").write_text(json.dumps(stix))
    t = files.stix_techniques(spark, str(tmp_path / "stix.json"))
    assert [(x.technique_id, x.name, x.tactics) for x in t.collect()] == [("T1", "new", ["p"])] and files.technique_documents(t).first().text == "T1 new. "


def test_streams(spark, tmp_path):
    rows = [("a", datetime(2021, 1, 1, 10, 0, 0), 1.0), ("a", datetime(2021, 1, 1, 10, 5, 0), 2.0), ("a", datetime(2021, 1, 1, 10, 11, 0), 3.0), ("b", datetime(2021, 1, 3), 9.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = gap_sessions(src(), "k", late="1 minute").writeStream.format("memory").queryName("gaps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("gaps").filter("k = 'a'").collect()) == [1, 2]
    q = running_scores(src(), "k", "v").writeStream.format("memory").queryName("z").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("z").count() == 4
