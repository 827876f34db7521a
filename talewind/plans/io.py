"""Queries of sources, sinks and the labelled dataset: files are written from the tables and read back; and their SQL."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.operators import benign, evaluate, features, labels, parse, retrieval, transitions, ueba
from talewind.operators.attribution import Attribution, save_if_good
from talewind.operators.dataset import build_dataset, scenario_records
from talewind.operators.hygiene import Hygiene
from talewind.plans import reference, reference_sql as sql
from talewind.sources import files
from talewind.sources.tables import table
from talewind.spool import Spool


# ---- scenarios, archives, dataset ------------------------------------------------------------------------------
def _techniques(i: int) -> list[str]:
    """Techniques of the i-th host's scenario: none, one or two."""
    return [] if i % 4 == 0 else [f"T10{i % 7:02d}"] + (["T1110.001"] if i % 5 == 0 else [])


def _archives(spark: SparkSession, sf: str) -> str:
    """A folder with one scenario per host of ``process_entities``: its metadata and the archive of its creation records.

    The archives are written one after the other, one host's lines at a time.
    """
    root = Spool(spark, "archives").root
    p = table(spark, sf, "process_entities").filter("host is not null")
    record = F.struct(
        F.lit(1).alias("EventID"), F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UtcTime"), F.col("host").alias("Hostname"), F.col("proc_key").cast("string").alias("RecordNumber"), F.col("process_guid").alias("ProcessGuid"),
        F.col("process_id").cast("string").alias("ProcessId"), F.col("image").alias("Image"), F.col("command_line").alias("CommandLine"), F.col("parent_guid").alias("ParentProcessGuid"), F.col("parent_image").alias("ParentImage"), F.col("user_name").alias("User"))
    rows = p.select("host", "proc_key", F.to_json(record, {"ignoreNullFields": "false"}).alias("line")).orderBy("host", "proc_key")
    now, lines, i = None, [], 0

    def close() -> None:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("events.json", "\n".join([*lines, "", "no json"]))
            z.writestr("notes.txt", "not read")
        files.write_bytes(spark, f"{root}/datasets/host/{now}.zip", out.getvalue())
        maps = "".join(f"- {{technique: {t.split('.')[0]}, sub-technique: '{t.partition('.')[2]}', tactics: [TA000{i % 3}]}}\n" for t in _techniques(i))
        text = f"id: scn-{now}\ntitle: Host {now}\ntype: atomic\nfiles:\n- {{type: Host, link: 'https://example.org/raw/datasets/host/{now}.zip'}}\n- {{type: Network, link: 'https://example.org/{now}.pcap'}}\nattack_mappings:{chr(10) + maps if maps else ' []'}"
        files.write_bytes(spark, f"{root}/datasets/host/_metadata/{now}.yaml", text.encode())

    for r in rows.toLocalIterator():
        if r.host != now:
            if now is not None:
                close()
                i += 1
            now, lines = r.host, []
        lines.append(r.line)
    if now is not None:
        close()
    return root


def _scenarios(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Spool]:
    sp, root = Spool(spark, "dataset"), _archives(spark, sf)
    scen = sp.cut(files.scenarios(spark, root), "scenarios")
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(root).select("path")
    return scen, archives, sp


def source_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    scen = _scenarios(spark, sf)[0]
    return scen.select("scenario_id", "title", F.size("links").alias("n_links"), F.size("mappings").alias("n_mappings"))


def source_links(spark: SparkSession, sf: str) -> DataFrame:
    scen, archives, _ = _scenarios(spark, sf)
    return files.resolve_links(scen, archives).select("scenario_id", F.substring_index("path", "/", -1).alias("name"))


def source_zipped(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every archive, and how many are no JSON."""
    root = _archives(spark, sf)
    r = files.records(files.zipped_lines(spark, root).withColumn("name", F.substring_index("path", "/", -1)), "path", "member", "line_no", keep=("name",))
    return r.groupBy("name").agg(F.count("*").alias("n"), F.count_if("bad_json").alias("n_bad"), (F.max("seq") - F.min("seq") + 1).alias("span"))


def _dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Spool]:
    scen, archives, sp = _scenarios(spark, sf)
    rows, drops = build_dataset(scenario_records(spark, scen, archives), files.mappings_of(scen), sp)
    return sp.cut(rows, "dataset"), drops, sp


def dataset_build(spark: SparkSession, sf: str) -> DataFrame:
    """Archives and metadata to sessions with features, targets and evidence."""
    return _dataset(spark, sf)[0].drop("session", "techniques")


def dataset_drops(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf)[1]


def dataset_support(spark: SparkSession, sf: str) -> DataFrame:
    """Techniques by the number of distinct scenarios in the dataset."""
    d = _dataset(spark, sf)[0]
    return labels.label_space(d.select("scenario_id", "techniques"), 5)


def dataset_policy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.target_policy(_dataset(spark, sf)[0], "train_target")


def dataset_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the same 103 features: how many, in how many scenarios and with how many labels."""
    d = _dataset(spark, sf)[0]
    return evaluate.duplicate_vectors(d, list(features.FEATURES), "scenario_id", "y_primary").select("n", "n_groups", "n_labels")


# ---- lines, rows, documents ------------------------------------------------------------------------------------
def source_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Dicts in memory; ``region`` and ``nation`` never grow."""
    n = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    r = files.from_dicts(spark, [{"name": x.n_name, "region": x.n_regionkey, "none": None} for x in n])
    return r.select("seq", F.col("record")["name"].alias("name"), F.col("record")["region"].cast("long").alias("region"), F.size("record").alias("n_keys"))


def source_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of NDJSON files, parsed for validation only."""
    where = Spool(spark, "ndjson").path("lines")
    reference.records(spark, sf).select(F.to_json("record").alias("value")).write.text(where, lineSep="\n")
    lines = files.text_lines(spark, where, "*.txt")
    parsed = parse.parse(lines.select(F.col("line_no").alias("seq"), F.from_json("line", "map<string,string>").alias("record")).filter("record is not null"))
    return files.validation(parsed)


def source_auth(spark: SparkSession, sf: str) -> DataFrame:
    where = Spool(spark, "auth").path("auth")
    reference.auth_text(spark, sf).write.text(where)
    return reference.ragged(benign.auth_features(files.auth_lines(spark, where)), "auth_count", "auth_fail", "remote_auth")


def source_flows(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with blanks in its header; ids count all rows of all files."""
    where = Spool(spark, "flows").path("csv")
    rows = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag").select(
        F.col("l_quantity").cast("string").alias(" Flow Duration"), F.when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias(" Total Fwd Packets"), F.when(F.col("l_returnflag") == "N", " Benign ").otherwise("PortScan").alias(" Label"))
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(where)
    return reference.ragged(benign.flow_features(files.csv_rows(spark, where), "ordinal"), "Flow Duration", "Total Fwd Packets")


def source_network(spark: SparkSession, sf: str) -> DataFrame:
    where = Spool(spark, "network").path("csv")
    rows = table(spark, sf, "part").orderBy("p_partkey").select("p_size", F.when(F.col("p_size") > 25, F.col("p_retailprice").cast("string")).otherwise("-").alias("price"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "Normal").otherwise("ddos").alias("type"))
    rows.write.option("header", "true").csv(where)
    return reference.ragged(benign.network_features(files.csv_rows(spark, where), "ordinal"), "p_size", "price", "p_brand")


def _bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Techniques of a bundle made of ``nation``, which never grows; the first object of every id is superseded."""
    n = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    one = lambda x, name: {"type": "attack-pattern", "name": name, "x_mitre_detection": f"about {x.n_name}", "external_references": [{"source_name": "capec", "external_id": "C1"}, {"source_name": "mitre-attack", "external_id": f"T1{x.n_nationkey:03d}"}],
                           "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": f"phase{x.n_regionkey}"}, {"kill_chain_name": "other", "phase_name": "x"}]}
    where = Spool(spark, "stix").path("bundle.json")
    files.write_bytes(spark, where, json.dumps({"objects": [one(x, "old") for x in n] + [one(x, x.n_name) for x in n] + [{"type": "malware", "name": "m"}]}).encode())
    return files.stix_techniques(spark, where)


def source_stix(spark: SparkSession, sf: str) -> DataFrame:
    return _bundle(spark, sf).select("technique_id", "name", "detection", F.array_join("tactics", ",").alias("tactics"))


def source_tactics(spark: SparkSession, sf: str) -> DataFrame:
    return files.tactic_index(_bundle(spark, sf)).select("tactic", F.array_join("techniques", ",").alias("techniques"))


def source_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Techniques, then advisories (one document a file), as one table of documents."""
    sp = Spool(spark, "corpus")
    for r in table(spark, sf, "nation").collect():
        body = {"text": f"about {r.n_name}" if r.n_nationkey % 3 else "", "summary": f"summary {r.n_name}" if r.n_nationkey % 2 else None, "technique_ids": [f"T{r.n_regionkey}"]}
        files.write_bytes(spark, sp.path(f"advisories/a-{r.n_nationkey}.json"), json.dumps(body if r.n_nationkey % 5 else {**body, "id": f"id-{r.n_nationkey}"}).encode())
    c = files.corpus(files.technique_documents(_bundle(spark, sf)), files.advisories(spark, sp.path("advisories"), "advisory"))
    return c.select("doc_id", "source", "source_rank", "text", F.array_join("technique_ids", ",").alias("techniques"))


def source_activities(spark: SparkSession, sf: str) -> DataFrame:
    where = Spool(spark, "activities").path("json")
    a = table(spark, sf, "built_dataset").select("activity_id", "scenario_id", "host", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("start_time"), F.lit("").alias("end_time"))
    files.write_json(a, where)
    return files.activities(spark, where, "*.json", whole=False).select("activity_id", "host", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))


def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of the files of a download, written and read back."""
    sp = Spool(spark, "manifest")
    for r in table(spark, sf, "nation").collect():
        files.write_bytes(spark, sp.path(f"raw/{r.n_name}.txt"), f"about {r.n_name}".encode())
    here = spark.read.format("binaryFile").load(sp.path("raw")).select("path")
    links = here.select(F.concat(F.lit("scn-"), F.regexp_extract("path", r"([^/]*)\.txt$", 1)).alias("scenario_id"), F.concat(F.lit("https://example.org/"), F.substring_index("path", "/", -1)).alias("url"), "path")
    files.write_json(files.manifest(spark, sp.path("raw"), links), sp.path("manifest"))
    back = spark.read.schema("scenario string, url string, path string, bytes long, sha256 string, downloaded_at timestamp").json(sp.path("manifest"))
    return back.select("scenario", "url", "bytes", "sha256", F.col("downloaded_at").isNotNull().alias("dated"))


# ---- sinks -----------------------------------------------------------------------------------------------------
def sink_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The transition matrix written as one JSON document and read back."""
    sp = Spool(spark, "matrix")
    sp.commit_text("matrix.json", transitions.to_json(transitions.matrix(reference.steps(spark, sf)), 1))
    return transitions.from_json(spark, sp.read_text("matrix.json")).select("src", "dst", "support", F.round("prob", 6).alias("prob"))


def sink_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted hygiene written as JSON, read back and applied."""
    sp, rows = Spool(spark, "hygiene"), reference.hygiene_rows(spark, sf)
    sp.commit_text("hygiene.json", Hygiene().fit(rows, rows.columns).dumps())
    kept = Hygiene.loads(sp.read_text("hygiene.json")).transform(rows)
    return kept.agg(F.count("*").alias("n"), F.lit(",".join(kept.columns)).alias("columns"))


def sink_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Incident documents written as JSON lines and read back."""
    where = Spool(spark, "incidents").path("json")
    files.write_json(reference.incidents(spark, sf, None), where)
    back = spark.read.schema("kind string, session long, status string, incident string").json(where)
    return back.select("kind", "session", "status", F.get_json_object("incident", "$.n_events").cast("long").alias("n_events"), (F.get_json_object("incident", "$.anomaly.is_anomalous") == "true").alias("is_anomalous"))


def artifact_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A model behind the gate: held back, saved, loaded, and the loaded one compared with the fitted one on all rows."""
    v, names = reference.labelled_vectors(spark, sf)
    sp = Spool(spark, "artifact")
    m = Attribution(names).fit(v, "label", "grp")
    held = save_if_good(m, sp, "held.json", 0.30, [0.28, 0.1], 0.1) is None and Attribution.load(sp, "held.json") is None
    save_if_good(m, sp, "candidate.json", 0.34, [0.28, 0.1], 0.1)
    loaded = Attribution.load(sp, "candidate.json")
    both = m.predict(v).select("vec_id", F.col("proba").alias("p")).join(loaded.predict(v).select("vec_id", F.col("proba").alias("q")), "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("n_same"), F.lit(held).alias("held"), F.lit(len(loaded.classes)).cast("long").alias("n_classes"))


# ---- evaluation ------------------------------------------------------------------------------------------------
def _folds(spark: SparkSession, sf: str) -> DataFrame:
    return reference.predictions(spark, sf).withColumn("classes", F.array(*map(F.lit, reference.CLASSES)))


def loso_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every held-out group."""
    m = evaluate.fold_metrics(_folds(spark, sf))
    return m.select("group", "n_test", *(F.round(c, 6).alias(c) for c in ("macro_f1", "macro_precision", "macro_recall", "top3", "ece", "brier")))


def loso_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled metrics, means over folds and the majority baseline; the interval must hold the point, chance lies near 1 / classes."""
    p = _folds(spark, sf)
    r = evaluate.pooled(p, evaluate.fold_metrics(p))
    names = ["macro_f1", "macro_precision", "macro_recall", "mean_fold_macro_f1", "mean_fold_top3", "mean_fold_ece", "mean_fold_brier", "majority_macro_f1"]
    row = [round(float(r[n]), 6) for n in names] + [r["macro_f1_ci_lo"] <= r["macro_f1"] <= r["macro_f1_ci_hi"], abs(r["random_macro_f1"] - 0.2) < 0.1]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names) + ", interval_holds boolean, random_is_chance boolean")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a supported single technique, scored as the trainer does; event_count stands for accesses."""
    from talewind.functions.normalize import name_key

    d = table(spark, sf, "built_dataset").withColumn("scenario", name_key(F.col("scenario_id")))
    zero = F.lit(0.0)
    d = d.withColumns({"process_access_count": F.coalesce("event_count", F.lit(0)), "registry_mod_count": zero, "failed_login_count": zero, "network_flow_count": zero, "bucket": F.floor(F.col("row_id") / 1000)})
    return evaluate.supported_targets(ueba.trainer_scores(d.drop("event_count"), ["row_id"], "bucket"), "train_target", "scenario", 5)


def strategy_audit(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.strategy_audit(_targets(spark, sf), "train_target", "scenario", F.col("has_evidence"), F.col("score"), 0.25).withColumn("coverage", F.round("coverage", 4))


def class_retention(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_retention(_targets(spark, sf), "train_target", F.col("has_evidence")).withColumn("percent", F.round("percent", 4))


def strategy_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-scenario-group-out results of every strategy that is not skipped, on the dataset of the archives.

    Scenarios are held out in five groups by a hash of their name.
    """
    d = _dataset(spark, sf)[0].withColumn("grp", F.pmod(F.xxhash64("scenario_id"), F.lit(5)))
    t = evaluate.supported_targets(d, "train_target", "scenario_id", 3).withColumn("bucket", F.floor(F.col("session") / 1000))
    t = Spool(spark, "targets").cut(ueba.trainer_scores(t, ["session", "kind"], "bucket"), "targets")
    keep = dict(zip(evaluate.STRATEGIES, (F.lit(True), F.col("has_evidence"), F.col("score") >= 0.25)))
    out = []
    for r in evaluate.strategy_audit(t, "train_target", "scenario_id", F.col("has_evidence"), F.col("score"), 0.25).orderBy("position").collect():  # three rows
        if r.skipped:
            continue
        p = Spool(spark, "runs").cut(reference.leave_one_group_out(t.filter(keep[r.strategy]), list(features.FEATURES), "train_target", "grp"), "predictions")
        m = evaluate.pooled(p, evaluate.fold_metrics(p))
        if m:
            out.append((r.strategy, r.samples, r.scenarios, r.classes, *(float(m[k]) for k in ("macro_f1", "mean_fold_top3", "mean_fold_ece", "mean_fold_brier", "majority_macro_f1", "random_macro_f1"))))
    return spark.createDataFrame(out, "strategy string, samples long, scenarios long, classes long, macro_f1 double, top3 double, ece double, brier double, majority_f1 double, random_f1 double")


def retrieval_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors of two of the labels only."""
    v = table(spark, sf, "embeddings").withColumn("source", F.concat(F.lit("s"), F.col("label") % 4))
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.cosine_search(v, q, sources=["s1", "s2"]).select("query_id", "vec_id", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        source_scenarios, source_links, source_zipped, source_memory, source_ndjson, source_auth, source_flows, source_network, source_stix, source_tactics, source_corpus, source_activities, source_manifest,
        sink_matrix, sink_hygiene, sink_incidents, artifact_roundtrip, dataset_build, dataset_drops, dataset_support, dataset_policy, dataset_duplicates, loso_folds, loso_pooled, strategy_audit, class_retention, strategy_runs, retrieval_by_source)
}

_HOSTS = """hosts as (select host, row_number() over (order by host || '.zip') - 1 i, row_number() over (order by host) - 1 j from (select distinct host from process_entities where host is not null)),
tech as (select host, 'scn-' || host scenario_id, case when j % 4 = 0 then [] when j % 5 = 0 then ['T10' || lpad((j % 7)::varchar, 2, '0'), 'T1110'] else ['T10' || lpad((j % 7)::varchar, 2, '0')] end t from hosts)"""
_KEYS = {
    "ProcessGuid": "process_guid", "ProcessId": "process_id::varchar", "Image": "image", "CommandLine": "command_line", "ParentProcessGuid": "parent_guid", "ParentImage": "parent_image", "User": "user_name", "RecordNumber": "proc_key::varchar"}
_RAW = sql.EV.split("),\nnum as")[0]
_EV = sql.EV.replace(_RAW, f"""
{_HOSTS},
raw as (select row_number() over (order by p.host || '.zip', proc_key) seq, map {{{', '.join(f"'{k}': {v}" for k, v in _KEYS.items())}}} r, '1' e, recorded_at ts, p.host, '' sid, 'x' provider, 'y' channel
  from process_entities p join tech using (host) where len(tech.t) > 0""")


def _over_archives(statement: str) -> str:
    return statement.replace(sql.EV, _EV)


_BUILT = f"""{_over_archives(sql.FEAT)}, home as (select kind, session, min(host) host from members join ev using (seq) group by all)"""
_P5 = f"""{sql.PRED}, g as (select *, event_id % 5 grp from q),
k as (select distinct grp, unnest([y, pred]) k from g),
c as (select k.grp, k, count(*) filter (where y = k and pred = k) tp, count(*) filter (where y = k) t, count(*) filter (where pred = k) p from k join g on g.grp = k.grp group by all),
m as (select grp, avg(case when t + p > 0 then 2 * tp / (t + p)::double else 0 end) f, avg(case when p > 0 then tp / p::double else 0 end) pr, avg(case when t > 0 then tp / t::double else 0 end) re from c group by grp),
rk as (select grp, event_id, bool_or({sql.CLS}[i] = y and r <= 3) h, sum(power(pr[i] - case when {sql.CLS}[i] = y then 1 else 0 end, 2)) b from (select *, row_number() over (partition by event_id order by w[i] desc, i) r from (select *, unnest(range(1, 6)) i from g)) group by all),
rr as (select grp, avg(case when h then 1.0 else 0.0 end)::double top3, avg(b) brier, count(*) n from rk group by grp),
bn as (select grp, ceil(conf * 10) bin, count(*) n, avg(case when y = pred then 1.0 else 0.0 end) acc, avg(conf) cf from g group by all),
ec as (select grp, sum(n * abs(acc - cf)) / sum(n) ece from bn group by grp),
fold as (select grp, n, f, pr, re, top3, ece, brier from m join rr using (grp) join ec using (grp))"""
_SCEN = "case when lower(trim(scenario_id, chr(9) || chr(10) || chr(13) || ' ')) not in ('', 'unknown', 'n/a') then lower(trim(scenario_id, chr(9) || chr(10) || chr(13) || ' ')) end"
_TARGETS = f"""{sql.welford({'a': 'a'}, f"select *, coalesce(event_count, 0)::double a, {_SCEN} scenario from built_dataset", '1', 'row_id')},
scored as (select *, round(0.6 * least(1.0, least(abs(z_a), 10.0) / 5 / 6) + 0.2, 4) score from z),
sup as (select train_target from scored where train_target is not null group by 1 having count(distinct scenario) >= 5),
x as (select * from scored where train_target in (select train_target from sup))"""
_S = "count(*) samples, round(100.0 * count(*) / (select count(*) from x), 4)::double coverage, count(distinct scenario) scenarios, count(distinct train_target) classes"
_NOTE = "coalesce(nullif(case when n_nationkey % 3 <> 0 then ('about ' || n_name) else '' end, ''), case when n_nationkey % 2 = 1 then 'summary ' || n_name end)"

ORACLE = {
    "source_scenarios": f"with {_HOSTS} select scenario_id, 'Host ' || host title, 1::int n_links, len(t)::int n_mappings from tech",
    "source_links": f"with {_HOSTS} select scenario_id, host || '.zip' as \"name\" from tech",
    "source_zipped": "select host || '.zip' as \"name\", count(*) + 1 n, 1::bigint n_bad, count(*) + 1 span from process_entities where host is not null group by host",
    "source_memory": "select n_nationkey::bigint seq, n_name as \"name\", n_regionkey::bigint region, 2::int n_keys from nation",
    "source_ndjson": f"with {sql.EV} select count(*) filter (where reason is null) parsed, count(*) filter (where reason in ('malformed', 'no_parser', 'no_timestamp')) dropped, count(*) filter (where reason = 'no_parser') no_parser, count(*) filter (where reason = 'no_timestamp') no_timestamp from parsed",
    "source_flows": "select 'cicids::' || n activity_id, l_quantity::double flow_duration, case when l_linenumber = 2 then 0 else l_extendedprice end::double total_fwd_packets from (select *, row_number() over (order by l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag) - 1 n from lineitem) where l_returnflag = 'N'",
    "source_network": "select 'toniot::' || (n - 1) activity_id, p_size::double p_size, case when p_size > 25 then p_retailprice end::double price, null::double p_brand from (select *, row_number() over (order by p_partkey) n from part) where p_partkey % 2 = 0",
    "source_stix": "select 'T1' || lpad(n_nationkey::varchar, 3, '0') technique_id, n_name as \"name\", ('about ' || n_name) detection, 'phase' || n_regionkey tactics from nation",
    "source_tactics": "select 'phase' || n_regionkey tactic, string_agg('T1' || lpad(n_nationkey::varchar, 3, '0'), ',' order by n_nationkey) techniques from nation group by n_regionkey",
    "source_corpus": f"""select 'T1' || lpad(n_nationkey::varchar, 3, '0') doc_id, 'attack' source, 0::int source_rank, 'T1' || lpad(n_nationkey::varchar, 3, '0') || ' ' || n_name || '. ' || ('about ' || n_name) as "text", 'T1' || lpad(n_nationkey::varchar, 3, '0') techniques from nation
union all select case when n_nationkey % 5 = 0 then 'id-' else 'a-' end || n_nationkey, 'advisory', 1, {_NOTE}, 'T' || n_regionkey from nation where {_NOTE} is not null""",
    "source_activities": "select activity_id, host, coalesce(epoch_us(start_time), 0) start_us, 0::bigint end_us from built_dataset",
    "source_manifest": "select 'scn-' || n_name scenario, 'https://example.org/' || replace(n_name, ' ', '%20') || '.txt' url, length('about ' || n_name)::bigint as \"bytes\", sha256('about ' || n_name) \"sha256\", true dated from nation",
    "sink_hygiene": "select count(*) n, 'l_quantity,l_extendedprice,l_discount,l_tax' as \"columns\" from lineitem",
    "artifact_roundtrip": "select count(*) n, count(*) n_same, true held, count(distinct label) n_classes from embeddings",
    "dataset_build": f"""with recursive {_BUILT} select 'scn-' || host scenario_id, kind, feat.* exclude (kind, session), case when len(t) = 1 then t[1] end train_target, list_min(t) y_primary,
 (lsass_targeted_count > 0 or process_access_count > 0 or network_flow_count > 0 or registry_mod_count > 0 or failed_login_count > 0 or {sql.PROC}) has_evidence from feat join home using (kind, session) join tech using (host)""",
    "dataset_duplicates": f"""with recursive {_BUILT} select count(*) n, count(distinct host) n_groups, count(distinct list_min(t)) n_labels from feat join home using (kind, session) join tech using (host)
group by {', '.join(features.FEATURES)} having count(*) >= 2""",
    "dataset_drops": f"with {_EV} select reason, case when reason <> 'malformed' then eid end event_id, count(*) n from parsed where reason is not null group by 1, 2",
    "dataset_support": f"with recursive {_BUILT}, x as (select distinct host, unnest(t) technique from home join tech using (host)) select technique, count(*) n_scenarios, count(*) >= 5 supported from x group by technique",
    "dataset_policy": f"with recursive {_BUILT} select case when len(t) = 1 then 'single' else 'several' end as policy, count(*) n from home join tech using (host) group by 1",
    "loso_folds": f"with {_P5} select grp as \"group\", n n_test, round(f, 6) macro_f1, round(pr, 6) macro_precision, round(re, 6) macro_recall, round(top3, 6) top3, round(ece, 6) ece, round(brier, 6) brier from fold",
    "loso_pooled": f"""with {_P5}, a as (select k, sum(tp) tp, sum(t) t, sum(p) p from c group by k), w0 as (select avg(case when t + p > 0 then 2 * tp / (t + p)::double else 0 end) f, avg(case when p > 0 then tp / p::double else 0 end) pr, avg(case when t > 0 then tp / t::double else 0 end) re, max(t) mt, sum(t) st, count(*) nk from a)
select round(f, 6) macro_f1, round(pr, 6) macro_precision, round(re, 6) macro_recall, round((select avg(f) from fold), 6) mean_fold_macro_f1, round((select avg(top3) from fold), 6) mean_fold_top3, round((select avg(ece) from fold), 6) mean_fold_ece, round((select avg(brier) from fold), 6) mean_fold_brier,
 round(2 * mt / (mt + st)::double / nk, 6) majority_macro_f1, true interval_holds, true random_is_chance from w0""",
    "strategy_audit": f"""with {_TARGETS}, s as (select 0 as position, 'unfiltered' strategy, {_S} from x union all select 1, 'evidence', {_S} from x where has_evidence union all select 2, 'ueba', {_S} from x where score >= 0.25)
select position::int as position, strategy, samples, coalesce(coverage, 0) coverage, scenarios, classes, samples = 0 or scenarios < 2 or classes < 2 skipped from s""",
    "class_retention": f"with {_TARGETS} select train_target as \"label\", count(*) n, count(*) filter (where has_evidence) n_evidence, round(100.0 * count(*) filter (where has_evidence) / count(*), 4)::double as percent from x group by 1",
    "retrieval_by_source": """with s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) s from embeddings q join embeddings v on v.label % 4 in (1, 2) where q.vec_id % 50 = 0)
select query_id, vec_id, s score, rk as "rank" from (select *, row_number() over (partition by query_id order by s desc, vec_id) rk from s) where rk <= 5""",
}
ORACLE["source_auth"] = sql.ORACLE["benign_auth"]
ORACLE["sink_matrix"] = sql.ORACLE["transition_matrix"]
ORACLE["sink_incidents"] = f"with recursive {sql.UEBA_SCORED} select kind, session, 'model_unavailable' status, n_events::bigint n_events, 0.6 * s + 0.2 >= 0.5 is_anomalous from sc"
