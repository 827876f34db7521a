"""Queries of the telemetry pipeline's operators, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.functions.normalize import name_key
from talewind.operators import benign, evaluate, features, graph, labels, parse, retrieval, sessions, transitions, twin, ueba
from talewind.operators.attribution import Attribution, leave_one_group_out, serve
from talewind.operators.incidents import follow_up
from talewind.operators.hygiene import Hygiene, correlations
from talewind.operators.session_store import bridge, local_sessions
from talewind.sources.tables import table
from talewind.spool import Spool


# ---- records, parsing, sessions --------------------------------------------------------------------------------
def records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records ``(seq, record)`` rebuilt from the event table; null values are absent keys."""
    ev = table(spark, sf, "canonical_events")
    envelope = F.create_map(
        F.lit("@timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit("Hostname"), F.col("host"), F.lit("RecordNumber"), F.col("event_source_id"),
        F.lit("Provider_Name"), F.col("provider"), F.lit("Channel"), F.col("channel"))
    return ev.select("seq", F.map_filter(F.map_concat(F.coalesce("raw_event", F.create_map().cast("map<string,string>")), envelope), lambda k, v: v.isNotNull()).alias("record"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return parse.kept(parse.parse(records(spark, sf)))


def parse_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("seq", "event_id", F.unix_micros("ts").alias("ts_us"), "host", "event_source_id", "provider", "channel")


def parse_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return parse.drop_counts(parse.parse(records(spark, sf)))


_ATTRS = (
    "guid", "pid", "image", "command_line", "parent_guid", "parent_image", "user", "integrity", "hashes", "company", "original_filename", "source_ip", "dest_ip", "source_port", "dest_port", "protocol", "path", "type", "extension",
    "hive", "key_path", "value_name", "operation", "sid", "account", "domain", "logon_id", "logon_type", "authentication_package", "elevated")


def parse_entities(spark: SparkSession, sf: str) -> DataFrame:
    return parse.entities(_events(spark, sf)).select("seq", "kind", "entity_id", *(F.col("attributes")[a].alias(a) for a in _ATTRS))


def parse_edges(spark: SparkSession, sf: str) -> DataFrame:
    return parse.edges(_events(spark, sf)).select("seq", "src", "rel", "dst")


def _built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Spool]:
    sp = Spool(spark, "sessions")
    ev = sp.cut(_events(spark, sf), "parsed")
    return ev, sp.cut(sessions.build_sessions(ev, sp), "members"), sp


def _narrow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Spool]:
    """Like :func:`_built`, but of the records only what sessions and features need is ever written."""
    sp = Spool(spark, "sessions")
    ev = sp.cut(features.feature_inputs(sessions.slim(_events(spark, sf), "record")), "inputs")
    return ev, sp.cut(sessions.build_sessions(ev, sp), "members"), sp


def session_members(spark: SparkSession, sf: str) -> DataFrame:
    return _narrow(spark, sf)[1].select("seq", "kind", "session")


def session_process_tree(spark: SparkSession, sf: str) -> DataFrame:
    sp = Spool(spark, "tree")
    t = sessions.process_trees(sessions.process_nodes(sp.cut(sessions.slim(_events(spark, sf)), "slim")), sp)
    return t.select("host", "guid", "seq", "root_seq", "is_root", "is_orphan")


def session_table(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, _ = _narrow(spark, sf)
    return sessions.session_table(m).select("kind", "session", "host", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events", "kind_rank")


def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, _ = _narrow(spark, sf)
    return sessions.session_stats(sessions.session_table(m))


def session_ownership(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.ownership_violations(_narrow(spark, sf)[1])


def session_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest sessions that are no logon sessions."""
    ev, m, _ = _narrow(spark, sf)
    return sessions.session_table(m).orderBy(F.desc("n_events"), "kind", "session").limit(10).filter("kind <> 'logon'").select("kind", "session", "n_events")


def session_event_histogram(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, _ = _narrow(spark, sf)
    return sessions.event_histogram(m)


def session_entities(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, _ = _built(spark, sf)
    return sessions.session_entities(ev, m).select("session", "kind", "entity_id", "seq")


def session_edges(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, _ = _built(spark, sf)
    return sessions.session_edges(ev, m)


def _gap(spark: SparkSession, sf: str, gap_s: int) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros("ts").alias("ts_us"), F.col("event_id").alias("seq"))
    return bridge(local_sessions(e, ["key"], gap_s), gap_s).select(F.col("key").cast("long").alias("user_id"), "start_us", "end_us", "n_events")


def session_gap_300(spark: SparkSession, sf: str) -> DataFrame:
    return _gap(spark, sf, 300)


def session_gap_12h(spark: SparkSession, sf: str) -> DataFrame:
    return _gap(spark, sf, 43_200)


def session_gap_audit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("host"), F.unix_micros("ts").alias("ts_us"), F.col("event_id").alias("seq"))
    return sessions.gap_audit(e, 43_200)


# ---- features ---------------------------------------------------------------------------------------------------
def _features(spark: SparkSession, sf: str) -> DataFrame:
    ev, m, sp = _narrow(spark, sf)
    return features.session_features(ev.drop("host", "guid", "parent", "source", "lid").join(m.select("seq", "kind", "session"), "seq"), "kind", "session")


def features_all(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


def evidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("kind", "session", features.evidence().alias("has_evidence"), features.evidence(lsass=False, access=False, network=False).alias("has_narrow"))


def feature_basename_ext(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "activity_events").groupBy(F.lower(features.basename(F.col("image"))).alias("base"), F.lower(parse.extension(F.col("image"))).alias("ext")).agg(F.count("*").alias("n"))


def dataset_audit(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.dataset_audit(_features(spark, sf), list(features.FEATURES))


def hash_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Hash lists written out and read back."""
    p = table(spark, sf, "process_entities").filter("hashes is not null")
    text = F.array_join(F.transform(F.map_entries("hashes"), lambda e: F.concat(e.key, F.lit(" = "), e.value)), ",")
    return p.select("proc_key", parse.hashes(text).alias("h")).select("proc_key", F.col("h")["SHA1"].alias("sha1"), F.col("h")["MD5"].alias("md5"), F.size("h").alias("n"))


# ---- labels -----------------------------------------------------------------------------------------------------
def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """One scenario per (source, author): the techniques of its documents, the sub-technique from the document's number."""
    d = table(spark, sf, "documents").filter("author is not null and source is not null").select(F.concat_ws("|", "source", "author").alias("scenario_id"), F.explode("technique_ids").alias("technique"), F.when(F.col("doc_id") % 3 == 0, F.lpad((F.col("doc_id") % 5).cast("string"), 3, "0")).alias("sub_technique"), F.array("lang").alias("tactics"))
    return labels.label_sets(d)


def label_sets(spark: SparkSession, sf: str) -> DataFrame:
    j = lambda c: F.array_join(c, ",").alias(c)
    return labels.check_benign(_labels(spark, sf), "OTRF").select("scenario_id", j("techniques"), j("sub_techniques"), j("tactics"))


def label_space(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_space(_labels(spark, sf))


def label_project(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.transform("technique_ids", labels.parent).alias("techniques"))
    return labels.project(d, labels.label_space(_labels(spark, sf), 40), "doc_id").select("doc_id", F.array_join("projected", ",").alias("projected"))


def label_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *labels.targets(F.array_sort(F.array_distinct("technique_ids"))))


# ---- benign corpora ---------------------------------------------------------------------------------------------
def ragged(df: DataFrame, *names: str) -> DataFrame:
    return df.select("activity_id", *(F.col("features")[n].alias(n.lower().replace(" ", "_").replace("/", "_")) for n in names))


def auth_text(spark: SparkSession, sf: str) -> DataFrame:
    """Authentication lines ``(value)`` made of the logons."""
    line = F.concat_ws(",", F.col("user_key").cast("string"), F.coalesce("account_name", F.lit("?")), F.coalesce("account_name", F.lit("?")), "host", F.when(F.col("user_key") % 2 == 0, F.col("host")).otherwise("dc"), F.lit("Kerberos"), F.coalesce(F.col("logon_type").cast("string"), F.lit("")), F.lit("LogOn"), F.when(F.col("user_key") % 3 == 0, "Failure").otherwise("Success"))
    return table(spark, sf, "user_entities").select(line.alias("value"))


def benign_auth(spark: SparkSession, sf: str) -> DataFrame:
    return ragged(benign.auth_features(auth_text(spark, sf)), "auth_count", "auth_fail", "remote_auth")


def benign_flows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_quantity").cast("string").alias(" Flow Duration"), F.when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("Total Fwd Packets"),
        F.when(F.col("l_returnflag") == "N", " Benign ").otherwise("PortScan").alias(" Label"))
    return ragged(benign.flow_features(rows, "ordinal"), *benign.FLOW_COLUMNS)


def benign_network(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_size") > 25, F.col("p_retailprice").cast("string")).otherwise("-").alias("price"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "Normal").otherwise("ddos").alias("type"))
    return ragged(benign.network_features(rows, "ordinal"), "size", "price", "p_brand")


# ---- anomaly scores ---------------------------------------------------------------------------------------------
def _user_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", F.unix_micros("ts").alias("us"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_date("ts").alias("day"))


def ueba_welford(spark: SparkSession, sf: str) -> DataFrame:
    z = ueba.zscores(_user_values(spark, sf), "user_id", ["us", "event_id"], ["value", "k"], "day")
    return z.select("event_id", F.round("z_value", 5).alias("z_value"), F.round("z_k", 5).alias("z_k"))


def ueba_untrained(spark: SparkSession, sf: str) -> DataFrame:
    z = ueba.scores(ueba.zscores(_user_values(spark, sf), "user_id", ["us", "event_id"], ["value"], "day"), ["value"])
    return z.groupBy("user_id").agg(F.count_if("is_anomalous").alias("n_anomalous"), F.round(F.sum(F.abs("z_value")), 4).alias("sum_z"), F.count_if(F.size("contributing") > 0).alias("n_contributing"))


def ueba_contributing(spark: SparkSession, sf: str) -> DataFrame:
    """The features that stand out, by event."""
    z = ueba.scores(ueba.zscores(_user_values(spark, sf), "user_id", ["us", "event_id"], ["value", "k"], "day"), ["value", "k"])
    return z.select("event_id", F.array_join("contributing", ",").alias("contributing"))


UEBA = ["event_count", "process_access_count", "registry_mod_count", "failed_login_count", "network_flow_count"]


def _ueba_sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, Spool]:
    """Features and the session table in one aggregate."""
    ev, m, sp = _narrow(spark, sf)
    table_ = {"start": F.min("ts"), "end": F.max("ts"), "host": F.min("host"), "n_events": F.count("*"), "kind_rank": F.min(sessions.kind_rank())}
    f = features.session_features(ev.join(m.select("seq", "kind", "session"), "seq"), "kind", "session", **table_)
    return sp.cut(f.withColumn("event_count", F.col("n_events").cast("double")).withColumn("day", F.to_date("start")), "features"), sp


def ueba_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions scored in output order per host, by a forest that is not trained yet."""
    f, _ = _ueba_sessions(spark, sf)
    z = ueba.scores(ueba.zscores(f, "host", ["start", "kind_rank", "session"], UEBA, "day"), UEBA)
    return z.select("kind", "session", F.round("stat_score", 5).alias("stat_score"), "is_anomalous")


def ueba_trained(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's own rule: one stream of sessions in output order, the forest retrained as it goes."""
    f, sp = _ueba_sessions(spark, sf)
    order = ["start", "kind_rank", "session"]
    z = sp.cut(ueba.scores(ueba.zscores(f, "host", order, UEBA, "day"), UEBA).select("kind", *order, "stat_score", "contributing", *UEBA), "scored")
    return ueba.serial_scores(z, UEBA, order).select("kind", "session", "score", "is_anomalous")


def ueba_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form: sessions of the later half are scored by a forest of the earlier half."""
    f, sp = _ueba_sessions(spark, sf)
    order = ["start", "kind_rank", "session"]
    z = sp.cut(ueba.scores(ueba.zscores(f, "host", order, UEBA, "day"), UEBA).select("kind", *order, "is_anomalous", *UEBA, *(f"z_{u}" for u in UEBA)), "scored")
    half = z.select(F.percentile_approx(F.unix_micros("start"), 0.5)).first()[0] or 0
    late = z.filter(F.unix_micros("start") > half)
    return ueba.scores(ueba.with_forest(late, UEBA, z.filter(F.unix_micros("start") <= half), order), UEBA, "if_score").select("kind", "session", "score", "is_anomalous")


# ---- hygiene, metrics, audits -----------------------------------------------------------------------------------
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def hygiene_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with a scaled, a constant and an artefact column."""
    return table(spark, sf, "lineitem").select(*_NUM, (F.col("l_quantity") * 3).alias("scaled"), F.lit(7.0).alias("fixed"), F.col("l_tax").alias("vmware_tools_flag"))


def hygiene_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = hygiene_rows(spark, sf)
    h = Hygiene().fit(rows, rows.columns)
    out = [(c, s) for s, cs in (("kept", h.kept), ("artefact", h.artefacts), ("constant", h.constant), ("correlated", h.correlated)) for c in cs]
    return spark.createDataFrame(out, "column string, status string")


def hygiene_corr(spark: SparkSession, sf: str) -> DataFrame:
    rho = correlations(table(spark, sf, "lineitem"), _NUM)
    return spark.createDataFrame([(a, b, round(float(rho[i, j]), 5)) for i, a in enumerate(_NUM) for j, b in enumerate(_NUM) if i < j], "a string, b string, rho double")


CLASSES = ["click", "error", "purchase", "signup", "view"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities made of whole numbers from the event's id, so that every engine agrees on them."""
    w = [(F.col("event_id") * (i + 3)) % 97 + 1 for i in range(len(CLASSES))]
    total = sum(w[1:], w[0])
    return table(spark, sf, "events").select((F.col("event_id") % 5).alias("group"), F.col("event_type").alias("y"), F.array(*(x / total for x in w)).alias("proba")).withColumn("pred", evaluate.predicted(CLASSES))


def metrics_macro(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro(predictions(spark, sf))


def metrics_topk(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.top_k(predictions(spark, sf), CLASSES)


def metrics_ece(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibration_error(predictions(spark, sf))


def metrics_brier(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.brier(predictions(spark, sf), CLASSES)


def metrics_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(predictions(spark, sf), CLASSES)


def metrics_majority(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.majority(predictions(spark, sf))


def dup_vector_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "built_dataset").withColumn("scenario", name_key(F.col("scenario_id")))
    return evaluate.duplicate_vectors(r, ["event_count", "has_evidence"], "scenario", "y_primary").select("n", "n_groups", "n_labels")


def evidence_retention(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.evidence_report(table(spark, sf, "built_dataset"), "y_primary", F.col("has_evidence"))


# ---- transitions, twin ------------------------------------------------------------------------------------------
def steps(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 0, "").otherwise(F.concat("event_type", F.lit("."), F.col("event_id") % 3))
    return transitions.multistage(transitions.sequences(table(spark, sf, "events").select(F.col("user_id").alias("scenario_id"), F.col("event_id").alias("pos"), t.alias("technique"))))


def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.matrix(steps(spark, sf)).select("src", "dst", "support", F.round("prob", 6).alias("prob"))


def next_step_topk(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.next_steps(transitions.matrix(steps(spark, sf)), 3).select("src", "dst", "rank", "support")


def predict_next(spark: SparkSession, sf: str) -> DataFrame:
    """Likely steps after every technique, asked for by a sub-technique, and after an unknown one."""
    m = transitions.matrix(steps(spark, sf))
    asked = m.select(F.concat("src", F.lit(".001")).alias("technique")).distinct().unionByName(spark.createDataFrame([("none",)], "technique string"))
    return transitions.predict(m, asked).select("technique", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s.technique, s.support)), ",").alias("steps"))


def _twin(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("a"))
    assets = n.select(F.col("a").alias("asset_id"), (F.col("a") % 4).alias("tier"))
    two = n.select(F.col("a").alias("src"), ((2 * F.col("a") + 1) % 25).alias("dst")).unionByName(n.select(F.col("a").alias("src"), ((3 * F.col("a") + 2) % 25).alias("dst"))).distinct().filter("src <> dst")
    names = F.array(*map(F.lit, twin.COSTS))
    return assets, two.select((F.col("src") * 25 + F.col("dst")).alias("seq"), "src", "dst", names[(F.col("src") + F.col("dst")) % 8].alias("technique")), n.select(F.col("a").alias("asset_id"))


def _reach(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    assets, edges, starts = _twin(spark, sf)
    return twin.reach(twin.topology(assets, edges), starts, Spool(spark, "twin")), assets, starts


def twin_reach(spark: SparkSession, sf: str) -> DataFrame:
    return _reach(spark, sf)[0].select("start", "asset", F.round("cost", 3).alias("cost"))


def twin_critical(spark: SparkSession, sf: str) -> DataFrame:
    r, assets, _ = _reach(spark, sf)
    return twin.critical_paths(r, assets).select("start", "asset", "total_cost", "rank")


def twin_blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    return twin.blast_radius(*_reach(spark, sf))


def twin_request(spark: SparkSession, sf: str) -> DataFrame:
    """A request in other spellings, normalised and shown as the topology it gives."""
    assets, edges, _ = _twin(spark, sf)
    text = lambda c: F.col(c).cast("string")
    a = assets.select(F.col("asset_id").alias("seq"), F.when(F.col("asset_id") % 2 == 0, F.create_map(F.lit("id"), text("asset_id"), F.lit("tier"), text("tier"))).otherwise(F.create_map(F.lit("asset_id"), text("asset_id"), F.lit("tier"), text("tier"))).alias("record"))
    e = edges.select("seq", F.create_map(F.lit("from"), text("src"), F.lit("target_id"), text("dst"), F.lit("technique"), F.col("technique")).alias("record"))
    nodes, links = twin.normalized(a, e)
    shown = twin.export(nodes, twin.topology(nodes, links))[1]
    return shown.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "technique", "weight")


def twin_whatif(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest paths after an edge is cut, one is added and an asset is hardened."""
    assets, edges, starts = _twin(spark, sf)
    g = twin.topology(assets, edges)
    g = twin.modify(g, [{"op": "remove_edge", "from_asset": 1, "to_asset": 3}, {"op": "add_edge", "from_asset": 24, "to_asset": 7}, {"op": "harden_node", "node_id": 5}])
    return twin.reach(g, starts, Spool(spark, "twin")).select("start", "asset", F.round("cost", 3).alias("cost"))


# ---- retrieval, graphs, attribution -----------------------------------------------------------------------------
def retrieval_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return retrieval.cosine_search(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", "vec_id", "score", "rank")


def retrieval_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.tfidf_search(table(spark, sf, "documents").select("doc_id", "text", "source"), q).select("query_id", "rank", "doc_id", "score")


def retrieval_by_technique(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.by_technique(table(spark, sf, "documents"))


def evidence_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name a technique, and the most similar ones that don't, for every technique of the corpus."""
    d = table(spark, sf, "documents").select("doc_id", "text", "technique_ids")
    asked = retrieval.by_technique(d).select("technique").distinct().withColumn("text", F.concat(F.lit("technique "), "technique"))
    return retrieval.evidence_packages(d, asked)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Spool]:
    ev, m, sp = _built(spark, sf)
    nodes = sp.cut(graph.node_index(sessions.session_entities(ev, m)), "nodes")
    return nodes, sp.cut(graph.edge_list(sessions.session_edges(ev, m, nodes), nodes), "edges"), sp


def graph_node_index(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[0].select("session", "entity_id", "kind", "node")


def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf)
    return graph.degrees(nodes, edges).select("session", "node", F.round("in_log", 6).alias("in_log"), F.round("out_log", 6).alias("out_log"))


def graph_node_features(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf)
    f = graph.node_features(nodes, graph.degrees(nodes, edges))
    return f.withColumns({c: F.round(c, 6) for c in f.columns if c.endswith("log1p")})


def graph_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return graph.class_weights(table(spark, sf, "built_dataset"), "y_primary").withColumn("weight", F.round("weight", 6))


def graph_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of all session graphs; there are none."""
    nodes, edges, _ = _graph(spark, sf)
    return graph.invalid_graphs(graph.node_features(nodes, graph.degrees(nodes, edges)), edges)


def graph_content(spark: SparkSession, sf: str) -> DataFrame:
    """How many sessions share their graph's content, and in how many kinds."""
    nodes, edges, _ = _graph(spark, sf)
    h = graph.content_hashes(graph.node_features(nodes, graph.degrees(nodes, edges)), edges)
    return h.groupBy("hash").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_contents"))


def graph_label_map(spark: SparkSession, sf: str) -> DataFrame:
    return graph.label_map(table(spark, sf, "built_dataset").select(name_key(F.col("scenario_id")).alias("scenario")), "scenario")


def graph_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents with more than one label, on records hashed by their size and evidence."""
    d = table(spark, sf, "built_dataset").select(F.sha2(F.concat_ws("|", F.coalesce("event_count", F.lit(-1)), F.coalesce(F.col("has_evidence").cast("string"), F.lit("?"))), 256).alias("hash"), "y_primary")
    return graph.conflicts(d, "y_primary").select("n", "n_labels")


def parse_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times in ten spellings, a general one among them, read back; every tenth one has no date."""
    ev = table(spark, sf, "canonical_events").filter("timestamp is not null").select("seq", F.date_trunc("second", "timestamp").alias("t"))
    spell = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "MMM d yyyy HH:mm:ss", "EEE, d MMM yyyy HH:mm:ss Z", "yyyy/M/d H:mm:ss", "yyyyMMddHHmmss", "d MMMM yyyy, HH:mm:ss", "HH:mm:ss"]
    text = F.coalesce(*(F.when(F.col("seq") % 10 == i, F.date_format("t", f)) for i, f in enumerate(spell)))
    rec = ev.select("seq", F.create_map(F.lit("EventID"), F.lit("1"), F.when(F.col("seq") % 3 == 0, "UtcTime").when(F.col("seq") % 3 == 1, "EventTime").otherwise("SystemTime"), text).alias("record"))
    return parse.parse(rec, general=True).select("seq", "reason", F.unix_micros("ts").alias("ts_us"))


def session_position(spark: SparkSession, sf: str) -> DataFrame:
    _, m, sp = _narrow(spark, sf)
    return sessions.with_position(sessions.session_table(m), sp).select("kind", "session", "position")


def session_tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    sp = Spool(spark, "tree")
    return sessions.tree_stats(sessions.process_trees(sessions.process_nodes(sp.cut(sessions.slim(_events(spark, sf)), "slim")), sp))


def labelled_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """``(vec_id, features..., label, grp)`` of all values of the embeddings, and the features' names."""
    e = table(spark, sf, "embeddings")
    names = [f"f{i:02d}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)), F.concat(F.lit("T"), F.col("label")).alias("label"), (F.col("vec_id") % 5).alias("grp")), names


def attribution_loso(spark: SparkSession, sf: str) -> DataFrame:
    v, names = labelled_vectors(spark, sf)
    return leave_one_group_out(v, names, "label", "grp").select("group", "y", "pred", F.round(F.array_max("proba"), 4).alias("confidence"))


def incidents(spark: SparkSession, sf: str, model: Attribution | None) -> DataFrame:
    """Parse, sessions, features, anomaly and attribution; where a technique is known, the steps that follow it and whether there is evidence; one JSON document a session."""
    f, _ = _ueba_sessions(spark, sf)
    z = serve(model, ueba.scores(ueba.zscores(f, "host", ["start", "kind_rank", "session"], UEBA, "day"), UEBA))
    after = follow_up(transitions.matrix(steps(spark, sf)), retrieval.by_technique(table(spark, sf, "documents")), z.select("technique"))
    z = z.join(F.broadcast(after), "technique", "left")  # one row per technique of the model
    body = F.to_json(F.struct(
        "host", "start", "end", "n_events", F.struct("score", "is_anomalous", "contributing").alias("anomaly"), F.struct("status", "technique", "confidence", "top").alias("attribution"),
        F.col("steps").alias("predicted_next"), F.coalesce("evidence", F.lit(False)).alias("evidence_available")))
    return z.select("kind", "session", "status", body.alias("incident"))


def incident_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain by a model fitted on the labelled dataset of the archives."""
    from talewind.plans import io

    rows, _, _ = io._dataset(spark, sf)
    model = Attribution(list(features.FEATURES)).fit(rows, "train_target", "scenario_id")
    return incidents(spark, sf, model)


QUERIES = {
    f.__name__: f
    for f in (
        parse_events, parse_drop_reasons, parse_entities, parse_edges, session_members, session_process_tree, session_table, session_stats, session_ownership, session_top10, session_event_histogram, session_entities,
        session_edges, session_gap_300, session_gap_12h, session_gap_audit, features_all, evidence_filter, feature_basename_ext, dataset_audit, hash_fields, label_sets, label_space, label_project, label_targets,
        benign_auth, benign_flows, benign_network, ueba_welford, ueba_untrained, ueba_sessions, ueba_trained, hygiene_columns, hygiene_corr, metrics_macro, metrics_topk, metrics_ece, metrics_brier, metrics_confusion,
        metrics_majority, dup_vector_audit, evidence_retention, transition_matrix, next_step_topk, twin_reach, twin_critical, twin_blast_radius, retrieval_cosine, retrieval_tfidf, retrieval_by_technique,
        graph_node_index, graph_degrees, graph_node_features, graph_class_weights, graph_content, graph_label_map, graph_conflicts, attribution_loso, incident_report, ueba_batches, twin_request, twin_whatif, parse_times,
        session_position, session_tree_stats, predict_next, evidence_packages, graph_invalid, ueba_contributing)
}
