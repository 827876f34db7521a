"""Graphs of sessions: indexed nodes with their features, typed edges, degrees, and class bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Parts of registry paths and operations that features look for, in order.
RUN_KEYS = ("run", "runonce", "startup", "currentversion\\windows")
EXCLUSIONS = ("exclusions", "windows defender")
WRITES = ("setvalue", "createkey", "write", "modify")
# Node kinds and edge kinds in order.
KINDS = ("process", "file", "registry", "network", "user", "service")
RELATIONS = ("spawned", "loaded", "connected_to", "created_file", "modified_registry", "accessed_process")


def _rank(kind: str = "kind"):
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(F.col(kind) == k, i).otherwise(out)
    return out


def node_index(entities: DataFrame) -> DataFrame:
    """``(session, entity_id, kind, attributes, node)``: ids sorted within their kind, kinds in order, the first kind of an id wins."""
    e = entities.groupBy("session", "entity_id").agg(F.min_by(F.struct("kind", "attributes"), _rank()).alias("r")).select("session", "entity_id", "r.*")
    w = Window.partitionBy("session").orderBy(_rank(), "entity_id")
    return e.withColumn("node", F.row_number().over(w) - 1)


def edge_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(session, a, b, type)`` as node numbers; dangling and unknown relations are dropped."""
    at = nodes.select("session", "entity_id", "node")
    types = F.create_map(*(x for i, r in enumerate(RELATIONS) for x in (F.lit(r), F.lit(i))))
    return (
        edges.join(at.select("session", F.col("entity_id").alias("src"), F.col("node").alias("a")), ["session", "src"])
        .join(at.select("session", F.col("entity_id").alias("dst"), F.col("node").alias("b")), ["session", "dst"])
        .select("session", "a", "b", types[F.col("rel")].alias("type")).filter("type is not null"))


def degrees(nodes: DataFrame, edge_list: DataFrame) -> DataFrame:
    """``(session, node, in_log, out_log)``: log1p of degrees."""
    o = edge_list.groupBy("session", F.col("a").alias("node")).agg(F.count("*").alias("o"))
    i = edge_list.groupBy("session", F.col("b").alias("node")).agg(F.count("*").alias("i"))
    z = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)))
    return nodes.select("session", "node").join(i, ["session", "node"], "left").join(o, ["session", "node"], "left").select("session", "node", z("i").alias("in_log"), z("o").alias("out_log"))


def node_features(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """The 29 features of every node.  Depth of a process is 1 (log1p) where its parent is a node of the session."""
    a, k = F.col("attributes"), F.col("kind")
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    low = lambda key: F.lower(F.coalesce(a[key], F.lit("")))
    process, registry = k == "process", k == "registry"
    integ, hive, path = low("integrity"), F.upper(F.coalesce(a["hive"], F.lit(""))), low("key_path")
    has = lambda h: one(F.coalesce(a["hashes"], F.lit("")).contains(f'"{h}"'))
    any_ = lambda c, *ps: _contains(c, ps)
    system, high = integ.contains("system"), integ.contains("high")
    hklm = hive.contains("HKLM") | hive.contains("LOCAL_MACHINE")
    tcp = low("protocol").contains("tcp")
    parents = nodes.filter("kind = 'process'").select("session", F.col("entity_id").alias("up"), F.lit(1.0).alias("depth"))
    n = nodes.withColumn("up", F.concat(F.lit("proc_"), a["parent_guid"])).join(parents, ["session", "up"], "left")
    cols = {f"is_{x}": one(k == x) for x in KINDS} | {
        "integ_system": one(process & system), "integ_high": one(process & ~system & high), "integ_medium_low": one(process & ~system & ~high),
        "is_executable": one((k == "file") & (low("extension").isin("exe", "dll", "sys") | F.coalesce(a["type"].isin("Executable", "Module"), F.lit(False)))),
        "cmd_len_log1p": F.when(process, F.log1p(F.length(F.coalesce(a["command_line"], F.lit(""))))).otherwise(0.0), "process_depth_log1p": F.when(process, F.log1p(F.coalesce("depth", F.lit(0.0)))).otherwise(0.0),
        "has_sha1": has("SHA1"), "has_md5": has("MD5"), "has_sha256": has("SHA256"), "net_tcp": one((k == "network") & tcp), "net_udp": one((k == "network") & ~tcp & low("protocol").contains("udp")),
        "reg_hive_hklm": one(registry & hklm), "reg_hive_hkcu": one(registry & ~hklm & (hive.contains("HKCU") | hive.contains("CURRENT_USER"))),
        "reg_is_run_key": one(registry & any_(path, *RUN_KEYS)), "reg_is_service_key": one(registry & path.contains("services")),
        "reg_is_defender_exclusion": one(registry & any_(path, *EXCLUSIONS)), "reg_op_write": one(registry & any_(low("operation"), *WRITES)),
        "reg_path_depth_log1p": F.when(registry, F.log1p(F.length(path) - F.length(F.translate(path, "\\/", "")))).otherwise(0.0),
        "user_is_elevated": one((k == "user") & (a["elevated"] == "true")), "user_logon_interactive": one((k == "user") & a["logon_type"].isin("2", "10")), "user_logon_network": one((k == "user") & (a["logon_type"] == "3")),
    }
    return n.select("session", "node", *(c.alias(x) for x, c in cols.items())).join(degree, ["session", "node"]).withColumnsRenamed({"in_log": "node_in_degree_log1p", "out_log": "node_out_degree_log1p"})


def _contains(c, patterns):
    out = c.contains(patterns[0])
    for p in patterns[1:]:
        out |= c.contains(p)
    return out


def invalid_graphs(features: DataFrame, edge_list: DataFrame) -> DataFrame:
    """``(session, problem)``: edges out of bounds and values that are no numbers; empty for sound graphs."""
    cols = [c for c in features.columns if c not in ("session", "node")]
    bad = features.filter(F.greatest(*(F.when(F.isnan(c) | F.col(c).isNull(), 1).otherwise(0) for c in cols)) == 1).select("session", F.lit("value").alias("problem"))
    size = features.groupBy("session").agg(F.count("*").alias("n"))
    out = edge_list.join(size, "session", "left").filter("n is null or a < 0 or b < 0 or a >= n or b >= n").select("session", F.lit("edge").alias("problem"))
    return bad.unionByName(out).distinct()


def content_hashes(features: DataFrame, edge_list: DataFrame, digits: int = 6) -> DataFrame:
    """``(session, hash)``: a digest of a graph's node features and typed edges in their order; equal graphs have equal ones."""
    cols = [c for c in features.columns if c not in ("session", "node")]
    x = features.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("node", *(F.round(c, digits).alias(c) for c in cols)))).alias("x"))  # a session's own nodes
    e = edge_list.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("a", "b", "type"))).alias("e"))
    return x.join(e, "session", "left").select("session", F.sha2(F.to_json(F.struct("x", F.coalesce("e", F.array().cast("array<struct<a:int,b:int,type:int>>")).alias("e"))), 256).alias("hash"))


def conflicts(hashes: DataFrame, label: str) -> DataFrame:
    """``(hash, n, n_labels)`` of contents that carry more than one label."""
    return hashes.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_labels")).filter("n_labels > 1")


def label_map(graphs: DataFrame, label: str) -> DataFrame:
    """``(label, class_id)``: labels numbered in sorted order; a missing one is ``unknown``."""
    d = graphs.select(F.coalesce(F.col(label), F.lit("unknown")).alias("label")).distinct()
    return d.withColumn("class_id", F.row_number().over(Window.orderBy("label")) - 1)  # one row per label


def class_weights(graphs: DataFrame, label: str, least: int = 8) -> DataFrame:
    """``(label, n, class_id, weight)`` of classes with at least ``least`` graphs, numbered in sorted order, inversely weighted."""
    c = graphs.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    every = Window.partitionBy()
    return c.withColumn("class_id", F.row_number().over(Window.orderBy("label")) - 1).withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
