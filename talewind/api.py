"""The engine as an object: what a service would expose, without the service."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.operators import features, parse, retrieval, sessions, twin, ueba
from talewind.operators.attribution import Attribution, serve
from talewind.operators.incidents import follow_up
from talewind.sources import files
from talewind.sources.tables import ship_package
from talewind.spool import Spool

# Names of event sources.
SOURCES = ("OTRF", "WINDOWS", "LAB", "ZEEK", "SURICATA", "LANL", "CICIDS", "TONIOT", "BOTS")
SCORED = ["event_count", "process_access_count", "registry_mod_count", "failed_login_count", "network_flow_count"]


class Engine:
    """Holds what requests share: the model, the transition matrix, the documents, the topology and the scores' past."""

    def __init__(self, spark: SparkSession, model: Attribution | None = None, matrix: DataFrame | None = None, documents: DataFrame | None = None):
        ship_package(spark)
        self.spark, self.model, self.matrix, self.documents = spark, model, matrix, documents
        self.assets: DataFrame | None = None
        self.graph: DataFrame | None = None
        self.spool, self.past = Spool(spark, "engine"), []

    def health(self) -> dict:
        return {"status": "ok", "attribution_available": self.model is not None, "prediction_available": self.matrix is not None}

    def update_topology(self, assets: list[dict], edges: list[dict]) -> dict:
        """Replace the topology; a request that names no id, or an unknown asset, raises a ValueError and changes nothing."""
        as_map = "seq long, record map<string,string>"
        make = lambda rows: files.from_dicts(self.spark, rows) if rows else self.spark.createDataFrame([], as_map)
        nodes, links = twin.normalized(make([a for a in assets if isinstance(a, dict)]), make([e for e in edges if isinstance(e, dict)]))
        graph = self.spool.cut(twin.topology(nodes, links), "graph")
        self.assets, self.graph = self.spool.cut(nodes, "assets"), graph
        return {"status": "ok", "nodes": len(assets), "edges": len(edges)}

    def topology(self) -> dict:
        """The topology to show."""
        if self.graph is None:
            return {"nodes": [], "edges": []}
        nodes, links = twin.export(self.assets, self.graph)
        return {"nodes": [r.asDict() for r in nodes.orderBy("asset_id").collect()], "edges": [r.asDict() for r in links.orderBy("src", "dst").collect()]}

    def blast_radius(self, start: str) -> dict | None:
        """Assets within reach of one and the critical ones among them; null without a topology or for an unknown asset."""
        if self.graph is None:
            return None
        begin = self.assets.filter(F.col("asset_id") == start).select("asset_id")
        r = twin.blast_radius(twin.reach(self.graph, begin, self.spool), self.assets, begin).first()
        return None if r is None else {"reachable_count": r.reachable_count, "critical_reachable": r.critical_reachable}

    def sessions_of(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Session features of ``(seq, record)`` with start, end, host and number of events, and the parsed records."""
        parsed = self.spool.cut(parse.parse(records), "parsed")
        events = parse.kept(parsed)
        members = self.spool.cut(sessions.build_sessions(events, self.spool), "members")
        more = {"start": F.min("ts"), "end": F.max("ts"), "host": F.min("host"), "n_events": F.count("*"), "kind_rank": F.min(sessions.kind_rank())}
        rows = features.session_features(features.feature_inputs(events).join(members.select("seq", "kind", "session"), "seq"), "kind", "session", **more)
        return rows.withColumns({"event_count": F.col("n_events").cast("double"), "day": F.to_date("start"), "request": F.lit(len(self.past))}), parsed

    def incidents(self, rows: DataFrame) -> DataFrame:
        """Every session scored against the earlier ones of its host, this request's and the past ones', attributed and followed up."""
        keep = ["request", "host", "start", "kind_rank", "session", "kind", *SCORED]
        new = self.spool.cut(rows, "rows")
        every = reduce(DataFrame.unionByName, [*self.past, new.select(*keep)])
        z = ueba.scores(ueba.zscores(every, "host", ["request", "start", "kind_rank", "session"], SCORED, "request"), SCORED).filter(F.col("request") == len(self.past))
        self.past.append(new.select(*keep))
        scored = new.join(z.select("kind", "session", "score", "is_anomalous", "contributing"), ["kind", "session"])
        served = self.spool.cut(serve(self.model, scored), "served")
        named = retrieval.by_technique(self.documents) if self.documents is not None else self.spark.createDataFrame([], "technique string, doc_id long")
        return served.join(follow_up(self.matrix, named, served.select("technique")), "technique", "left")

    def ingest(self, events: list[dict], source: str = "OTRF", start: str | None = None) -> dict:
        """Parse and judge one request's events: how many were parsed and dropped, and one incident per session.

        An unknown source raises a ValueError.  ``start`` names the asset whose reach goes with attributed incidents.
        """
        if source not in SOURCES:
            raise ValueError(f"unknown source {source}")
        records = files.from_dicts(self.spark, events) if events else self.spark.createDataFrame([], "seq long, record map<string,string>")
        rows, parsed = self.sessions_of(records)
        count = files.validation(parsed).first()
        reach = self.blast_radius(start) if start is not None and self.model is not None else None
        out = self.incidents(rows).orderBy("kind_rank", "session").select(
            "host", F.struct("is_anomalous", "score", F.col("contributing").alias("contributing_features")).alias("anomaly"), F.struct("status", "technique", "confidence", F.col("top").alias("top_k")).alias("attribution"),
            F.coalesce(F.to_json("steps"), F.lit("[]")).alias("predicted_next"), F.coalesce("evidence", F.lit(False)).alias("evidence_available"))
        incidents = [{**r.asDict(recursive=True), "predicted_next": json.loads(r.predicted_next), "reach": reach if r.attribution.status == "ok" else None} for r in out.collect()]  # a request's own sessions
        return {"parsed_events": count.parsed, "dropped": count.dropped, "incidents": incidents}
