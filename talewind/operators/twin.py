"""Reachability over an asset graph: bounded cheapest paths by relaxation, never by listing paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talewind.spool import Spool

# The cost of moving along an edge by technique.
COSTS = {"T1021": 1.0, "T1021.001": 1.2, "T1021.002": 1.0, "T1078": 0.8, "T1550": 0.9, "T1210": 1.5, "T1570": 1.3, "T1080": 2.0}
DEFAULT_COST, CUTOFF, HARDENED = 1.5, 10.0, 2.5


def edge_cost(technique: Column) -> Column:
    costs = F.create_map(*(x for k, v in COSTS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(costs[F.coalesce(technique, F.lit("T1021"))], F.lit(DEFAULT_COST))


# The names under which a request may give an asset's id and an edge's ends, in order of preference.
ASSET_ID = ("asset_id", "id")
FROM, TO = ("from_asset", "source_id", "from", "source"), ("to_asset", "target_id", "to", "target")


def normalized(assets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets ``(asset_id, tier)`` and edges ``(seq, src, dst, technique)`` of requests ``(seq, record map<string,string>)``.

    Stricter than :func:`topology`: an asset without an id, or an edge whose end is missing or no asset of the request,
    is an error that names it.  Of repeated assets the last counts.
    """
    first = lambda names: F.coalesce(*(F.nullif(F.col("record")[n], F.lit("")) for n in names))
    a = assets.select("seq", first(ASSET_ID).alias("asset_id"), F.col("record")["tier"].try_cast("int").alias("tier"))
    if not a.filter("asset_id is null").isEmpty():
        raise ValueError("an asset has neither asset_id nor id")
    e = edges.select("seq", first(FROM).alias("src"), first(TO).alias("dst"), F.col("record")["technique"].alias("technique"))
    known = a.select("asset_id").distinct()
    for end in ("src", "dst"):
        wrong = e.join(known.withColumnRenamed("asset_id", end), end, "left_anti").orderBy("seq").first()
        if wrong is not None:
            raise ValueError(f"the edge from {wrong.src!r} to {wrong.dst!r} names an unknown asset")
    return a.groupBy("asset_id").agg(F.max_by("tier", "seq").alias("tier")), e


def export(assets: DataFrame, graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The topology to show: nodes with their tier (3 where missing) and edges with their weight to 3 digits."""
    return assets.select("asset_id", F.coalesce("tier", F.lit(3)).alias("tier")), graph.select("src", "dst", "technique", F.round("weight", 3).alias("weight"))


def topology(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, technique, weight)`` from ``(seq, src, dst, technique)``: edges between known assets, the last of repeated pairs.

    No edges at all is an error.
    """
    if edges.isEmpty():
        raise ValueError("a topology needs edges")
    known = assets.select("asset_id")
    e = edges.join(known.withColumnRenamed("asset_id", "src"), "src", "left_semi").join(known.withColumnRenamed("asset_id", "dst"), "dst", "left_semi")
    last = e.groupBy("src", "dst").agg(F.max_by(F.struct(F.coalesce("technique", F.lit("T1021")).alias("technique")), "seq").alias("r")).select("src", "dst", "r.technique")
    return last.withColumn("weight", edge_cost(F.col("technique")))


def modify(graph: DataFrame, changes: list[dict]) -> DataFrame:
    """What-if changes in order: remove_edge, add_edge (weight 1.5), harden_node (2.5 times the cost of its in-edges)."""
    spark = graph.sparkSession
    for c in changes:
        a, b = c.get("from_asset"), c.get("to_asset")
        if c["op"] == "remove_edge":
            graph = graph.filter(~((F.col("src") == a) & (F.col("dst") == b)))
        elif c["op"] == "add_edge" and a and b:
            new = spark.createDataFrame([(a, b, "T1021", float(c.get("params", {}).get("weight", DEFAULT_COST)))], "src string, dst string, technique string, weight double")
            graph = graph.filter(~((F.col("src") == a) & (F.col("dst") == b))).unionByName(new)
        elif c["op"] == "harden_node":
            graph = graph.withColumn("weight", F.when(F.col("dst") == c["node_id"], F.col("weight") * HARDENED).otherwise(F.col("weight")))
    return graph


def reach(graph: DataFrame, starts: DataFrame, spool: Spool, cutoff: float = CUTOFF) -> DataFrame:
    """``(start, asset, cost, path, techniques)``: cheapest path of at most ``cutoff`` from every start, the start itself left out.

    Each round extends only what became cheaper in the round before and keeps one row per (start, asset), so cost
    follows reachable pairs and hops, not paths.  Among equal costs the path of fewer, then smaller names wins.
    """
    g = spool.cut(graph.select("src", "dst", F.col("technique").alias("t"), F.col("weight").cast("double").alias("w")), "graph")
    best = spool.cut(starts.select(F.col("asset_id").alias("start"), F.col("asset_id").alias("asset")).distinct().withColumns(
        {"cost": F.lit(0.0), "path": F.array("asset"), "techniques": F.array().cast("array<string>"), "fresh": F.lit(True)}), "reach")
    cheap = F.struct(F.round("cost", 9), F.size("path"), "path")
    while not best.filter("fresh").isEmpty():
        step = best.filter("fresh").join(g, F.col("asset") == F.col("src")).filter((F.col("cost") + F.col("w") <= cutoff + 1e-9) & ~F.array_contains("path", F.col("dst"))).select(
            "start", F.col("dst").alias("asset"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("techniques", F.col("t")).alias("techniques"), F.lit(True).alias("fresh"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(step)
        row = F.struct("cost", "path", "techniques", "fresh")
        # of equal rows the known one must win, or the loop would not end
        nxt = spool.cut(both.groupBy("start", "asset").agg(F.min_by(row, F.struct(cheap, "fresh")).alias("r")).select("start", "asset", "r.*"), "reach")
        spool.drop(best)
        best = nxt
    return best.filter("asset <> start").drop("fresh")


def critical_paths(reached: DataFrame, assets: DataFrame, k: int = 5) -> DataFrame:
    """Per start the k cheapest paths (cost to 2 digits) to assets of tier 0 or 1; a missing tier is 3."""
    c = reached.join(assets.select(F.col("asset_id").alias("asset"), F.coalesce("tier", F.lit(3)).alias("tier")), "asset", "left").filter("tier <= 1").withColumn("total_cost", F.round("cost", 2))
    w = Window.partitionBy("start").orderBy("total_cost", "asset")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("start", "asset", "total_cost", "path", "techniques", "rank")


def blast_radius(reached: DataFrame, assets: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, reachable_count, critical_reachable)``; a start that reaches nothing counts 0."""
    r = reached.join(assets.select(F.col("asset_id").alias("asset"), F.coalesce("tier", F.lit(3)).alias("tier")), "asset", "left").groupBy("start").agg(F.count("*").alias("n"), F.count_if(F.coalesce("tier", F.lit(3)) <= 1).alias("c"))
    return starts.select(F.col("asset_id").alias("start")).join(r, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("reachable_count"), F.coalesce("c", F.lit(0)).alias("critical_reachable"))
