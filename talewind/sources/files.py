"""Readers of raw telemetry, corpora and scenario metadata, and the JSON sinks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.operators.sessions import dense
from talewind.spool import Spool

HOST_FILES = ("host", "windows", "endpoint")  # fixed values: kinds of scenario files that hold events


def zipped_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, member, line_no, line)`` of the .json, .ndjson and .jsonl members of archives below a folder, or of the given ones; blank lines are skipped.

    An archive can't be split, so it is the unit of parallelism; its lines are streamed out in blocks.
    """

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for where, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith((".json", ".ndjson", ".jsonl"))):
                        rows: list[tuple] = []
                        with z.open(name) as f:
                            for no, raw in enumerate(f):
                                line = raw.decode("utf-8", errors="replace").strip()
                                if line:
                                    rows.append((where, name, no, line))
                                if len(rows) >= 20_000:
                                    yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])
                                    rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["path", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(unzip, "path string, member string, line_no long, line string")


def text_lines(spark: SparkSession, path: str, names: str = "*.{json,ndjson}") -> DataFrame:
    """``(path, line_no, line)`` of .json and .ndjson files below a folder; ``line_no`` grows within a file."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    return t.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")).filter("trim(line) <> ''")


def records(lines: DataFrame, *order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(seq, record, bad_json, *keep)``: JSON objects as maps of strings with a dense number from 1 in the given order; null values are left out."""
    m = F.from_json("line", "map<string,string>")
    good = lines.withColumn("record", F.map_filter(m, lambda k, v: v.isNotNull()))
    split = good.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_at"), "record", *keep)
    numbered = dense(Spool(lines.sparkSession, "records").cut(split, "records"), "_at", "seq")
    return numbered.select((F.col("seq") + 1).alias("seq"), "record", F.col("record").isNull().alias("bad_json"), *keep)


def validation(parsed: DataFrame) -> DataFrame:
    """``(parsed, dropped, no_parser, no_timestamp)`` of :func:`talewind.operators.parse.parse`; a line that is no JSON is neither."""
    r = F.col("reason")
    return parsed.agg(
        F.count_if(r.isNull()).alias("parsed"), F.count_if(r.isin("malformed", "no_parser", "no_timestamp", "bad_timestamp")).alias("dropped"), F.count_if(r == "no_parser").alias("no_parser"), F.count_if(r == "no_timestamp").alias("no_timestamp"))


def from_dicts(spark: SparkSession, raw: list[dict]) -> DataFrame:
    """``(seq, record)`` of dicts in memory, in their order; null values are left out."""
    rows = [(i, {k: (v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)) for k, v in d.items() if v is not None}) for i, d in enumerate(raw)]
    return spark.createDataFrame(rows, "seq long, record map<string,string>")


def auth_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, names trimmed, and ``ordinal``: the number of the row, from 0, in the order of files and lines.

    Every split's rows are numbered where they are read; one row per split reaches the driver.
    """
    df = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").csv(path)
    names = [c.strip() for c in df.columns]
    df = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at")).toDF(*names, "_f", "_b", "_at")
    start, rows = 0, []
    for r in df.groupBy("_f", "_b").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_f", "_b").collect():
        rows.append((r["_f"], r["_b"], start - r["first"]))
        start += r["n"]
    off = spark.createDataFrame(rows, "_f string, _b long, _off long")
    return df.join(F.broadcast(off), ["_f", "_b"]).select(*(F.col(f"`{c}`") for c in names), (F.col("_at") + F.col("_off")).alias("ordinal"))  # one row per split


def scenarios(spark: SparkSession, root: str) -> DataFrame:
    """``(scenario_id, title, type, links, mappings)`` of the metadata files below ``root``; unreadable ones are skipped.

    ``links`` are the event archives among the files; ``mappings`` are (technique, sub_technique, tactics) in order.
    """
    schema = "scenario_id string, title string, type string, links array<string>, mappings array<struct<technique:string,sub_technique:string,tactics:array<string>>>"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    d = yaml.safe_load(content) or {}
                    name = d.get("id") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    links = [str(f.get("link")) for f in d.get("files") or [] if str(f.get("type", "")).lower() in HOST_FILES and f.get("link")]
                    maps = [{"technique": m.get("technique"), "sub_technique": m.get("sub-technique") or m.get("sub_technique"), "tactics": [str(t) for t in m.get("tactics") or []]} for m in d.get("attack_mappings") or []]
                    out.append((str(name), d.get("title"), d.get("type"), links, [{**m, "sub_technique": None if m["sub_technique"] is None else str(m["sub_technique"])} for m in maps]))
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["scenario_id", "title", "type", "links", "mappings"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.col("path").contains("/_metadata/")).select("path", "content").mapInPandas(read, schema)


def mappings_of(scen: DataFrame) -> DataFrame:
    """``(scenario_id, pos, technique, sub_technique, tactics)`` in order."""
    return scen.select("scenario_id", F.posexplode("mappings").alias("pos", "m")).select("scenario_id", "pos", "m.*")


def resolve_links(scen: DataFrame, archives: DataFrame) -> DataFrame:
    """``(scenario_id, url, path)``: a link's local file by its path below the download prefix, else the smallest path of that base name."""
    link = scen.select("scenario_id", F.explode("links").alias("link")).withColumn("tail", F.substring_index("link", "Security-Datasets/master/", -1)).withColumn("base", F.substring_index("link", "/", -1))
    a = archives.select("path").withColumn("base", F.substring_index("path", "/", -1))
    m = link.join(a, "base").withColumn("exact", F.expr("endswith(path, tail)"))
    return m.groupBy("scenario_id", "link").agg(F.min_by("path", F.struct(~F.col("exact"), F.col("path"))).alias("path")).select("scenario_id", F.col("link").alias("url"), "path")


def stix_techniques(spark: SparkSession, path: str) -> DataFrame:
    """``(technique_id, name, detection, tactics)`` of a STIX bundle; the last object of an id wins."""
    ref = "array<struct<source_name:string,external_id:string>>"
    schema = f"objects array<struct<type:string,name:string,x_mitre_detection:string,external_references:{ref},kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    o = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("objects").alias("pos", "o")).filter("o.type = 'attack-pattern'")
    ids = F.filter("o.external_references", lambda r: r.source_name == "mitre-attack")
    t = o.select("pos", F.get(ids, 0).external_id.alias("technique_id"), "o").filter("technique_id is not null")
    last = t.groupBy("technique_id").agg(F.max_by("o", "pos").alias("o"))
    tactics = F.transform(F.filter("o.kill_chain_phases", lambda p: p.kill_chain_name == "mitre-attack"), lambda p: p.phase_name)
    return last.select("technique_id", F.coalesce("o.name", F.lit("Unknown")).alias("name"), F.coalesce("o.x_mitre_detection", F.lit("")).alias("detection"), F.coalesce(tactics, F.array().cast("array<string>")).alias("tactics"))


def tactic_index(techniques: DataFrame) -> DataFrame:
    return techniques.select(F.explode("tactics").alias("tactic"), "technique_id").groupBy("tactic").agg(F.array_sort(F.collect_set("technique_id")).alias("techniques"))


def technique_documents(techniques: DataFrame) -> DataFrame:
    return techniques.select(F.col("technique_id").alias("doc_id"), F.lit("attack").alias("source"), F.concat(F.col("technique_id"), F.lit(" "), F.col("name"), F.lit(". "), F.col("detection")).alias("text"), F.array("technique_id").alias("technique_ids"))


def advisories(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One JSON document per file: ``text``, else ``summary``; empty ones are dropped; the id defaults to the file name."""
    j = spark.read.schema("id string, text string, summary string, technique_ids array<string>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("summary"))
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)
    return j.select(F.coalesce("id", name).alias("doc_id"), F.lit(source).alias("source"), text.alias("text"), F.coalesce("technique_ids", F.array().cast("array<string>")).alias("technique_ids")).filter("text is not null and text <> ''")


def corpus(*parts: DataFrame) -> DataFrame:
    """Document tables one after the other, with ``source_rank``."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_rank", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def activities(spark: SparkSession, path: str, names: str = "activity_*.json", whole: bool = True) -> DataFrame:
    """Stored activities, one a file or (``whole`` false) one a line; missing times are patched with the epoch."""
    a = spark.read.option("multiLine", str(whole).lower()).option("pathGlobFilter", names).option("recursiveFileLookup", "true").schema("activity_id string, scenario_id string, host string, start_time string, end_time string").json(path)
    patch = lambda c: F.coalesce(F.col(c).try_cast("timestamp"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return a.withColumns({c: patch(c) for c in ("start_time", "end_time")})


def manifest(spark: SparkSession, path: str, links: DataFrame | None = None) -> DataFrame:
    """``(scenario, url, path, bytes, sha256, downloaded_at)`` of files, the manifest of a download.

    ``links`` ``(scenario_id, url, path)`` say where files came from; others have a null scenario and url.  A file's
    time of change is the time it was downloaded.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("downloaded_at"))
    if links is None:
        return f.select(F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("url"), "path", "bytes", "sha256", "downloaded_at")
    return f.join(links.select(F.col("scenario_id").alias("scenario"), "url", "path"), "path", "left").select("scenario", "url", "path", "bytes", "sha256", "downloaded_at")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, through the file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
