"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from talewind.functions.normalize import name_key, program_key
from talewind.llm.encoding import garbled_documents, restore
from talewind.llm.leakage import leaks, without_leaks
from talewind.llm.packing import pack, token_counts
from talewind.llm.repeats import collapse_runs
from talewind.llm.splits import related_groups, split_groups
from talewind.sources.tables import table
from talewind.spool import Spool

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
CAPACITY = 2048
VOCABULARY = os.environ.get("TALEWIND_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _groups(spark: SparkSession, sf: str, sp: Spool) -> DataFrame:
    fold = table(spark, sf, "fold_results").select("fold_id", name_key(F.col("held_out_group")).alias("held_out"))
    rec = table(spark, sf, "built_dataset").select("row_id", "fold_id", name_key(F.col("scenario_id")).alias("scenario"))
    return related_groups(rec.join(fold, "fold_id", "left"), sp, ["scenario", "held_out"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf, Spool(spark, "p3")).select("group_id", "row_id")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    sp = Spool(spark, "p3")
    return split_groups(sp.cut(_groups(spark, sf, sp), "grouped"), sp, SHARES)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "activity_events").select(
        F.col("activity_id").alias("entity"), F.unix_micros("timestamp").alias("ts_us"), F.col("step_key").alias("step"), "event_id", program_key(F.col("image")).alias("program"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_runs(_steps(spark, sf), Spool(spark, "p6")).filter("n >= 2").select("first_step", "last_step")


def p6_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_runs(_steps(spark, sf), Spool(spark, "p6")).select(
        F.col("entity").alias("activity_id"), "first_step", "n", ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"))


def p6_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Near-identical neighbours: same event or a like program, at most 300 s apart."""
    return collapse_runs(_steps(spark, sf), Spool(spark, "p6"), limit=0.6, gap_s=300).select(F.col("entity").alias("activity_id"), "first_step", "last_step", "n")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_counts(table(spark, sf, "documents").select("doc_id", "text"), "text", VOCABULARY)
    return pack(docs.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), Spool(spark, "p7"), CAPACITY).withColumnRenamed("item_id", "doc_id")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(table(spark, sf, "documents").select("doc_id", "n_chars"), _leaks(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_documents(table(spark, sf, "documents"), Spool(spark, "p9"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return restore(table(spark, sf, "documents"), Spool(spark, "p9"))


QUERIES = {
    "p3_found": p3_found, "p3_splits": p3_splits, "p6_found": p6_found, "p6_collapsed": p6_collapsed, "p6_similar": p6_similar, "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_longest": p8_longest, "p8_clean": p8_clean, "p9_found": p9_found, "p9_restored": p9_restored,
}

_RUNS = r"""
a as (select step_key, activity_id, epoch_us(timestamp) t, event_id, nullif(lower(trim(regexp_extract(image, '([^/\\]*)$', 1))), '') program from activity_events where timestamp is not null and activity_id is not null),
c as (select *, case when event_id = lag(event_id) over w and program = lag(program) over w then 0 else 1 end c from a window w as (partition by activity_id order by t, step_key)),
s as (select *, sum(c) over (partition by activity_id order by t, step_key rows unbounded preceding) s from c)"""

_LEAKS = r"""
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') w from documents where text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[k:k+11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d where len(w) >= 12)),
ig as (select item_id, array_to_string(w[k:k+11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i where len(w) >= 12)),
leak as (select distinct doc_id, item_id from dg join ig using (g))"""

ORACLE = {
    "p3_found": """with recursive n as (select b.row_id, unnest([lower(trim(b.scenario_id, chr(9) || chr(10) || chr(13) || ' ')), lower(trim(f.held_out_group, chr(9) || chr(10) || chr(13) || ' '))]) nm
 from built_dataset b left join fold_results f using (fold_id)),
m as (select distinct row_id, nm from n where nm is not null and nm not in ('', 'unknown', 'n/a')),
e as (select distinct x.nm a, y.nm b from m x join m y using (row_id)),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
f as (select nm, min(row_id) f from m group by nm),
g as (select r.a nm, min(f.f) g from r join f on f.nm = r.b group by r.a)
select coalesce(min(g.g), b.row_id) group_id, b.row_id from built_dataset b left join m using (row_id) left join g using (nm) group by b.row_id""",
    "p6_found": f"with {_RUNS} select min(step_key) first_step, max(step_key) last_step from s group by activity_id, s having count(*) >= 2",
    "p6_collapsed": f"with {_RUNS} select activity_id, min(step_key) first_step, count(*) n, (max(t) - min(t)) / 1000000.0::double duration_s from s group by activity_id, s",
    "p8_found": f"with {_LEAKS} select doc_id, item_id from leak",
    "p8_longest": f"""with {_LEAKS},
dk as (select doc_id, k, array_to_string(w[k:k+11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d where len(w) >= 12)),
ik as (select item_id, k, array_to_string(w[k:k+11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i where len(w) >= 12)),
hit as (select doc_id, item_id, dk.k dk, ik.k ik from dk join ik using (g)),
run as (select *, ik - row_number() over (partition by doc_id, item_id, dk - ik order by ik) r from hit),
whole as (select doc_id, item_id, count(*) + 11 longest, min(ik) - 1 item_word, min(dk) - 1 doc_word from run group by doc_id, item_id, dk - ik, r)
select doc_id, item_id, longest, item_word, doc_word from (select *, row_number() over (partition by doc_id, item_id order by longest desc, item_word, doc_word) n from whole) where n = 1""",
    "p8_clean": f"with {_LEAKS} select doc_id, n_chars from documents where doc_id not in (select doc_id from leak)",
}
