"""Runs of repeated consecutive events in ordered sequences.

Neighbouring runs are merged most similar first (linked list and priority queue, complete linkage: two runs are as
similar as their least similar kinds of event) until no neighbours reach the similarity within the gap.  Among equally
similar neighbours a hash of the border's place decides, which scatters them.

Complete linkage makes every pair of neighbouring events that misses the limits a border no merge can ever cross, so a
sequence falls into stretches that are independent of each other.  Inside a stretch a border more similar than both
its neighbours goes first whatever happens elsewhere, since merging never makes a border more similar.  So sequences
are split over tasks by ranges of (entity, time, key), whatever their length; every task merges all that its edges
can't affect, and only the few runs left near the edges meet again: those whose borders grow steadily towards an edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from talewind.spool import Spool, partitions

_RUN = "entity string, first_step long, last_step long, n long, start_us long, end_us long, event_id long, program string"
_OUT = f"part int, place string, ord long, {_RUN}"
_MIXED = "lead long, kinds array<struct<event_id:long,program:string,n:long>>"


@lru_cache(maxsize=100_000)
def program_similarity(a: str, b: str) -> float:
    """Share of common character trigrams (Jaccard) of two program names."""
    if a == b:
        return 1.0
    x, y = ({f"  {s} "[i : i + 3] for i in range(len(s) + 1)} for s in (a, b))
    return len(x & y) / max(1, len(x | y))


def similarity(a: tuple, b: tuple) -> float:
    """Of two kinds of event (event_id, program): 1 if equal, else half for the event and half for the program's likeness."""
    if a == b:
        return 1.0
    return 0.5 * (a[0] == b[0]) + 0.5 * program_similarity(a[1], b[1])


def scatter(step: int) -> int:
    """A hash of a border's place: the step of the first event behind it."""
    x = (step + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def agglomerate(kinds: list, start: list[int], end: list[int], lead: list[int], limit: float, gap_us: int | None, open_left: bool = False, open_right: bool = False) -> list[list[int]]:
    """Merge neighbouring elements: a list of runs, each the list of its elements' positions, in order.

    ``kinds`` are sets of kinds of event, None is similar to nothing; ``lead`` is the step of an element's first
    event.  ``end`` is changed.  On an ``open`` side more elements follow that are not here: borders whose turn may
    depend on them are left alone.
    """
    n = len(kinds)
    runs = [[i] for i in range(n)]
    sets = list(kinds)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    stamp, blocked = [0] * n, [False] * (n + 1)
    queue: list[tuple[float, int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if sets[i] is None or sets[j] is None or gap_us is not None and start[j] - end[i] > gap_us:
            return
        if len(sets[i]) == 1 and sets[i] == sets[j]:
            s = 1.0
        elif limit >= 1.0:
            return
        else:
            s = min(similarity(x, y) for x in sets[i] for y in sets[j])
        if s >= limit:
            heapq.heappush(queue, (-s, scatter(lead[j]), i, j, stamp[i], stamp[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, _, i, j, si, sj = heapq.heappop(queue)
        if not (alive[i] and alive[j]) or stamp[i] != si or stamp[j] != sj:
            continue
        if open_left and i == 0 or open_right and right[j] < 0 or blocked[i] or blocked[right[j]]:
            blocked[j] = True  # the border before run j; its neighbours come after it
            continue
        runs[i] += runs[j]
        sets[i] = sets[i] | sets[j]
        end[i], alive[j], right[i] = max(end[i], end[j]), False, right[j]
        stamp[i] += 1
        if right[j] >= 0:
            left[right[j]] = i
            offer(i, right[j])
        if left[i] >= 0:
            offer(left[i], i)
    return [runs[i] for i in range(n) if alive[i]]


def _collapse(pdf: pd.DataFrame, gap_us: int | None) -> pd.DataFrame:
    """The agglomeration down to similarity 1: equal neighbours within the gap become one element."""
    known = (pdf["event_id"].notna() & pdf["program"].notna()).tolist()
    kinds = [{k} if ok else None for k, ok in zip(zip(pdf["entity"].tolist(), pdf["event_id"].tolist(), pdf["program"].tolist()), known)]
    runs = agglomerate(kinds, pdf["start_us"].tolist(), pdf["end_us"].tolist(), [0] * len(pdf), 1.0, gap_us)  # all ties, which merge in any order
    g = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    by = pdf.groupby(g, sort=True)
    more = {"lead": by["lead"].first(), "kinds": None} if "lead" in pdf else {}
    return pd.DataFrame({
        "entity": by["entity"].first(), "first_step": by["first_step"].min(), "last_step": by["last_step"].max(), "n": by["n"].sum(),
        "start_us": by["start_us"].min(), "end_us": by["end_us"].max(), "event_id": by["event_id"].first(), "program": by["program"].first(), **more}).reset_index(drop=True)


def _borders(el: pd.DataFrame, limit: float, gap_us: int | None) -> np.ndarray:
    """True where an element starts a new stretch."""
    ev, pr, en, st, ed = (el[c].tolist() for c in ("event_id", "program", "entity", "start_us", "end_us"))
    out = np.ones(len(el), bool)
    if limit >= 1.0:  # equal neighbours are one element already
        return out
    for i in range(1, len(el)):
        out[i] = not linked((en[i - 1], ev[i - 1], pr[i - 1], ed[i - 1]), (en[i], ev[i], pr[i], st[i]), limit, gap_us)
    return out


def linked(a: tuple, b: tuple, limit: float, gap_us: int | None) -> bool:
    """Whether two neighbours (entity, event_id, program, time) may stand in one run."""
    if a[0] != b[0] or any(x is None or x != x for x in (a[1], a[2], b[1], b[2])):
        return False
    if gap_us is not None and b[3] - a[3] > gap_us:
        return False
    return similarity((a[1], a[2]), (b[1], b[2])) >= limit


def _counts(row: tuple) -> dict | None:
    """Kinds of event of an element or run and how many events each has; None for an element without a kind."""
    if row[9] is not None:
        return {(k["event_id"], k["program"]): k["n"] for k in row[9]}
    return {(row[6], row[7]): row[3]} if isinstance(row[6], int) and isinstance(row[7], str) else None


def _merge_stretch(rows: list[tuple], limit: float, gap_us: int | None, open_left: bool = False, open_right: bool = False) -> list[tuple]:
    """Runs of one stretch of elements (in the order of ``_COLS``); a run's kind is its commonest, the smaller among equals."""
    if len(rows) == 1:
        return rows
    counts = [_counts(r) for r in rows]
    out = []
    for run in agglomerate([None if c is None else frozenset(c) for c in counts], [r[4] for r in rows], [r[5] for r in rows], [r[8] for r in rows], limit, gap_us, open_left, open_right):
        if len(run) == 1:
            out.append(rows[run[0]])
            continue
        part, n = [rows[i] for i in run], {}
        for i in run:
            for k, m in counts[i].items():
                n[k] = n.get(k, 0) + m
        top = min(n, key=lambda k: (-n[k], k))
        kinds = [{"event_id": e, "program": p, "n": m} for (e, p), m in n.items()]
        out.append((part[0][0], min(r[1] for r in part), max(r[2] for r in part), sum(r[3] for r in part), min(r[4] for r in part), max(r[5] for r in part), *top, part[0][8], kinds))
    return out


_COLS = ["entity", "first_step", "last_step", "n", "start_us", "end_us", "event_id", "program", "lead", "kinds"]


def _rows(el: pd.DataFrame) -> list[tuple]:
    return list(zip(*(el[c].tolist() for c in _COLS)))


def _dicts(kinds) -> list[dict] | None:
    """Kinds as they come back from Spark."""
    if kinds is None or isinstance(kinds, float):
        return None
    return [k if isinstance(k, dict) else dict(zip(("event_id", "program", "n"), k)) for k in kinds]


def _frame(rows: list[tuple], like: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS).astype(like[_COLS].dtypes.to_dict())


def _closed(el: pd.DataFrame, cuts: np.ndarray, limit: float, gap_us: int | None) -> pd.DataFrame:
    """Runs of whole stretches; a stretch of one element needs no queue."""
    starts = np.flatnonzero(cuts)
    size = np.diff(np.append(starts, len(el)))
    single = el.iloc[starts[size == 1]]
    rows: list[tuple] = []
    every = _rows(el) if (size > 1).any() else []
    for s, k in zip(starts[size > 1], size[size > 1]):
        rows += _merge_stretch(every[s : s + k], limit, gap_us)
    return pd.concat([single, _frame(rows, el)], ignore_index=True) if rows else single


#: An open stretch is merged, but for its edges, whenever it has grown by this many elements.
_OPEN = 20_000


def collapse_runs(events: DataFrame, spool: Spool, limit: float = 1.0, gap_s: float | None = None) -> DataFrame:
    """One row per run of ``(entity, ts_us, step, event_id, program)``: entity, first and last step, n, start and end, its commonest kind.

    Events are ordered by (ts_us, step) within their entity; rows with a null time or entity are left out.  An event
    without event_id or program is similar to nothing: it is a run of its own.  ``first_step`` and ``last_step`` are
    the smallest and largest step of the run.  ``limit`` 1 joins equal neighbours only; less joins near-identical
    ones.  Equal times are no gap.  No rows give no rows.
    """
    spark, gap_us = spool.spark, None if gap_s is None else int(gap_s * 1_000_000)
    plain = limit >= 1.0  # every run is of one kind
    cols = _COLS[:-2] if plain else _COLS
    rows = events.filter("entity is not null and ts_us is not null").select(
        "entity", "ts_us", F.col("step").cast("long").alias("step"), F.col("event_id").cast("long").alias("event_id"), "program")
    rows = rows.repartitionByRange(partitions(spark), "entity", "ts_us", "step").sortWithinPartitions("entity", "ts_us", "step").withColumn("part", F.spark_partition_id())

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # elements of the stretch that is still open
        part, order, first, size = 0, 0, True, 0

        def out(df: pd.DataFrame, place: str) -> pd.DataFrame:
            nonlocal order
            if place == "inside" and not plain:
                df = df.assign(kinds=None)
            df = df[cols].assign(part=part, place=place, ord=np.arange(order, order + len(df)))
            order += len(df)
            return df[["part", "place", "ord", *cols]]

        def merged(el: pd.DataFrame, open_left: bool, open_right: bool) -> pd.DataFrame:
            """An open stretch with all merged that does not depend on what lies beyond its open sides."""
            return el if plain else _frame(_merge_stretch(_rows(el), limit, gap_us, open_left, open_right), el)

        def closed(el: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            cuts = np.zeros(len(el), bool)
            cuts[starts] = True
            return out(_closed(el, cuts, limit, gap_us), "inside")

        for pdf in filter(len, frames):
            part = int(pdf["part"].iloc[0])
            one = pd.DataFrame({"entity": pdf["entity"], "first_step": pdf["step"], "last_step": pdf["step"], "n": 1, "start_us": pdf["ts_us"], "end_us": pdf["ts_us"], "event_id": pdf["event_id"].astype("Int64"), "program": pdf["program"].astype(object).where(pdf["program"].notna(), None)})
            if not plain:
                one = one.assign(lead=pdf["step"].fillna(0).astype("int64"), kinds=None)
            if held:  # only the last open element can go on, and it is never merged before its stretch ends
                last = held.pop()
                one = pd.concat([last.iloc[-1:], one], ignore_index=True)
                if len(last) > 1:
                    held.append(last.iloc[:-1])
            el = _collapse(one, gap_us)
            starts = np.flatnonzero(_borders(el.astype({"event_id": object}).where(el.notna(), None), limit, gap_us))
            if len(starts) > 1:
                whole = pd.concat([*held, el.iloc[: starts[1]]], ignore_index=True)
                yield out(merged(whole, True, False), "head") if first else closed(whole, starts[:1])
                if len(starts) > 2:
                    yield closed(el.iloc[starts[1] : starts[-1]].reset_index(drop=True), starts[1:-1] - starts[1])
                first, held, size = False, [], 0
            held.append(el.iloc[starts[-1] :].reset_index(drop=True))
            if sum(map(len, held)) > size + _OPEN:
                held = [merged(pd.concat(held, ignore_index=True), first, True)]
                size = len(held[0])
        if held:
            yield out(merged(pd.concat(held, ignore_index=True), first, True), "whole" if first else "tail")

    got = spool.cut(rows.mapInPandas(inside, _OUT if plain else f"{_OUT}, {_MIXED}"), "runs")
    edge = got.filter("place <> 'inside'")
    seam = F.struct("entity", "event_id", "program", "start_us", "end_us")  # the outermost elements of a task, which are never merged in it
    ends = edge.groupBy("part", "place").agg(F.min_by(seam, "ord").alias("a"), F.max_by(seam, "ord").alias("b")).collect()  # at most two rows a task
    rank = {"head": 0, "whole": 0, "tail": 1}
    chain, table, before = 0, [], None
    for r in sorted(ends, key=lambda r: (r.part, rank[r.place])):
        here = (r.a.entity, r.a.event_id, r.a.program, r.a.start_us)
        joins = before is not None and before[0] != (r.part, "head") and linked(before[1], here, limit, gap_us)
        chain += not joins
        table.append((r.part, r.place, chain))
        before = ((r.part, r.place), (r.b.entity, r.b.event_id, r.b.program, r.b.end_us))
    chains = spark.createDataFrame(table, "part int, place string, chain int")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "ord"], ignore_index=True)
        kinds = [None] * len(pdf) if plain else list(map(_dicts, pdf["kinds"]))
        el = pdf.assign(lead=0)[_COLS[:-1]] if plain else pdf[_COLS]
        el = el.assign(event_id=pdf["event_id"].astype("Int64"), program=pdf["program"].astype(object).where(pdf["program"].notna(), None), kinds=pd.Series(kinds, dtype=object))
        return _frame(_merge_stretch(_rows(el), limit, gap_us), el).drop(columns=["lead", "kinds"])

    mended = edge.join(F.broadcast(chains), ["part", "place"]).groupBy("chain").applyInPandas(across, _RUN)
    return got.filter("place = 'inside'").select(*_COLS[:-2]).unionByName(mended)
