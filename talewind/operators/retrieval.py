"""Ranked retrieval over documents: TF-IDF and vectors by blocks of queries, exact technique look-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: English function words left out of the vocabulary; a parameter of :func:`vocabulary`.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before", "but", "by", "can", "each", "for", "from", "had", "has", "have", "how", "if", "in", "into", "is", "it",
    "its", "more", "most", "no", "not", "of", "on", "one", "only", "or", "other", "over", "same", "so", "some", "such", "than", "that", "the", "their", "then", "there", "these", "they", "this", "to", "under",
    "until", "up", "was", "were", "what", "when", "which", "while", "who", "will", "with", "would", "yet",
)


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of at least two letters, digits or underscores, in order; stop words left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda t: ~t.isin(*stop))


def vocabulary(docs: DataFrame, text: str, size: int = 4096) -> list[tuple[str, float]]:
    """``(term, idf)`` of the ``size`` terms of most occurrences (smaller first among equals), with smoothed idf, over all documents.

    Occurrences are counted inside their tasks; what moves is a row per term and task.
    """
    t = F.col("t")
    both = F.concat(F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))), F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    some = docs.filter(F.col(text).isNotNull())
    n = some.count()
    v = some.select(tokens(F.col(text)).alias("t")).select(F.inline(both)).groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "term").limit(size)
    return [(r.term, float(np.log((1 + n) / (1 + r.df)) + 1)) for r in v.collect()]  # at most ``size`` rows


def _vectors(lists: list, at: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """Rows of tf times idf, each of length 1 (0 where no term is known)."""
    out = np.zeros((len(lists), len(idf)))
    for i, ts in enumerate(lists):
        for t in ts if ts is not None else ():
            if (j := at.get(t)) is not None:
                out[i, j] += 1
    out *= idf
    return _unit(out)


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int = 5, size: int = 4096, sources: list[str] | None = None, block: int = 1_000) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: top documents of ``(doc_id, text[, source])`` for each ``(query_id, text)``.

    Document vectors are made in place, a few hundred at a time; the stated query set goes to the tasks in blocks, and
    every task keeps its k best per query, so what is shuffled is k rows per query and task.  The source filter acts
    before the cut, the vocabulary (``size`` terms, a parameter) is that of all documents.  Blank queries and an empty
    corpus give no rows, and so do documents that share no term with a query.
    """
    vocab = vocabulary(docs, "text", size)
    at, idf = {t: i for i, (t, _) in enumerate(vocab)}, np.array([w for _, w in vocab])
    some = docs.filter("text is not null") if sources is None else docs.filter(F.col("text").isNotNull() & F.col("source").isin(sources))
    some = some.select("doc_id", tokens(F.col("text")).alias("t"))
    schema, out = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double", None

    def against(rows: list) -> DataFrame:
        ids, q = np.array([r.query_id for r in rows], object), _vectors([r.t for r in rows], at, idf)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in frames:
                for i in range(0, len(pdf), 256):
                    part = pdf.iloc[i : i + 256]
                    s = np.round(q @ _vectors(part["t"].tolist(), at, idf).T, 6)
                    which = np.argsort(-s, axis=1, kind="stable")[:, : min(len(part), k + 8)] if len(part) > k + 8 else np.broadcast_to(np.arange(len(part)), s.shape)
                    low = np.take_along_axis(s, which, 1).min(1, keepdims=True)
                    row, col = np.nonzero((s > 0) & (s >= low))  # all that can be among the best, ties included
                    got = pd.DataFrame({"query_id": ids[row], "doc_id": part["doc_id"].to_numpy()[col], "score": s[row, col]})
                    best = got if best is None else pd.concat([best, got], ignore_index=True)
                    if len(best) > 50_000:
                        best = _top(best, k)
            if best is not None:
                yield _top(best, k)

        return some.mapInPandas(run, schema)

    held: list = []
    for r in queries.filter("text is not null").select("query_id", tokens(F.col("text")).alias("t")).toLocalIterator():
        if any(t in at for t in r.t):
            held.append(r)
        if len(held) == block:
            out, held = against(held) if out is None else out.unionByName(against(held)), []
    if held or out is None:
        more = against(held) if held else docs.sparkSession.createDataFrame([], schema)
        out = more if out is None else out.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2_000, sources: list[str] | None = None) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: nearest ``(vec_id, embedding)`` of each ``(query_id, embedding)`` by cosine.

    The stated query set goes to the tasks in blocks of ``block``; every task keeps its k best per query, so what is
    shuffled is k rows per query and task.  With ``sources`` only vectors of these count, before the cut at k; the
    filter reaches the scan.  A zero vector has cosine 0 with everything; null vectors are left out.
    """
    out, held = None, []
    if sources is not None:
        vectors = vectors.filter(F.col("source").isin(sources))

    def against(rows: list) -> DataFrame:
        ids = np.array([r.query_id for r in rows], np.int64)
        q = _unit(np.array([r.embedding for r in rows], np.float64))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in frames:
                if not len(pdf):
                    continue
                x = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                s = np.round(q @ x.T, 6)
                vid = pdf["vec_id"].to_numpy()
                order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
                got = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": vid[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                best = got if best is None else pd.concat([best, got])
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")

    for r in queries.filter("embedding is not null").select("query_id", "embedding").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = against(held) if out is None else out.unionByName(against(held)), []
    if held or out is None:
        more = against(held) if held else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
        out = more if out is None else out.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def by_technique(docs: DataFrame) -> DataFrame:
    """Inverted index ``(technique, doc_id)`` of ``(doc_id, technique_ids)``."""
    return docs.select("doc_id", F.explode("technique_ids").alias("technique")).distinct().select("technique", "doc_id")


def evidence_packages(docs: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """``(technique, doc_id, how, score)`` of ``(technique, text)``: exact look-ups and the k most similar texts, each document once, exact first."""
    exact = asked.select("technique").join(by_technique(docs), "technique").select("technique", "doc_id", F.lit("exact").alias("how"), F.lit(1.0).alias("score"))
    similar = tfidf_search(docs, asked.select(F.col("technique").alias("query_id"), "text"), k).select(F.col("query_id").alias("technique"), "doc_id", F.lit("similar").alias("how"), "score")
    return exact.unionByName(similar.join(exact.select("technique", "doc_id"), ["technique", "doc_id"], "left_anti"))
