"""Evaluation passages inside a training corpus, by suffix arrays over shards of the corpus.

Every task sorts the word suffixes of its shard of whole texts once; every suffix of every evaluation item is looked up
by binary search, which gives all places where its first words occur, and extended there to its longest verbatim match.  Nothing of the
corpus leaves a task but the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Words are longest sequences of letters and digits.
NOT_WORD = r"[^\p{L}\p{Nd}]+"
_MATCH = "doc_id long, item_id long, longest int, item_word int, doc_word int"
#: Texts are gathered to shards of at most about this many characters (a single longer text is a shard of its own).
SHARD_CHARS = 12_000_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in lower case, and for each word the position of its text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_WORD)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(keep), owner.filter(keep).to_numpy(zero_copy_only=False)


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` codes that start there, by prefix doubling; only ties are sorted again.

    The end of the array sorts first.  Suffixes equal over ``depth`` codes stay in the order of their positions.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    group = np.empty(n, np.int64)  # a suffix's rank: the first place of its group of ties
    new = np.ones(n, bool)
    new[1:] = sorted_code[1:] != sorted_code[:-1]
    starts = np.flatnonzero(new)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    width = 1
    while width < depth:
        size = np.diff(np.append(starts, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        pos = order[at]
        nxt = pos + width
        second = np.where(nxt < n, group[np.minimum(nxt, n - 1)], -1)
        first = group[pos]
        resort = np.lexsort((second, first))
        order[at] = pos[resort]
        f, s = first[resort], second[resort]
        cut = np.ones(len(at), bool)
        cut[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        new = ~tied
        new[at] = cut
        starts = np.flatnonzero(new)
        group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        width *= 2
    return order


@dataclass
class Items:
    """Evaluation items as words: ``ids[i]`` has the words ``flat[start[i] : start[i + 1]]``."""

    ids: np.ndarray
    flat: list[str]
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        flat, owner = words(pa.array([t for _, t in rows], pa.large_string()))
        return cls(np.array([i for i, _ in rows], np.int64), flat.to_pylist(), np.searchsorted(owner, np.arange(len(rows) + 1)))


def _sign(code: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sign of (corpus suffix at ``at`` - its row of ``wanted`` words); a suffix that ends within them is smaller."""
    sign, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    for j in range(wanted.shape[1]):
        x = at[todo] + j
        d = np.where(x < len(code), code[np.minimum(x, len(code) - 1)], -1) - wanted[todo, j]
        sign[todo] = np.sign(d)
        todo = todo[d == 0]
    return sign


def _search(code: np.ndarray, sa: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all wanted word sequences at once: first place not below (``right``: not at or below) them."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sa), np.int64)
    while (todo := np.flatnonzero(lo < hi)).size:
        mid = (lo[todo] + hi[todo]) // 2
        sign = _sign(code, sa[mid], wanted[todo])
        below = (sign <= 0) if right else (sign < 0)
        lo[todo[below]] = mid[below] + 1
        hi[todo[~below]] = mid[~below]
    return lo


def _extend(code: np.ndarray, pos: np.ndarray, item: np.ndarray, at: np.ndarray, end: np.ndarray, known: int) -> np.ndarray:
    """Number of common words from ``pos`` in the corpus and ``at`` in the items, up to ``end``; ``known`` are common already."""
    common, todo, step = np.full(len(pos), known, np.int64), np.arange(len(pos)), np.arange(16)
    while len(todo):
        x, y = pos[todo] + common[todo], at[todo] + common[todo]
        inside = (y[:, None] + step < end[todo, None]) & (x[:, None] + step < len(code))
        same = inside & (code[np.minimum(x[:, None] + step, len(code) - 1)] == item[np.minimum(y[:, None] + step, len(item) - 1)])
        more = np.where(same.all(1), len(step), (~same).argmax(1))
        common[todo] += more
        todo = todo[more == len(step)]
    return common


def _best(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """One row per document and item: the longest match, the first of equals."""
    got = pd.concat(frames, ignore_index=True).sort_values(_ROW, ascending=[True, True, False, True, True], kind="stable")
    return got.drop_duplicates(["text", "item"])


_ROW = ["text", "item", "longest", "item_word", "doc_word"]


class Shard:
    """Suffix array of the words of some whole texts, sorted to the depth of the shortest match that counts."""

    def __init__(self, texts: pa.Array, least: int):
        self.least, self.n_texts = least, len(texts)
        flat, owner = words(texts)
        coded = flat.combine_chunks().dictionary_encode() if isinstance(flat, pa.ChunkedArray) else flat.dictionary_encode()
        self.number = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        raw = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a separator of its own between texts keeps matches inside one text
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1 if len(owner) else np.empty(0, np.int64)
        self.code = np.insert(raw, ends, len(self.number) + np.arange(len(ends)))
        self.who = np.insert(owner, ends, -1)
        self.text_start = np.zeros(self.n_texts, np.int64)
        if len(ends):
            self.text_start[owner[ends - 1]] = np.concatenate([[0], ends[:-1] + np.arange(1, len(ends))])
        self.sa = suffix_array(self.code, least)

    def match(self, items: Items, queries: int = 4_096, hits: int = 100_000) -> pd.DataFrame:
        """Matches of at least ``least`` words as ``(text, item, longest, item_word, doc_word)``; ``item`` is a position.

        Item suffixes are searched ``queries`` at a time and their places taken ``hits`` at a time, so memory does not
        depend on how often a passage occurs.  A place whose word before matches too is part of a longer match of
        the suffix before, so only the others are extended.
        """
        item = np.fromiter((self.number.get(w, -2) for w in items.flat), np.int64, len(items.flat))
        size = np.diff(items.start)
        n = np.maximum(0, size - self.least + 1)
        owner = np.repeat(np.arange(len(size)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        every = items.start[:-1][owner] + offset
        found, rows = [pd.DataFrame({c: pd.Series(dtype="int64") for c in _ROW})], 0
        for s in range(0, len(every) if len(self.code) else 0, queries):
            at, own, off = every[s : s + queries], owner[s : s + queries], offset[s : s + queries]
            wanted = item[at[:, None] + np.arange(self.least)]
            seen = np.flatnonzero((wanted >= 0).all(1))  # a word the shard lacks can't match
            lo, hi = _search(self.code, self.sa, wanted[seen], False), _search(self.code, self.sa, wanted[seen], True)
            total = np.cumsum(hi - lo)
            for h in range(0, int(total[-1]) if len(total) else 0, hits):
                flat = np.arange(h, min(h + hits, int(total[-1])))
                i = np.searchsorted(total, flat, side="right")
                q = seen[i]
                pos = self.sa[hi[i] - (total[i] - flat)]
                before = (off[q] > 0) & (pos > 0)
                before &= self.code[np.maximum(pos - 1, 0)] == item[np.maximum(at[q] - 1, 0)]
                q, pos = q[~before], pos[~before]
                if not len(q):
                    continue
                common = _extend(self.code, pos, item, at[q], items.start[own[q] + 1], self.least)
                text = self.who[pos]
                found.append(_best([pd.DataFrame({"text": text, "item": own[q], "longest": common, "item_word": off[q], "doc_word": pos - self.text_start[text]})]))
                rows += len(found[-1])
                if rows > 2_000_000:  # what is kept is one row per text and item
                    found = [_best(found)]
                    rows = 0
        return _best(found)


def leaks(documents: DataFrame, items: DataFrame, least: int = 12, shard_chars: int = SHARD_CHARS, item_pass: int = 200_000) -> DataFrame:
    """``(doc_id, item_id, longest, item_word, doc_word)`` for ``(doc_id, text)`` and ``(item_id, text)``.

    One row per document and item that share at least ``least`` consecutive words: the longest common sequence and
    where it starts in either (the first of equals).  Null and empty texts and items of fewer words match nothing;
    several documents or items of one id give one row for each text.  The items are a stated query set that does not
    grow with the corpus: they are sent to the tasks ``item_pass`` at a time, and each shard's suffix array is built
    once for all items of a pass.
    """
    tagged = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator(prefetchPartitions=False)
    passes: list[list[tuple[int, str]]] = [[]]
    for r in tagged:
        if len(passes[-1]) >= item_pass:
            passes.append([])
        passes[-1].append((r.item_id, r.text))
    docs = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def against(rows: list[tuple[int, str]]) -> DataFrame:
        wanted = Items.of(rows)

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                for i in range(0, len(b), 512):
                    x = b.slice(i, 512)
                    n = pc.sum(pc.binary_length(x.column(1))).as_py() or 0
                    if held and size + n > shard_chars:
                        yield from search(held)
                        held, size = [], 0
                    held.append(x)
                    size += n
            if held:
                yield from search(held)

        def search(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            got = Shard(t["text"].combine_chunks(), least).match(wanted)
            out = pa.table({
                "doc_id": t["doc_id"].take(pa.array(got["text"].to_numpy(np.int64))), "item_id": pa.array(wanted.ids[got["item"].to_numpy(np.int64)]),
                **{c: pa.array(got[c].to_numpy(), pa.int32()) for c in ("longest", "item_word", "doc_word")}})
            return out.combine_chunks().to_batches(max_chunksize=50_000)

        return docs.mapInArrow(shard, _MATCH)

    found = None
    for rows in passes:
        one = against(rows)
        found = one if found is None else found.unionByName(one)
    return found


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
