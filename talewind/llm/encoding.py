"""Texts decoded with the wrong character encoding: found by character n-gram models, restored where nothing was lost.

All encodings considered keep ASCII, so only words with other characters can be garbled or restored.  They are counted
over all documents (digits stand for each other), trigram models are trained on the clean ones, and every word is
scored under every chain of encoding it as it was read and decoding it as it was written.  A chain is accepted where
the restored word is likelier than the word found by more than a margin.

Nothing is scored by a model that has seen it: documents fall into folds by a hash of their text (copies share a
fold), and a fold is scored by the model of the others.  The margin is validated on held-out documents, clean ones and
words of clean ones garbled on purpose; see :func:`settle`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from talewind.spool import Spool, partitions

#: Fixed values: (encoding a text was written in, encodings it was read as).
PAIRS = (
    ("utf-8", ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp866", "cp1253", "cp1254", "cp1257", "iso8859_7", "iso8859_15", "gb18030", "shift_jis", "euc_kr", "big5")),
    ("cp1252", ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "cp1253", "cp1254", "cp1257")),
    ("cp1250", ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")),
    ("iso8859_2", ("cp1252", "latin-1")),
    ("cp1251", ("cp1252", "latin-1", "koi8_r", "cp866", "mac_roman", "cp437")),
    ("koi8_r", ("cp1252", "latin-1", "cp1251", "cp866", "cp437")),
    ("cp866", ("cp1252", "latin-1", "cp1251", "cp437", "koi8_r")),
    ("mac_roman", ("cp1252", "latin-1", "cp437")),
    ("cp437", ("cp1252", "latin-1", "cp1251")),
    ("cp850", ("cp1252", "latin-1")),
    ("cp1253", ("cp1252", "latin-1", "cp437")),
    ("iso8859_7", ("cp1252", "latin-1")),
    ("cp1254", ("cp1252", "latin-1", "cp1251")),
    ("cp1257", ("cp1252", "latin-1")),
    ("iso8859_13", ("cp1252", "latin-1")),
    ("cp1255", ("cp1252", "latin-1")),
    ("cp1256", ("cp1252", "latin-1")),
    ("gb18030", ("cp1252", "latin-1", "cp437")),
    ("shift_jis", ("cp1252", "latin-1", "cp437")),
    ("euc_jp", ("cp1252", "latin-1")),
    ("big5", ("cp1252", "latin-1")),
    ("euc_kr", ("cp1252", "latin-1")),
)
#: Encodings of more than one byte a character.
MULTI = ("utf-8", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
#: Steps of a chain, each (read as, written in); the last ones were garbled twice.
CHAINS = tuple(((r, w),) for w, reads in PAIRS for r in reads) + tuple(((r, "utf-8"), (s, "utf-8")) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850") for s in ("cp1252", "latin-1") if r in ("cp1252", "latin-1") or s == "cp1252")
_UTF8 = tuple(i for i, c in enumerate(CHAINS) if c[-1][1] == "utf-8" and all(r not in MULTI for r, _ in c))
LOST = "\ufffd"
#: Interpolation weights of trigram, bigram, unigram and a uniform model over this many characters.
WEIGHTS, ALPHABET = (0.7, 0.2, 0.09, 0.01), 70_000
#: Log-probability of a script met nowhere else, and of one letter of the largest scripts (of others 5).
RARE, LETTERS = math.log(1e-6), {"CJK": 10.0, "HANGUL": 10.0}
#: Documents are held out in this many folds.
FOLDS = 5

_WORD = r"(?<![^\x00-\x20])[\x21-\x7e]*+[^\x00-\x7f][^\x00-\x20]*"


def _table(name: str) -> dict[str, int]:
    """Character to byte; bytes an encoding leaves open are the control characters of the same number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


_BYTES: dict[str, dict[str, int]] = {}
_CHARS: dict[str, list[str]] = {}


def _encode(text: str, name: str) -> bytes | None:
    if name in MULTI:
        try:
            return text.encode(name, "surrogatepass" if name == "utf-8" else "strict")
        except UnicodeEncodeError:
            return None
    table = _BYTES.get(name) or _BYTES.setdefault(name, _table(name))
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name in MULTI:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return None
    chars = _CHARS.get(name)
    if chars is None:
        chars = [""] * 256
        for c, b in (_BYTES.get(name) or _BYTES.setdefault(name, _table(name))).items():
            chars[b] = c
        _CHARS[name] = chars
    return "".join([chars[b] for b in raw])


def undo(text: str, chain: tuple) -> str | None:
    """The text before it went through ``chain``, or null where the chain can't have made it."""
    for read, written in chain:
        raw = _encode(text, read)
        if raw is None:
            return None
        back = _decode(raw, written)
        if back is None:
            return None
        text = back
    return text


def garble(text: str, chain: tuple) -> str | None:
    """What ``chain`` makes of a clean text, or null where the encoding it is written in can't hold it."""
    for read, written in reversed(chain):
        raw = _encode(text, written)
        if raw is None:
            return None
        text = _decode(raw, read)
        if text is None:
            return None
    return text


def candidates(word: str) -> list[tuple[int, str]]:
    """All chains that can be undone on a word and change it."""
    raws: dict[str, bytes | None] = {}
    out = []
    for i, chain in enumerate(CHAINS):
        read = chain[0][0]
        if read not in raws:
            raws[read] = _encode(word, read)
        raw = raws[read]
        if raw is None:
            continue
        back = _decode(raw, chain[0][1])
        for r, w in chain[1:]:
            back = None if back is None else undo(back, ((r, w),))
        if back is not None and back != word:
            out.append((i, back))
    return out


def trigrams(word: str) -> list[str]:
    """Trigrams of a word; white space outside ASCII, which may be a half of a garbled character, parts it but costs nothing."""
    out = []
    for part in word.split():
        padded = f"\x02\x02{part}\x03"
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    """Name of a letter's script, empty for other characters."""
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c) in ("Lu", "Ll", "Lo") else ""


def other_script(word: str) -> float:
    """Log-likelihood of a word as text of one script other than Latin, its letters equally likely; of any other word, minus infinity."""
    script = ""
    for c in word:
        if c > "\x7f" or c.isalpha():
            s = _script(c)
            if s in ("", "LATIN") or script not in ("", s):
                return -math.inf
            script = s
    if not script:
        return -math.inf
    return RARE - sum(LETTERS.get(_script(c), 5.0) if c > "\x7f" else 5.0 for c in word)


class Model:
    """Smoothed trigram models of words, one for every fold, each of the words outside it; lower orders follow from the trigrams.

    ``grams`` are the trigrams and ``counts`` their occurrences by fold.
    """

    def __init__(self, grams: list[str], counts: np.ndarray):
        self.grams, self.counts = grams, counts
        self.fold = -1

    def __reduce__(self):
        return Model, (self.grams, self.counts)

    def use(self, fold: int) -> Model:
        """Score by the model that has not seen ``fold``."""
        if self.fold != fold:
            self.fold = fold
            self.known = self.__dict__.setdefault("memo", {}).setdefault(fold, {})
            made = self.__dict__.setdefault("tables", {})
            if fold not in made:
                tri: dict[str, int] = dict(zip(self.grams, (self.counts.sum(1) - self.counts[:, fold]).tolist()))
                of2, bi, of1, uni = (defaultdict(int) for _ in range(4))
                for t, n in tri.items():
                    of2[t[:2]] += n
                    bi[t[1:]] += n
                    of1[t[1]] += n
                    uni[t[2]] += n
                made[fold] = tri, dict(of2), dict(bi), dict(of1), dict(uni), max(1, sum(uni.values()))
            self.tri, self.of2, self.bi, self.of1, self.uni, self.total = made[fold]
        return self

    def gram(self, t: str) -> float:
        got = self.known.get(t)
        if got is None:
            a, b, c, d = WEIGHTS
            p = d / ALPHABET + c * self.uni.get(t[2], 0) / self.total
            if n := self.of1.get(t[1]):
                p += b * self.bi.get(t[1:], 0) / n
            if n := self.of2.get(t[:2]):
                p += a * self.tri.get(t, 0) / n
            got = math.log(p)
            if len(self.known) < 500_000:
                self.known[t] = got
        return got

    def score(self, word: str) -> float:
        return self.score_of(trigrams(word))

    def score_of(self, grams: list[str]) -> float:
        known = self.known.get
        return sum([known(t) or self.gram(t) for t in grams])

    def as_found(self, word: str) -> float:
        """Score of a word as it stands, which may be of a script that the clean words lack."""
        return max(self.score(word), other_script(word))


def foreign_words(documents: DataFrame) -> DataFrame:
    """``(row, doc_id, fold, word)``: every word with a character outside ASCII, digits written as 0; ``row`` tells texts of one id apart."""
    return (
        documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
        .select("row", "doc_id", "fold", F.explode("words").alias("word")).withColumn("word", F.translate("word", "123456789", "000000000")))


def _vocabulary(each: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences by fold."""
    return each.groupBy("word").agg(F.array(*(F.count_if(F.col("fold") == i) for i in range(FOLDS))).alias("n"))


def _train(words: DataFrame, most: int) -> Model:
    """Models of ``(word, n)`` rows.  The ``most`` commonest trigrams reach the driver and the tasks, the rest are left to the bigrams."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: dict[str, np.ndarray] = {}
        for pdf in frames:
            for w, n in zip(pdf["word"], pdf["n"]):
                for t in trigrams(w):
                    if t in c:
                        c[t] += n
                    else:
                        c[t] = np.array(n, np.int64)
        if c:
            yield pd.DataFrame({"t": list(c), "n": [x.tolist() for x in c.values()]})

    each = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(FOLDS)]
    rows = words.select("word", "n").mapInPandas(count, "t string, n array<long>").groupBy("t").agg(*each)
    got = rows.orderBy(F.desc(sum((F.col(f"n{i}") for i in range(1, FOLDS)), F.col("n0"))), "t").limit(most).toPandas()
    return Model(got["t"].tolist(), got[[f"n{i}" for i in range(FOLDS)]].to_numpy(np.int64).reshape(-1, FOLDS))


_GAINS = "word string, fold int, chain int, restored string, gain double"


def _gains(words: DataFrame, model: Model, best: bool) -> DataFrame:
    """Log-likelihood gains above 0 of ``(word, n)``, by fold and chain; with ``best`` only the likeliest chain's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            out = []
            for w, n in zip(pdf["word"], pdf["n"]):
                cand = candidates(w)
                for f in (np.flatnonzero(n) if cand else ()):
                    m = model.use(int(f))
                    base = m.as_found(w)
                    got = [(w, int(f), i, b, g) for i, b in cand if (g := m.score(b) - base) > 0]
                    if got:
                        out += [max(got, key=lambda x: (x[4], -x[2]))] if best else got
            yield pd.DataFrame(out, columns=["word", "fold", "chain", "restored", "gain"])

    return words.select("word", "n").mapInPandas(run, _GAINS)


def garbled_gains(clean: DataFrame, model: Model) -> DataFrame:
    """``(word, chain, gain)``: what clean words, garbled on purpose, gain by the chain that undoes it.

    ``clean`` has ``(word, n)``.  Every chain is tried on every word.  Each is scored by all models that have not seen
    one of its folds, and the smallest gain counts.
    """

    def gains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            out = []
            for w, n in zip(pdf["word"], pdf["n"]):
                made: dict[str, list[int]] = {}
                for i, chain in enumerate(CHAINS):
                    g = garble(w, chain)
                    if g is not None and g != w and undo(g, chain) == w:
                        made.setdefault(g, []).append(i)
                models, own = np.flatnonzero(n).tolist(), trigrams(w)
                back = [model.use(f).score_of(own) for f in models] if made else []
                for g, chains in made.items():
                    grams, other = trigrams(g), other_script(g)
                    least = min(b - max(model.use(f).score_of(grams), other) for f, b in zip(models, back))
                    out += [(w, i, least) for i in chains]
            yield pd.DataFrame(out, columns=["word", "chain", "gain"])

    return clean.select("word", "n").repartition(partitions(clean.sparkSession)).mapInPandas(gains, "word string, chain int, gain double")


def _histogram(gains: DataFrame) -> np.ndarray:
    """Gains counted by tenths, rounded up: at most ``10 * _TOP`` counts, the last for all beyond."""
    rows = gains.groupBy(F.least(F.ceil(F.col("gain") * 10), F.lit(10 * _TOP)).cast("int").alias("at")).agg(F.count("*").alias("n")).collect()
    out = np.zeros(10 * _TOP + 1, np.int64)
    for r in rows:
        out[max(0, r["at"])] += r["n"]
    return out


_TOP = 200


def _by_chain(gains: DataFrame) -> np.ndarray:
    """A :func:`_histogram` of every chain: at most ``10 * _TOP`` counts each."""
    rows = gains.groupBy("chain", F.least(F.ceil(F.col("gain") * 10), F.lit(10 * _TOP)).cast("int").alias("at")).agg(F.count("*").alias("n")).collect()
    out = np.zeros((len(CHAINS), 10 * _TOP + 1), np.int64)
    for r in rows:
        out[r["chain"], max(0, r["at"])] += r["n"]
    return out


def balanced(clean: np.ndarray, garbled: np.ndarray) -> float:
    """The smallest margin with the least sum of both error rates, from two histograms of gains by tenths.

    Garbled texts among the clean ones add the same to one rate wherever the garbled ones' gains end, so they do not
    move the margin.
    """
    wrong = 1 - np.cumsum(clean) / max(1, clean.sum())
    missed = np.cumsum(garbled) / max(1, garbled.sum())
    return int(np.argmin(np.round(wrong + missed, 6))) / 10


@dataclass(frozen=True)
class Margin:
    """A validated margin: what it was chosen between, and the shares it was measured to give on held-out documents."""

    margin: float
    low: float
    high: float
    clean_documents: int
    wrongly_found: float
    found_of_garbled: float


def settle(clean: np.ndarray, garbled: np.ndarray, allowed: float, least: float, enough: int = 100) -> Margin:
    """The margin from histograms of held-out clean documents (largest gain of a word) and of words garbled on purpose, by chain.

    ``low`` is the smallest margin that finds at most the share ``allowed`` of the clean documents; ``high`` the
    largest that finds at least ``least`` of the words of every chain that garbled ``enough`` of them (of all chains
    together where none did).  The margin is the middle between them.  Where no
    margin does both, ``low`` counts: few wrong finds come first.  Without clean or garbled words the margin is ``low``.
    """
    garbled = np.atleast_2d(garbled)
    every = garbled.sum(0)
    some = garbled[garbled.sum(1) >= enough] if (garbled.sum(1) >= enough).any() else every[None]
    wrong = 1 - np.cumsum(clean) / max(1, clean.sum())
    missed = np.cumsum(every) / max(1, every.sum())
    low = int(np.argmax(wrong <= allowed + 1e-12))
    high = min(int(np.searchsorted(np.cumsum(c) / c.sum(), 1 - least + 1e-12, side="right")) - 1 for c in some) if every.sum() else low
    at = (low + high) // 2 if high > low else low
    return Margin(at / 10, low / 10, high / 10, int(clean.sum()), float(wrong[at]), float(1 - missed[at]))


@dataclass
class Garbled:
    """What :func:`garbled_words` found."""

    each: DataFrame
    words: DataFrame
    clean: DataFrame
    model: Model
    margin: Margin


def garbled_words(documents: DataFrame, spool: Spool, allowed: float = 1e-4, least: float = 0.9, grams: int = 1_000_000) -> Garbled:
    """Words ``(row, doc_id, fold, word)`` of all documents and the garbled ones among them ``(word, fold, chain, restored, gain)``.

    Clean documents are told in two steps.  A word is unsound if it lost characters or a utf-8 chain undoes it into
    known characters.  Models of all sound words then give each document the largest sum of gains that its words have
    under one chain; it is clean if it has no unsound word and that sum is within the :func:`balanced` margin.  The
    final models are trained on clean documents, and :func:`settle` chooses their margin (``allowed``, ``least``).

    U+FFFD is the mark a decoder leaves where bytes did not fit the encoding: such words need no model, they are
    garbled with ``chain`` -1 and a null ``restored``.

    ``grams`` bounds the trigrams of a model.
    """
    each = spool.cut(foreign_words(documents), "words")
    words = spool.cut(_vocabulary(each).repartition(partitions(spool.spark)), "vocabulary")

    def undoable(w: str) -> list[str]:
        return [b for b in (undo(w, CHAINS[i]) for i in _UTF8) if b is not None and b != w]

    def strict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if found := sorted({c for w in pdf["word"] if LOST not in w and not undoable(w) for c in w}):
                yield pd.DataFrame({"c": found})

    known = {r["c"] for r in words.mapInPandas(strict, "c string").distinct().toLocalIterator()}  # at most one row per character of Unicode

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            yield pdf.assign(sound=[LOST not in w and not any(known.issuperset(b) for b in undoable(w)) for w in pdf["word"]])

    told = spool.cut(words.mapInPandas(whole, "word string, n array<long>, sound boolean"), "told")
    sound = told.filter("sound").drop("sound")
    model = _train(sound, grams)
    first = spool.cut(_gains(sound, model, False).drop("restored"), "first")
    odd = each.join(told.filter("not sound").select("word"), "word", "left_semi").select("row").distinct()
    sums = each.join(first, ["word", "fold"]).select("row", "chain", "word", "gain").distinct().groupBy("row", "chain").agg(F.sum("gain").alias("gain")).groupBy("row").agg(F.max("gain").alias("gain"))
    sums = spool.cut(sums.join(odd, "row", "left_anti"), "sums")
    n_sound = each.select("row").distinct().count() - odd.count()
    limit = balanced(_with_zeros(_histogram(sums), n_sound), _histogram(garbled_gains(sound, model)))
    unclean = spool.cut(odd.unionByName(sums.filter(F.col("gain") > limit).select("row")), "unclean")
    clean = spool.cut(_vocabulary(each.join(unclean, "row", "left_anti")), "clean")
    model = _train(clean, grams)
    lost = F.col("word").contains(LOST)
    final = spool.cut(_gains(words.filter(~lost), model, True), "final")
    top = each.join(final.select("word", "fold", "gain"), ["word", "fold"]).groupBy("row").agg(F.max("gain").alias("gain")).join(unclean, "row", "left_anti")
    n_clean = n_sound - sums.filter(F.col("gain") > limit).count()
    margin = settle(_with_zeros(_histogram(top), n_clean), _by_chain(garbled_gains(clean, model)), allowed, least)
    none = words.filter(lost).select("word", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"), F.lit(-1).alias("chain"), F.lit(None).cast("string").alias("restored"), F.lit(0.0).alias("gain"))
    bad = final.filter(F.col("gain") > margin.margin).unionByName(none)
    return Garbled(each, bad, clean, model, margin)


def _with_zeros(histogram: np.ndarray, total: int) -> np.ndarray:
    """The histogram with those of ``total`` that are in none of its counts counted at 0."""
    out = histogram.copy()
    out[0] += max(0, total - int(out.sum()))
    return out


def restored_share(found: Garbled) -> DataFrame:
    """``(chain, n, share)``: of clean words garbled on purpose by each chain, the share that gains beyond the margin."""
    g = garbled_gains(found.clean, found.model)
    return g.groupBy("chain").agg(F.count("*").alias("n"), F.avg((F.col("gain") > found.margin.margin).cast("double")).alias("share"))


def garbled_documents(documents: DataFrame, spool: Spool) -> DataFrame:
    """``doc_id`` of every document with a garbled word; null and pure ASCII texts have none."""
    g = garbled_words(documents, spool)
    return g.each.join(g.words.select("word", "fold"), ["word", "fold"], "left_semi").select("doc_id").distinct()


def restore(documents: DataFrame, spool: Spool) -> DataFrame:
    """``(doc_id, text, n_garbled, n_lost)`` of the garbled documents, with every garbled word restored in place.

    A word takes its own likeliest chain; where several words of a document are garbled, a word that its document's
    commonest chain can undo takes that one.  Words that lost characters (``n_lost`` of them) stay as they are.
    Documents of one id are counted together, each of their texts gets a row.
    """
    g = garbled_words(documents, spool)
    hits = spool.cut(g.each.join(g.words.drop("restored", "gain"), ["word", "fold"]).select(F.col("doc_id"), "word", "chain"), "hits")
    doc = hits.groupBy("doc_id", "chain").agg(F.count("*").alias("n")).groupBy("doc_id").agg(
        F.max_by("chain", F.when(F.col("chain") >= 0, F.struct("n", -F.col("chain")))).alias("main"), F.sum("n").alias("n_garbled"), F.coalesce(F.sum(F.when(F.col("chain") < 0, F.col("n"))), F.lit(0)).alias("n_lost"))
    chains = hits.filter("chain >= 0").distinct().groupBy("doc_id", "word").agg(F.min("chain").alias("chain")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "chain"))).alias("own"))  # one entry per distinct garbled word of a text
    texts = documents.select("doc_id", "text").join(doc, "doc_id").join(chains, "doc_id", "left")
    word, digits = re.compile(_WORD), str.maketrans("123456789", "000000000")

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, frames):
            out = []
            for text, main, own in zip(pdf["text"], pdf["main"], pdf["own"]):
                own = dict(own) if own is not None else {}

                def one(m: re.Match) -> str:
                    w = m.group()
                    chain = own.get(w.translate(digits))
                    if chain is None:
                        return w
                    back = undo(w, CHAINS[int(main)]) if main == main and main is not None else None
                    return back if back is not None and back != w else undo(w, CHAINS[chain]) or w

                out.append(None if text is None else word.sub(one, text))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out, "n_garbled": pdf["n_garbled"], "n_lost": pdf["n_lost"]})

    return texts.mapInPandas(mend, "doc_id long, text string, n_garbled long, n_lost long")
