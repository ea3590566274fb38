"""Toxicity scores by gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of a lexicon (a fixed list and words and word
beginnings that the training labels show to be toxic), how near such words stand to
second-person words, shares of capitals, punctuation, obfuscated and stretched words.
The lexicon, the trees and the calibration are learnt from a bounded sample of labelled
rows, each feature of a training row from the labels of other rows only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, isotonic
from .io import as_bytes, chunks

#: Most labelled rows that are used for fitting, read whole.
SAMPLE = 8_000
FOLDS = 3
#: Common insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash scum loser losers pathetic worthless disgusting clown ugly jerk liar fool idiotic garbage filth vermin hate "
    "dumm dummkopf trottel depp abschaum versager ekelhaft wertlos arsch imbécile crétin abruti débile ordure connard minable dégoûtant "
    "estúpido imbécil tonto basura escoria asqueroso inútil payaso patético".split()
)
#: Second-person words in four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$", "oieastas")
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$*#%&!|])")
_STRETCH = re.compile(r"(.)\1\1")
BEGINNINGS = (5, 7)
COLUMNS = ("words", "weight", "most", "hits", "hit_count", "fixed", "near_second", "second", "capitals", "exclaims", "obfuscated", "stretched", "distinct")


def plain(token: str) -> str:
    """A token lower-cased, without edge punctuation, and with look-alike digits as letters."""
    t = _EDGE.sub("", token.lower())
    return re.sub(r"[*#.\-_]", "", t.translate(_LEET)) if t and _MIXED.search(t) else t


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)] if word else []


def count_terms(texts: list[str], y: np.ndarray, fold: np.ndarray) -> dict[tuple[int, int], Counter]:
    """Per fold and label: in how many rows each term stands, and under None the number of rows."""
    of: dict[str, list[str]] = {}
    out = {(k, v): Counter() for k in range(FOLDS) for v in (0, 1)}
    for t, label, k in zip(texts, y, fold, strict=True):
        seen: set = {None}
        for tok in set(t.split()):
            if tok not in of:
                of[tok] = terms(plain(tok))
            seen.update(of[tok])
        out[int(k), int(label)].update(seen)
    return out


def mine(counts: dict[tuple[int, int], Counter], without: int | None = None) -> dict[str, float]:
    """Terms of which toxic rows have many more than others, with their smoothed log odds, over all folds but one."""
    df = (Counter(), Counter())
    for (k, label), c in counts.items():
        if k != without:
            df[label].update(c)
    bad, good = df[1].pop(None, 0), df[0].pop(None, 0)
    least = max(3, math.ceil(0.004 * bad))
    odds = {w: math.log((n + 0.5) / (bad + 1)) - math.log((df[0][w] + 0.5) / (good + 1)) for w, n in df[1].items() if n >= least}
    return {w: v for w, v in odds.items() if v >= 2}


class Features:
    """Dense features of texts; what a token adds is kept for tokens met before."""

    KEEP = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.empty((0, 8))

    def _token(self, token: str) -> tuple:
        w = plain(token)
        weight = max((self.lexicon.get(x, 0.0) for x in terms(w)), default=0.0)
        letters = [c for c in token if c.isalpha()]
        return (weight, weight > 0, w in INSULTS, w in SECOND, len(letters) > 1 and all(c.isupper() for c in letters), token.count("!") + token.count("?"), bool(_MIXED.search(_EDGE.sub("", token))), bool(_STRETCH.search(w)))

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.ids) > self.KEEP:
            self._reset()
        out = np.zeros((len(texts), len(COLUMNS)))
        split = [t.split() for t in texts]
        for tok in set().union(*split).difference(self.ids):
            self.ids[tok] = len(self.rows)
            self.rows.append(self._token(tok))
        if len(self.rows) > len(self.table):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :], float)])
        get = self.ids.__getitem__
        for k, words in enumerate(split):
            n = len(words)
            if not n:
                continue
            ids = np.fromiter(map(get, words), np.int64, n)
            x = self.table[ids]
            sums = x.sum(axis=0)
            near = 0.0
            if sums[1] and sums[3]:
                around = np.concatenate([np.zeros(6), np.cumsum(np.append(x[:, 3], np.zeros(5)))])
                near = float((x[:, 1] * ((around[11 : 11 + n] - around[:n]) > 0)).sum())
            out[k] = (math.log1p(n), sums[0] / n, x[:, 0].max(), sums[1] / n, math.log1p(sums[1]), sums[2] / n, near / n, sums[3] / n, sums[4] / n, sums[5] / n, sums[6] / n, sums[7] / n, math.log1p(len(np.unique(ids[x[:, 1] > 0]))))
        return out


class Model:
    """Lexicon, trees and calibration; without both labels in the sample the score is their mean."""

    def __init__(self, texts: list[str], y: np.ndarray, fold: np.ndarray):
        self.mean = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if not 0 < self.mean < 1:
            return
        x = np.zeros((len(y), len(COLUMNS)))
        counts = count_terms(texts, y, fold)
        for k in range(FOLDS):
            at = np.flatnonzero(fold == k)
            if len(at):
                x[at] = Features(mine(counts, k)).of([texts[i] for i in at])
        p = np.full(len(y), self.mean)
        for k in range(FOLDS):
            rest, at = fold != k, fold == k
            if at.any() and 0 < y[rest].mean() < 1:
                p[at] = Boosted().fit(x[rest], y[rest]).predict(x[at])
        self.lexicon, self.trees, self.knots = mine(counts), Boosted().fit(x, y), isotonic(p, y)

    def score(self, features: Features, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.mean)
        p = self.trees.predict(features.of(texts))
        # The steps of the calibration, with a trace of the raw score to keep the order within a step.
        return np.clip(0.999 * np.interp(p, *self.knots) + 0.001 * p, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled rows, taken by hash of doc_id from those not held out."""
    chosen = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).alias("fold")).toPandas()
    rows = rows.drop_duplicates("text").sort_values(["doc_id", "text"])
    return Model(rows["text"].tolist(), rows["toxic"].to_numpy(float), rows["fold"].to_numpy(int))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text).

    held_out rows (crc32 of the id as text leaves 1 when divided by 3) take no part in
    fitting. Null texts are scored as empty ones; null ids aren't held out; repeated rows
    get equal scores; labels other than 0 and 1 are ignored; without labels of both kinds
    all scores are the labels' mean (0 without any). Further columns are dropped. Fitting
    sees up to sample labelled rows; it and scoring read whole texts, however long.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        features = Features(m.lexicon) if m.trees is not None else None
        for b in chunks(batches):
            s = m.score(features, [(t or b"").decode("utf-8", "replace") for t in as_bytes(b)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held).mapInArrow(emit, "doc_id long, held_out boolean, score double, predicted int")
