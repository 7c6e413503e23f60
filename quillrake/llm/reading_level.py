"""Reading level of documents: a Rasch-style latent difficulty model of words and texts.

The rate at which word w occurs in a text of level t is exp(a_w (t - b_w)) per token: b_w is the word's difficulty and
a_w how sharply its occurrence tells levels apart. (With one slope for all words, as in the plain Rasch model, the
level would cancel given a text's length, so each word has its own.) Graded texts anchor the scale. The parameters are
estimated by alternating over the whole corpus: given the words, each document's level maximises its likelihood; given
the levels, each word's two parameters are fitted to its counts by level.

Words are hashed into a table of fixed size, so the model that is broadcast doesn't grow with the corpus. Names of
people and places and other words that are no measure of level get slopes near zero.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workdir, written

#: Size of the word table; levels at which a document may stand; bins of levels in which words are counted.
BUCKETS = 1 << 17
GRID = np.arange(0.0, 6.01, 0.1)
BINS = np.arange(0.5, 5.6, 0.5)

#: Most graded texts that are fitted to, and documents that stand for a label in the language counts: all are used.
GRADED_LIMIT = 100_000

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")


def buckets_of(text: str | None, memo: dict[str, int]) -> tuple[list[int], list[int]]:
    """Bucket and count of each distinct word of a text: whole, small letters, markup left out."""
    if not text:
        return [], []
    c = Counter(_WORD.findall(_MARKUP.sub(" ", text).lower()))
    got: Counter = Counter()
    for w, n in c.items():
        k = memo.get(w)
        if k is None:
            if len(memo) > 500_000:
                memo.clear()
            k = memo[w] = zlib.crc32(w.encode()) % BUCKETS
        got[k] += n
    return list(got), list(got.values())


@dataclass
class Model:
    """``slope`` and ``rate`` (log rate at level 3) of each bucket, ``english`` (probability of English) of each bucket,
    ``norm``: log of the rates' sum at each level of the grid, ``cut``: least level of a demanding text."""

    slope: np.ndarray
    rate: np.ndarray
    english: np.ndarray
    norm: np.ndarray
    cut: float = 3.5
    slack: float = 0.02

    def level(self, k: np.ndarray, n: np.ndarray) -> float:
        """Maximum of the posterior; a weak prior holds texts without telling words at the middle."""
        n = n * self.english[k]
        s = float((self.slope[k] * n).sum())
        score = s * (GRID - 3.0) - n.sum() * self.norm - self.slack * (GRID - 3.0) ** 2
        return float(GRID[int(np.argmax(score))])

    def english_share(self, k: np.ndarray, n: np.ndarray) -> float:
        return float((self.english[k] * n).sum() / max(n.sum(), 1))


def fit_words(counts: np.ndarray, tokens: np.ndarray, rounds: int = 12, ridge: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Slope and log rate (at level 3) of each word from its counts by bin: Poisson regression by Newton's method.

    ``ridge`` pulls the slopes of rare words to zero.
    """
    x = BINS - 3.0
    whole = max(tokens.sum(), 1.0)
    total = counts.sum(axis=1)
    rate, slope = np.log((total + 0.01) / whole), np.zeros(len(total))
    for _ in range(rounds):
        mu = np.exp(np.clip(rate[:, None] + slope[:, None] * x, -40, 10)) * tokens
        g0, g1 = counts.sum(axis=1) + 0.01 - mu.sum(axis=1) - 0.01, (counts * x).sum(axis=1) - (mu * x).sum(axis=1) - ridge * slope
        h00, h01, h11 = mu.sum(axis=1) + 1e-3, (mu * x).sum(axis=1), (mu * x * x).sum(axis=1) + ridge
        det = np.maximum(h00 * h11 - h01**2, 1e-9)
        rate = rate + np.clip((h11 * g0 - h01 * g1) / det, -1.5, 1.5)
        slope = np.clip(slope + np.clip((h00 * g1 - h01 * g0) / det, -0.7, 0.7), -3, 3)
    return slope, np.where(total > 0, rate, -40.0)


def _norm(slope: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.array([np.log(np.exp(np.clip(rate + slope * (t - 3.0), -60, 5)).sum() + 1e-12) for t in GRID])


def _dense(rows: pd.DataFrame, columns: int) -> np.ndarray:
    """(bucket, bin, n) as an array; its size is that of the word table times the bins."""
    out = np.zeros((BUCKETS, columns))
    out[rows["bucket"].to_numpy(dtype=np.int64), rows["bin"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return out


def _bag(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, k array<int>, n array<int>) of (doc_id, tag, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for b in batches:
            bags = [buckets_of(t, memo) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tag": b["tag"], "k": [x for x, _ in bags], "n": [y for _, y in bags]})

    return docs.mapInPandas(run, "doc_id bigint, tag string, k array<int>, n array<int>")


def _binned(batches: Iterator[pd.DataFrame], bin_of) -> Iterator[pd.DataFrame]:
    """Partial sums of counts by bucket and bin: one row per pair and task, not per word of a document."""
    held: dict[int, float] = {}

    def rows() -> pd.DataFrame:
        keys = np.fromiter(held, dtype=np.int64, count=len(held))
        return pd.DataFrame({"bucket": keys // 64, "bin": keys % 64, "n": np.fromiter(held.values(), dtype=float, count=len(held))})

    for b in batches:
        keys, weights = [], []
        for row in b.itertuples(index=False):
            k, n = np.asarray(row.k, dtype=np.int64), np.asarray(row.n, dtype=float)
            if len(k) and (got := bin_of(row, k, n)) is not None:
                keys.append(k * 64 + got[0])
                weights.append(n * got[1])
        if keys:
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            for key, w in zip(u.tolist(), np.bincount(at, np.concatenate(weights)).tolist(), strict=True):
                held[key] = held.get(key, 0.0) + w
    yield rows()


def _sum(bags: DataFrame, bin_of) -> pd.DataFrame:
    rows = bags.mapInPandas(lambda it: _binned(it, bin_of), "bucket int, bin int, n double")
    return rows.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).toPandas()


def english_words(bags: DataFrame) -> np.ndarray:
    """Probability that a word is English, from the declared languages of all documents (``tag``: en, other or NULL).

    Wrong labels are few, so they blur the probabilities of words only a little.
    """
    c = _dense(_sum(bags, lambda r, k, n: None if r.tag is None else (0 if r.tag == "en" else 1, 1.0)), 2)
    whole = c.sum(axis=0) + 1.0
    share = whole / whole.sum()
    p, q = (c[:, 0] + 2 * share[0]) / whole[0], (c[:, 1] + 2 * share[1]) / whole[1]
    known = c.sum(axis=1) > 0
    return np.where(known, p / (p + q), 0.5)


def fit(bags: DataFrame, graded: pd.DataFrame, rounds: int = 3, anchor: float = 20.0) -> Model:
    """Fit to all documents' bags and graded texts (grade, text).

    ``rounds`` of alternation over the corpus; ``anchor``: how often each graded text counts.
    """
    spark = bags.sparkSession
    memo: dict[str, int] = {}
    samples = [(float(g), *map(np.asarray, buckets_of(t, memo))) for g, t in zip(graded["grade"], graded["text"], strict=True) if t]
    samples = [s for s in samples if len(s[1])]
    english = english_words(bags)
    anchored = np.zeros((BUCKETS, len(BINS)))
    for g, k, n in samples:
        np.add.at(anchored, (k, int(np.argmin(abs(BINS - g)))), n)
        english[k] = np.maximum(english[k], 0.9)  # the graded texts are English
    counts = anchored
    for r in range(rounds + 1):
        slope, rate = fit_words(counts, counts.sum(axis=0) + 1e-9, ridge=4.0 if r == 0 else 30.0)
        model = Model(slope, rate, english, _norm(slope, rate))
        if r == rounds:
            break
        shared = spark.sparkContext.broadcast(model)

        def place(row, k, n, shared=shared):
            m = shared.value
            if m.english_share(k, n) < 0.5:
                return None
            return int(np.argmin(abs(BINS - m.level(k, n)))), m.english[k]

        counts = anchored * anchor + _dense(_sum(bags, place), len(BINS))
        shared.destroy()
    model.cut = _cut([(g, model.level(k, n)) for g, k, n in samples])
    return model


def _cut(levels: list[tuple[float, float]]) -> float:
    """Level between grades 3 and 4 that tells the graded texts apart best; in the middle of equally good ones."""
    best = [(sum((t >= c) != (g >= 3.5) for g, t in levels), c) for c in np.arange(1.0, 5.5, 0.05)]
    least = min((b for b, _ in best), default=0)
    good = [c for b, c in best if b == least]
    return float(np.mean(good)) if levels else 3.5


def levels(docs: DataFrame, graded: DataFrame, rounds: int = 3) -> tuple[DataFrame, Model]:
    """(doc_id, level, english_share, demanding) for documents (doc_id, lang, text), and the model.

    ``level`` is on the scale of the grades. NULL and empty texts have a NULL level and aren't demanding; texts that
    aren't mainly English get a level from their English words only. Repeated ids come out as often as they go in.
    ``graded`` (grade, text) may hold ``GRADED_LIMIT`` texts at most.
    """
    spark = docs.sparkSession
    sample = graded.select("grade", "text").filter("grade IS NOT NULL AND text IS NOT NULL").limit(GRADED_LIMIT + 1).toPandas()
    if len(sample) > GRADED_LIMIT:
        raise ValueError("more graded texts than GRADED_LIMIT")
    tag = F.when(F.col("lang").isNull(), None).when(F.lower("lang").rlike("^en(g|glish|[-_].*)?$"), "en").otherwise("other")
    bags = written(_bag(docs.select("doc_id", tag.alias("tag"), "text")), workdir(spark, "bags"))
    model = fit(bags, sample, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = []
            for k, n in zip(b["k"], b["n"], strict=True):
                k, n = np.asarray(k, dtype=np.int64), np.asarray(n, dtype=float)
                out.append((m.level(k, n), m.english_share(k, n)) if len(k) else (None, None))
            lv, en = pd.Series([x for x, _ in out], dtype=float), pd.Series([y for _, y in out], dtype=float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "level": lv, "english_share": en, "demanding": (lv >= m.cut) & (en >= 0.5)})

    return bags.mapInPandas(run, "doc_id bigint, level double, english_share double, demanding boolean"), model


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/graded_texts.parquet"))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as demanding as grade 4 or 5."""
    return _levels(spark, sf_dir).filter("demanding").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every document."""
    return _levels(spark, sf_dir).select("doc_id", "level", "english_share")
