"""Text cut off by field limits or in transfer.

Intact values are cut artificially, with and without the marks that sources set, half of them as at a limit of the
source. The limits of the sources themselves show as peaks of their values' lengths. A hashed logistic regression learns from them, by the closing characters, the
punctuation, the closing words and the length against the limit, which values end before their sentence or headline
does; it then scores every value.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import tidy

#: Size of the table of hashed features; most values that are learned from, per field.
FEATURES, SAMPLE = 1 << 18, 30_000

#: Marks that sources set where they cut.
CUT_MARKS = ("[...]", "[…]", "(...)", "(…)", "...", "…", "&hellip;")
STOPS = ".!?।。！？"

#: Markup that a cut may fall into.
MARKUP = ("&amp;", "&quot;", "&nbsp;", "&lt;", "<a href=", "</span>", "<br/>", "</p>", "<strong>", "<img src=")

_OPEN = re.compile(r"&#?\w{0,8}$|<[^<>]*$")
_MARK = re.compile(r"\s*(?:" + "|".join(re.escape(m) for m in CUT_MARKS) + r")\s*$")
_TAIL = re.compile(r"[\w'’\-]+", re.UNICODE)
_SPACE = re.compile(r"\s+")


@dataclass
class Limits:
    """Lengths (in characters) at which the values of a source and field pile up: {(source, field): {length: strength}}."""

    peaks: dict[tuple[str, str], dict[int, float]] = field(default_factory=dict)

    def at(self, source: str | None, name: str, length: int) -> float:
        return self.peaks.get((source or "", name), {}).get(length, 0.0)

    def lengths(self, source: str | None, name: str) -> list[int]:
        return sorted(self.peaks.get((source or "", name), {}))


def find_peaks(lengths: np.ndarray, counts: np.ndarray, ratio: float = 25.0, least: int = 8) -> dict[int, float]:
    """Lengths whose count is far above that of the lengths over them, with the log ratio.

    At a limit longer values end, so few are left beyond it (and beyond a mark): a peak with many values beyond is no
    limit but a form of text that always has that length.
    """
    have = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    order = np.argsort(lengths)
    at, upto = lengths[order], np.concatenate([[0], np.cumsum(counts[order])])
    out = {}
    for x, n in have.items():
        if n >= least and x >= 8:
            # Cuts at a word's end spread below a limit, so the lengths above tell more than those below.
            around = [have.get(x + d, 0) for d in range(1, 9)]
            base = sum(around) / len(around) + 0.5
            beyond = int(upto[-1] - upto[np.searchsorted(at, x + 8, side="right")])
            if n / base >= ratio and 2 * n >= beyond:
                out[int(x)] = float(np.log(n / base))
    return out


def limits(values: DataFrame, most: int = 1_000_000) -> Limits:
    """Peaks of each source and field over all ``values`` (source, field, value)."""
    rows = values.select(F.coalesce("source", F.lit("")).alias("source"), "field", "value", F.length("value").alias("length"))
    # A story told often is no limit: distinct values are counted, by their 64-bit hashes.
    rows = rows.groupBy("source", "field", "length", F.xxhash64("value").alias("h")).agg(F.lit(1).alias("one")).groupBy("source", "field", "length").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = find_peaks(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([(pdf["source"].iloc[0], pdf["field"].iloc[0], k, v) for k, v in got.items()], columns=["source", "field", "length", "strength"])

    found = rows.groupBy("source", "field").applyInPandas(run, "source string, field string, length int, strength double")
    peaks: dict[tuple[str, str], dict[int, float]] = {}
    got = found.limit(most + 1).collect()  # some lengths for each source
    if len(got) > most:
        raise ValueError("too many sources for a broadcast of their limits")
    for r in got:
        peaks.setdefault((r.source, r.field), {})[r.length] = r.strength
    return Limits(peaks)


def _h(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}\x00{s}".encode()) % FEATURES


def features(source: str | None, name: str, value: str, lim: Limits) -> list[int]:
    """Hashed features of a value: its last characters and words, its length, and whether its quotes and brackets are closed."""
    raw = value.rstrip()
    mark = _MARK.search(raw[-40:])
    body = tidy(_MARK.sub("", raw[-240:]) if mark else raw[-240:]).rstrip()
    last = body[-1:] or " "
    kind = "stop" if last in STOPS else "word" if last.isalnum() else "quote" if last in "\"'”»’)" else last
    words = _TAIL.findall(body[-120:].lower())
    strength = max(lim.at(source, name, len(value)), lim.at(source, name, len(raw)))
    near = 0.0 if strength else lim.at(source, name, len(raw) + 1)  # the limit fell on the blank before a word
    place = "at" if strength else "near" if near else "off"
    out = [_h("b", name), _h("m", f"{name}{bool(mark)}"), _h("k", f"{name}{kind}{bool(mark)}"), _h("l", f"{name}{place}{bool(mark)}"), _h("lk", f"{name}{place}{kind}")]
    if not mark:
        low = body.lower()
        if _OPEN.search(body):
            out.append(_h("open", ""))
        out += [_h("s", f"{name}{low[-n:]}") for n in (1, 2, 3, 4, 5)]
        w1 = words[-1] if words else ""
        w2 = words[-2] if len(words) > 1 else ""
        w3 = words[-3] if len(words) > 2 else ""
        shape = "A" if body[-len(w1) :][:1].isupper() else "1" if w1[:1].isdigit() else "a"
        out += [_h("w", f"{name}{w1}"), _h("x", f"{name}{w2}{shape}"), _h("y", f"{name}{w3} {w2}{shape}"), _h("z", f"{name}{kind}{shape}"), _h("n", f"{name}{min(len(w1), 10)}{shape}{kind}"), _h("t", f"{name}{kind}{w2} {w1}"), _h("c", f"{name}{min(len(raw) // 20, 12)}{kind}"), _h("d", f"{w2}{shape}{place}"), _h("e", f"{name}{w1}{place}")]
        out += [_h("q", f"{name}{raw.count(chr(34)) % 2}{raw.count('(') > raw.count(')')}{kind}")]
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    lim: Limits

    def score(self, source: str | None, name: str, value: str) -> float:
        """Probability that the value was cut."""
        return float(1 / (1 + np.exp(-self.weights[features(source, name, value, self.lim)].sum())))


def cut(rng: np.random.Generator, value: str) -> tuple[str, int] | None:
    """An artificial cut of a value and the limit it was cut at; None where what is left is complete or too little."""
    if len(value) < 12:
        return None
    at, style = int(rng.integers(8, len(value) - 1)), rng.random()
    head = value[:at]
    if style < 0.35:  # back to a word's end, mostly with a mark
        if not value[at].isspace():
            head = head[: head.rfind(" ")] if " " in head else head
        head = head.rstrip(" ,;:–-")
    head = head.rstrip()
    if not head or head[-1] in STOPS:
        return None
    if style > 0.94:  # inside of markup
        piece = str(rng.choice(MARKUP))
        head = f"{head} {piece[: int(rng.integers(1, len(piece)))]}"
    return head + (str(rng.choice(["...", "…", " [...]"])) if style < 0.25 else ""), at


def fit(rows: pd.DataFrame, lim: Limits, epochs: int = 6, seed: int = 11) -> Scorer:
    """Logistic regression on intact values and their artificial cuts; ``rows``: (source, field, value).

    Half of the cuts are made as by a source with a limit there, so that every language and kind of value teaches what
    a limit means; a few complete values that happen to be as long as a limit are made too.
    """
    rng = np.random.default_rng(seed)
    xs: list[list[int]] = []
    ys: list[int] = []

    def add(source: str | None, name: str, value: str, y: int, limit: int | None) -> None:
        xs.append(features(source, name, value, Limits({(source or "", name): {limit: 9.0}} if limit else {})))
        ys.append(y)

    for source, name, value in rows.sort_values(["field", "value"]).itertuples(index=False):
        raw = value.strip()
        if not raw or _MARK.search(raw) or lim.at(source, name, len(value)) or lim.at(source, name, len(raw)) or lim.at(source, name, len(raw) + 1):
            continue
        add(source, name, value, 0, len(raw) + int(rng.integers(0, 2)) if rng.random() < 0.006 else None)
        if rng.random() < 0.6 and (c := cut(rng, raw)):
            add(source, name, c[0], 1, c[1] if rng.random() < 0.5 else None)
        if raw[-1] in STOPS and rng.random() < 0.15:  # complete sentences before the end are complete values too
            ends = [m.end() for m in re.finditer(f"[{re.escape(STOPS)}](?=\\s)", raw)]
            if ends:
                end = int(rng.choice(ends))
                add(source, name, raw[:end], 0, end if rng.random() < 0.5 else None)
    w, acc = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    y = np.array(ys, dtype=float)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 64)):
            if not len(part):
                continue
            rows_ = np.concatenate([xs[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(xs[i]) for i in part])
            p = 1 / (1 + np.exp(-np.bincount(owner, w[rows_], minlength=len(part))))
            used, at = np.unique(rows_, return_inverse=True)
            g = np.bincount(at, (p - y[part])[owner]) / len(part) + 2e-5 * w[used]
            acc[used] += g**2
            w[used] -= 0.15 * g / np.sqrt(acc[used])
    return Scorer(w, lim)


def learn(values: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Scorer:
    """Scorer of ``values`` (source, field, value): limits from all of them, weights from at most ``sample`` per field."""
    lim = limits(values)
    names = {r.field: r.n for r in values.groupBy("field").agg(F.count("*").alias("n")).collect()}  # one row per field
    h = F.pmod(F.xxhash64("source", "value", F.lit(seed)), F.lit(1_000_000))
    take = F.lit(False)
    for name, n in names.items():
        take = take | ((F.col("field") == name) & (h < int(1_000_000 * min(1.0, sample / n))))
    rows = values.filter(take).select("source", "field", "value").distinct().limit(2 * sample * max(len(names), 1)).toPandas()
    return fit(rows, lim, seed=seed)


def score(values: DataFrame, scorer: Scorer, keys: list[str], least: float = 0.5) -> DataFrame:
    """The key columns of ``values`` with (field, p double, truncated boolean), one row per value.

    NULL and blank values aren't truncated (p 0). Whole tables are scored, values of any length.
    """
    shared = values.sparkSession.sparkContext.broadcast(scorer)  # FEATURES numbers and some lengths per source
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", field string, p double, truncated boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for b in batches:
            p = [0.0 if v is None or not v.strip() else s.score(a, n, v) for a, n, v in zip(b["source"], b["field"], b["value"], strict=True)]
            yield b[keys].assign(field=b["field"], p=p, truncated=[x >= least for x in p])

    return values.select(*dict.fromkeys([*keys, "source", "field", "value"])).mapInPandas(run, schema)


def article_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/articles.parquet")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "description")]))
    return a.select("row_id", F.col("provider_id").alias("source"), each.alias("e")).select("row_id", "source", "e.field", "e.value").filter("value IS NOT NULL")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions that stop before their headline or sentence is complete."""
    v = article_values(spark, sf_dir)
    return score(v, learn(v), ["row_id"]).filter("truncated").select("row_id", "field")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates each field."""
    v = article_values(spark, sf_dir)
    rows = score(v, learn(v), ["row_id", "source"])
    return rows.groupBy("source", "field").agg(F.count("*").alias("values"), F.count_if("truncated").alias("truncated"), F.avg(F.col("truncated").cast("int")).alias("share"))
