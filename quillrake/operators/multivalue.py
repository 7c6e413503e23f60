"""Several values packed in one text, split into one value per row.

A text is a lattice over the stretches between its delimiters. Any delimiter may separate or belong to a value: how
often each written form of it separates, and how frequent each value is, are learned from the whole column by
expectation maximisation (forward-backward over the lattices of all distinct texts). Viterbi then picks the cuts.
Quoted spans are atomic.

A value that other texts hold too scores its frequency there; any other one is spelled letter by letter. Spelled values
of any length are followed by one state of the chain, so no value is too long for the lattice.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, workdir, written

#: Delimiters that are likely to separate, and those that are as likely as not, before anything is learned.
HARD = ",;|\t\n\r•·；，、｜"
SOFT = "/&+-–—／＆＋"
LIKELY, OPEN = 0.95, 0.5
#: Pairs of quotation marks.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}

#: Values that are expected fewer times in other texts are spelled.
LEAST = 0.1

#: Most bytes of the table of known values that are broadcast; a larger one is joined to the texts instead.
KNOWN_BYTES = 8 << 20

_BLANK = r"[^\S\t\n\r]*"
_run = lambda more="": re.compile(rf"(?:[{re.escape(HARD + SOFT + more)}]{_BLANK})+")
_PLAIN, _TAGGED, _LISTED = _run(), _run("#"), _run("[]")
#: A text of hash tags; a list in brackets.
_TAGS = re.compile(r"\s*#[^\s#][^#]*(?:\s#[^\s#][^#]*)*")
_LIST = re.compile(r'\s*\[\s*".*"\s*\]\s*', re.DOTALL)
_ANY_QUOTE = re.compile(f"[{''.join(QUOTES)}]")
_QUOTED = re.compile("|".join(rf"{a}[^{a}{b}]*(?:{a}{a}[^{a}{b}]*)*{b}" if a == b else rf"{a}[^{a}{b}]*{b}" for a, b in QUOTES.items()))
_BESIDE = set(HARD + SOFT + "[]#")


def _quoted_spans(text: str) -> list[tuple[int, int]]:
    """Quoted spans that are whole values: they begin after a delimiter and end before one."""
    out, at = [], 0
    for m in _QUOTED.finditer(text):
        if m.start() < at:
            continue
        a, b = m.start() - 1, m.end()
        while a >= 0 and text[a].isspace() and text[a] not in HARD:
            a -= 1
        while b < len(text) and text[b].isspace() and text[b] not in HARD:
            b += 1
        if (a < 0 or text[a] in _BESIDE) and (b >= len(text) or text[b] in _BESIDE):
            out.append(m.span())
            at = m.end()
    return out


def unquoted(value: str) -> str:
    """A value without the quotes around it; doubled and escaped quotes inside become single ones."""
    v = value.strip()
    if len(v) >= 2 and QUOTES.get(v[0]) == v[-1]:
        mark, v = v[-1], v[1:-1]
        v = v.replace(mark * 2, mark).replace("\\" + mark, mark)
    return v.strip()


@functools.lru_cache(maxsize=50_000)
def form_of(run: str, left: bool) -> str:
    """Written form of a run of delimiters: its first and last character, and where it has blanks; ``left``: before it."""
    marks = [c for c in run if not c.isspace() or c in HARD]
    core = marks[0] if len(marks) == 1 else f"{marks[0]}+{marks[-1]}"
    return ("_" if left or run[0].isspace() else "") + core + ("_" if run[-1].isspace() else "")


def prior(form: str) -> float:
    """Probability that a form separates, before anything is learned."""
    return LIKELY if any(c in HARD or c in "#[]" for c in form) else OPEN


@dataclass
class Lattice:
    """Stretches of a text (from, to, without the blanks around them) and the forms of the delimiters between them.

    Only the first and the last stretch may be empty: the text begins or ends with a delimiter.
    """

    text: str
    begins: list[int]
    ends: list[int]
    forms: list[str]

    def value(self, i: int, j: int) -> str:
        """Value over the stretches i..j."""
        v = self.text[self.begins[i] : self.ends[j]]
        return unquoted(v) if v and v[0] in QUOTES else v

    def key(self, i: int, j: int) -> str:
        """What a value is counted as: one with delimiters inside keeps its quotes, as the quotes tell that these would
        separate without them, so it is no evidence for the same letters unquoted."""
        v = self.text[self.begins[i] : self.ends[j]]
        if not v or v[0] not in QUOTES:
            return v
        bare = unquoted(v)
        return v if _PLAIN.search(bare) else bare

    def keys(self) -> list[str]:
        """Keys of the single stretches."""
        out = [self.text[x:y] for x, y in zip(self.begins, self.ends, strict=True)]
        return out if _ANY_QUOTE.search(self.text) is None else [self.key(i, i) for i in range(len(out))]


def lattice(text: str) -> Lattice:
    spans = _quoted_spans(text) if _ANY_QUOTE.search(text) else []
    pattern, size = _PLAIN, len(text)
    if "#" in text and _TAGS.fullmatch(text):
        pattern = _TAGGED
    elif spans and "[" in text and _LIST.fullmatch(text):
        pattern = _LISTED
    begins, ends, forms, k = [size - len(text.lstrip())], [], [], 0
    for m in pattern.finditer(text):
        a, b = m.span()
        if spans:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if k < len(spans) and spans[k][0] < a:
                continue
        begin, end = begins[-1], a
        while end > begin and text[end - 1].isspace():
            end -= 1
        ends.append(max(begin, end))
        forms.append(form_of(text[a:b] + (" " if b == size else ""), a == 0 or text[a - 1].isspace()))
        begins.append(b)
    ends.append(max(begins[-1], len(text.rstrip())))
    return Lattice(text, begins, ends, forms)


@dataclass
class Known:
    """Values that several texts hold: log probabilities of the ``scores``, and the ``steps`` (number of stretches less
    one) of those with delimiters inside, by their first stretch."""

    scores: dict[str, float]
    steps: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, float], total: float) -> Known:
        """Of values and their expected numbers in other texts, of ``total`` values in all."""
        steps: dict[str, set[int]] = {}
        for v in counts:
            at = lattice(v)
            if at.forms:
                steps.setdefault(at.key(0, 0), set()).add(len(at.forms))
        return cls({v: math.log(c / total) for v, c in counts.items()}, {k: sorted(s) for k, s in steps.items()})


@dataclass
class Model:
    """``separates``: probability of each form; ``total`` of the values' counts, ``novel``: what of it falls to values that
    no other text holds, learned too; ``letter``: cost of each of their letters."""

    separates: dict[str, float]
    total: float
    novel: float
    letter: float

    @functools.cached_property
    def logs(self) -> dict[str, tuple[float, float]]:
        return {f: (math.log(p), math.log1p(-p)) for f, p in self.separates.items()}

    def scored(self, lat: Lattice, known: Known) -> tuple[list[float], list[tuple[int, int, float]], list[float], list[float], list[float], float]:
        """By stretch the score of its known value (-inf if it is none); edges of known values of several stretches
        (i, j, score); by stretch the cost of spelling it; by delimiter the scores of cutting there and of spelling on
        over it; the score of beginning to spell."""
        b, e, letter, logs = lat.begins, lat.ends, self.letter, self.logs
        cut, on = [], []
        for k, f in enumerate(lat.forms):
            c, j = logs[f] if f in logs else (math.log(prior(f)), math.log1p(-prior(f)))
            cut.append(c)
            on.append(j - letter * (b[k + 1] - e[k]))
        keys = lat.keys()
        get = known.scores.get
        single = [get(v, -math.inf) if v else 0.0 for v in keys]  # an empty value costs nothing: it is dropped
        several = []
        for i, v in enumerate(keys):
            if v in known.steps:
                for m in known.steps[v]:
                    if i + m < len(keys) and (s := get(lat.key(i, i + m))) is not None:
                        several.append((i, i + m, s + sum(x + letter * (b[k + 1] - e[k]) for k, x in enumerate(on[i : i + m], i))))
        return single, several, [letter * (x - y) for x, y in zip(b, e, strict=True)], cut, on, math.log(self.novel / self.total)

    def expect(self, lat: Lattice, known: Known, least: float = 1e-3) -> tuple[list[tuple[str, float]], list[float]]:
        """Expected values of a text (value, probability), those below ``least`` left out, and for each delimiter the
        probability that it separates."""
        single, several, spell, cut, on, start = self.scored(lat, known)
        n, low, exp, log1p = len(spell), math.log(least), math.exp, math.log1p
        cut = [*cut, 0.0]
        into: dict[int, list[tuple[int, float]]] = {}
        out_of: dict[int, list[tuple[int, float]]] = {}
        for i, j, s in several:
            into.setdefault(j, []).append((i, s))
            out_of.setdefault(i, []).append((j, s))
        # Score of all readings up to a stretch that end a value there, cut included (end), or spell on (h).
        end, h, before = [0.0] * n, -math.inf, 0.0
        for k in range(n):
            x, y = before + start, (h + on[k - 1] if k else -math.inf)
            if y > x:
                x, y = y, x
            h = (x + log1p(exp(y - x)) if y - x > -30 else x) + spell[k]
            x, y = h, before + single[k]
            if y > x:
                x, y = y, x
            s = x + log1p(exp(y - x)) if y - x > -30 else x
            for i, x in into.get(k, ()):
                s = _add(s, (end[i - 1] if i else 0.0) + x)
            end[k] = before = s + cut[k]
        z = before
        # Score of all readings from a stretch on: a value begins there (begin), or one that is spelled goes on (rest).
        begin, rest, r, after = [0.0] * (n + 1), [0.0] * n, -math.inf, 0.0
        for k in range(n - 1, -1, -1):
            x, y = after + cut[k], (r + on[k] + spell[k + 1] if k < n - 1 else -math.inf)
            if y > x:
                x, y = y, x
            rest[k] = r = x + log1p(exp(y - x)) if y - x > -30 else x
            x, y = start + spell[k] + r, single[k] + cut[k] + after
            if y > x:
                x, y = y, x
            s = x + log1p(exp(y - x)) if y - x > -30 else x
            for j, x in out_of.get(k, ()):
                s = _add(s, x + cut[j] + begin[j + 1])
            begin[k] = after = s
        out: dict[str, float] = {}

        def add(i: int, j: int, q: float) -> None:
            if q >= low and (v := lat.key(i, j)):
                out[v] = out.get(v, 0.0) + exp(min(0.0, q))

        for i in range(n):
            s = (end[i - 1] if i else 0.0) - z
            add(i, i, s + single[i] + cut[i] + begin[i + 1])
            for j, x in out_of.get(i, ()):
                add(i, j, s + x + cut[j] + begin[j + 1])
            s += start + spell[i]
            for j in range(i, n):
                if s + rest[j] < low:  # probability that a spelled value from i on holds j
                    break
                add(i, j, s + cut[j] + begin[j + 1])
                if j < n - 1:
                    s += on[j] + spell[j + 1]
        return list(out.items()), [exp(min(0.0, end[k] + begin[k + 1] - z)) for k in range(n - 1)]

    def expect_all(self, lats: list[Lattice], known: Known, least: float = 1e-3) -> Iterator[tuple[list[tuple[str, float]], list[float], list[str]]]:
        """``expect`` of many texts, with their forms: those of equally many stretches are summed at once, unless a known
        value of several stretches is in them."""
        groups: dict[int, tuple[list[Lattice], list[list[str]]]] = {}
        for lat in lats:
            if not lat.forms:  # one value for certain
                v = lat.key(0, 0)
                yield ([(v, 1.0)] if v else []), [], []
                continue
            keys = lat.keys()
            if len(keys) > 24 or any(lat.key(i, i + m) in known.scores for i, v in enumerate(keys) if v in known.steps for m in known.steps[v] if i + m < len(keys)):
                yield (*self.expect(lat, known, least), lat.forms)
                continue
            of = groups.setdefault(len(keys), ([], []))
            of[0].append(lat)
            of[1].append(keys)
        for n, (own, keys) in groups.items():
            yield from self._expect_group(n, own, keys, known, least)

    def _expect_group(self, n: int, lats: list[Lattice], keys: list[list[str]], known: Known, least: float) -> Iterator[tuple[list[tuple[str, float]], list[float], list[str]]]:
        get, logs, add = known.scores.get, self.logs, np.logaddexp
        for f in {f for lat in lats for f in lat.forms} - logs.keys():
            logs[f] = math.log(prior(f)), math.log1p(-prior(f))
        begins, ends = np.array([x.begins for x in lats]), np.array([x.ends for x in lats])
        single = np.array([[get(v, -math.inf) if v else 0.0 for v in ks] for ks in keys])
        pairs = np.array([[logs[f] for f in x.forms] for x in lats])
        cut = np.concatenate([pairs[:, :, 0], np.zeros((len(lats), 1))], axis=1)
        on, spell, start = pairs[:, :, 1] - self.letter * (begins[:, 1:] - ends[:, :-1]), self.letter * (begins - ends), math.log(self.novel / self.total)
        end, begin, rest = np.zeros((n, len(lats))), np.zeros((n + 1, len(lats))), np.zeros((n, len(lats)))
        before = np.zeros(len(lats))
        for k in range(n):
            h = (add(before + start, h + on[:, k - 1]) if k else before + start) + spell[:, k]
            end[k] = before = add(h, before + single[:, k]) + cut[:, k]
        for k in range(n - 1, -1, -1):
            after = begin[k + 1] + cut[:, k]
            rest[k] = r = add(after, r + on[:, k] + spell[:, k + 1]) if k < n - 1 else after
            begin[k] = add(start + spell[:, k] + r, single[:, k] + after)
        low, found = math.log(least), [[] for _ in lats]
        for i in range(n):
            s = (end[i - 1] if i else 0.0) - before
            whole = add(s + start + spell[:, i], s + single[:, i]) + cut[:, i] + begin[i + 1]  # this one stretch, known or spelled
            for values, ks, p in zip(found, keys, np.exp(np.minimum(0.0, whole)).tolist(), strict=True):
                if p >= least and ks[i]:
                    values.append((ks[i], p))
            s = s + start + spell[:, i]
            for j in range(i + 1, n):
                s = s + on[:, j - 1] + spell[:, j]
                if not (s + rest[j] >= low).any():
                    break
                whole = np.exp(np.minimum(0.0, s + cut[:, j] + begin[j + 1]))
                for b in np.flatnonzero(whole >= least).tolist():
                    found[b].append((lats[b].key(i, j), float(whole[b])))
        cuts = np.exp(np.minimum(0.0, end + begin[1:] - before)).T.tolist()
        for values, c, lat in zip(found, cuts, lats, strict=True):
            yield values, c[:-1], lat.forms

    def best(self, lat: Lattice, known: Known) -> list[str]:
        """Values of the best reading; of equally good ones that with known values, then that with fewer cuts."""
        if not lat.forms:
            v = lat.value(0, 0)
            return [v] if v else []
        single, several, spell, cut, on, start = self.scored(lat, known)
        n = len(spell)
        into: dict[int, list[tuple[int, float]]] = {}
        for i, j, s in several:
            into.setdefault(j, []).append((i, s))
        end, came, h, begun, before = [0.0] * n, [0] * n, -math.inf, 0, 0.0
        for k in range(n):
            fresh, going = before + start, (h + on[k - 1] if k else -math.inf)
            h, begun = (going + spell[k], begun) if going >= fresh else (fresh + spell[k], k)
            top, at = h, begun
            if before + single[k] >= top:
                top, at = before + single[k], k
            for i, x in into.get(k, ()):
                s = (end[i - 1] if i else 0.0) + x
                if s >= top:
                    top, at = s, i
            end[k], came[k] = (top + cut[k] if k < n - 1 else top), at
            before = end[k]
        out, k = [], n - 1
        while k >= 0:
            if v := lat.value(came[k], k):
                out.append(v)
            k = came[k] - 1
        return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b < a - 40 else a + math.log1p(math.exp(b - a))


def _first_guess(lat: Lattice, least: float = 0.01, alike: float = 0.25) -> tuple[list[tuple[str, float]], list[float]]:
    """Expected values where each delimiter separates by itself with the prior probability of its form, or (with the
    probability ``alike``) none of the open ones between two likely ones does."""
    cuts = [prior(f) for f in lat.forms]
    out: dict[str, float] = {}
    if OPEN in cuts:
        edges = [-1, *(k for k, p in enumerate(cuts) if p != OPEN), len(cuts)]
        for i, j in itertools.pairwise(edges):
            if v := lat.key(i + 1, j):
                out[v] = out.get(v, 0.0) + alike
    rest = 1 - alike if out else 1.0
    for i in range(len(lat.begins)):
        p = rest * cuts[i - 1] if i else rest
        for j in range(i, len(lat.begins)):
            q = p * (cuts[j] if j < len(cuts) else 1.0)
            if q >= least and (v := lat.key(i, j)):
                out[v] = out.get(v, 0.0) + q
            if j < len(cuts):
                p *= 1 - cuts[j]
            if p < least:
                break
    return list(out.items()), cuts


Sums = Iterator[tuple[list[tuple[str, float]], list[float], list[str]]]


def _sums(read: Callable[[list[str], list | None], Sums]):
    """Partial sums of what texts are expected to hold: (kind, v, s, n) with values (kind 0) and forms (kind 1)."""

    def rows(held: list[tuple[dict, dict]]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"kind": k, "v": pd.Series(list(s), dtype=object), "s": list(s.values()), "n": list(n.values())}) for k, (s, n) in enumerate(held)]).astype({"kind": "int32", "s": float, "n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[dict[str, float], dict[str, int]]] = [({}, {}), ({}, {})]
        for b in batches:
            (vs, vn), (fs, fn) = held
            for values, cuts, forms in read(b["text"].tolist(), b["near"].tolist() if "near" in b else None):
                for v, p in values:
                    vs[v] = vs.get(v, 0.0) + p
                    vn[v] = vn.get(v, 0) + 1
                for f, p in zip(forms, cuts, strict=True):
                    fs[f] = fs.get(f, 0.0) + p
                    fn[f] = fn.get(f, 0) + 1
            if len(vs) > 200_000:
                yield rows(held)
                held = [({}, {}), ({}, {})]
        yield rows(held)

    return run


class Splitter:
    """Learns from ``texts`` (a column ``text``) how its delimiters behave and how frequent its values are, then splits.

    Parameters: ``rounds`` of expectation maximisation, ``letter`` as in ``Model``, ``known_bytes``: most bytes of known
    values that are broadcast (the way beyond gives the same result). Texts count once, however often they are repeated.
    """

    def __init__(self, texts: DataFrame, rounds: int = 3, letter: float = 1.5, known_bytes: int = KNOWN_BYTES):
        self.spark, self.known_bytes = texts.sparkSession, known_bytes
        self.root = workdir(self.spark, "multivalue")
        self.texts = written(texts.select("text").filter("text IS NOT NULL").distinct(), f"{self.root}/texts")
        self.model = Model({}, 1.0, 1.0, letter)
        self.table: DataFrame | None = None
        self.shared = None
        self._learn(_sums(_guess), self.texts, 0)
        for k in range(1, rounds + 1):
            reader, rows = _expected(self.model, self.shared), self._with_known()
            self._learn(_sums(reader), rows, k)
            delete_path(self.spark, f"{self.root}/round-{k - 1}")

    def _learn(self, sums, rows: DataFrame, k: int) -> None:
        """One round over all distinct texts: sums of expectations become probabilities and counts."""
        found = rows.mapInPandas(sums, "kind int, v string, s double, n long").groupBy("kind", "v").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        found = written(found, f"{self.root}/round-{k}")
        forms = found.filter("kind = 1").collect()  # a few per pair of delimiters
        separates = {r.v: min((r.s + prior(r.v)) / (r.n + 1.0), 1 - 1e-12) for r in forms}
        # A text's own share doesn't tell of its values, so the mean share of a text is taken off each count.
        values = found.filter("kind = 0").select("v", "s", (F.col("s") - F.col("s") / F.col("n")).alias("c"))
        self.table = values.filter(F.col("c") >= LEAST).select("v", "c")
        known = F.col("c") >= LEAST
        size = values.agg(F.sum("s").alias("total"), F.sum(F.when(known, F.col("c"))).alias("known"), F.sum(F.when(known, F.octet_length("v") + 100)).alias("bytes")).first()
        total = (size.total or 0.0) + 1.0
        self.model = Model(separates, total, total - (size.known or 0.0), self.model.letter)
        if self.shared is not None:
            self.shared.destroy()
        self.shared = None
        if (size.bytes or 0) <= self.known_bytes:
            self.shared = self.spark.sparkContext.broadcast(Known.of({r.v: r.c for r in self.table.collect()}, self.model.total))

    def _with_known(self) -> DataFrame:
        """The distinct texts, with the known values that each may hold (``near``) where these aren't broadcast."""
        if self.shared is not None:
            return self.texts
        steps = self.table.mapInPandas(_longest, "n int").agg(F.max("n")).first()[0] or 0

        def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for t in b["text"]:
                    lat = lattice(t)
                    n = len(lat.begins)
                    rows += [(t, v) for v in {lat.key(i, j) for i in range(n) for j in range(i, min(n, i + steps + 1))}]
                yield pd.DataFrame(rows, columns=["text", "v"])

        found = self.texts.mapInPandas(candidates, "text string, v string").join(self.table, "v")
        near = found.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("near"))
        return self.texts.join(near, "text", "left")

    def split(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``vals array<string>``: the values of its column ``text`` in their order.

        NULL and blank texts have no values (an empty array). Every row comes out once. ``df`` needs no key; names
        that start with ``qr_`` are reserved, and a column ``vals`` is replaced.
        """
        own = [F.col(f"`{c}`") for c in df.columns if c != "vals"]
        none = F.array().cast("array<string>")
        if self.shared is not None:
            vals = F.pandas_udf(_split(self.model, self.shared), T.ArrayType(T.StringType()))(F.coalesce(F.col(f"`{text}`"), F.lit("")))
            return df.select(*own, vals.alias("vals"))
        model = self.model

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"qr_text": b["text"], "qr_vals": [model.best(lattice(t), Known.of(dict(m or {}), model.total)) for t, m in zip(b["text"], b["near"], strict=True)]})

        # One row per distinct text; adaptive execution splits hot texts of the other side.
        done = written(self._with_known().mapInPandas(decide, "qr_text string, qr_vals array<string>"), f"{self.root}/decided")
        return df.join(done, df[text] == done["qr_text"], "left").select(*own, F.coalesce("qr_vals", none).alias("vals"))


def _guess(texts: list[str], _) -> Sums:
    for t in texts:
        lat = lattice(t)
        yield (*_first_guess(lat), lat.forms)


def _expected(model: Model, shared):
    def run(texts: list[str], near: list | None) -> Sums:
        if shared is not None:
            yield from model.expect_all([lattice(t) for t in texts], shared.value)
            return
        for t, m in zip(texts, near, strict=True):
            yield from model.expect_all([lattice(t)], Known.of(dict(m or {}), model.total))

    return run


def _longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"n": [max((len(lattice(v).forms) for v in b["v"]), default=0)]}, dtype="int32")


def _split(model: Model, shared):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, memo = shared.value, {}
        for b in batches:
            out = []
            for t in b:
                got = memo.get(t)
                if got is None:
                    if len(memo) > 50_000:  # a cache only
                        memo.clear()
                    got = memo[t] = model.best(lattice(t), known)
                out.append(got)
            yield pd.Series(out, dtype=object)

    return run


def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword texts of the entries and articles: (tab, row_id, text, listed); ``listed``: the list an article has now."""
    e = spark.read.parquet(f"{sf_dir}/sitemap_entries.parquet").select(F.lit("sitemap_entries").alias("tab"), F.col("entry_id").alias("row_id"), F.col("news.keywords").alias("text"), F.lit(None).cast("array<string>").alias("listed"))
    a = spark.read.parquet(f"{sf_dir}/articles.parquet").select(F.lit("articles").alias("tab"), "row_id", F.array_join("keywords", ", ").alias("text"), F.col("keywords").alias("listed"))
    return e.unionByName(a).filter("text IS NOT NULL")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each packed field: entries of two values or more, articles whose list isn't its values."""
    texts = packed_texts(spark, sf_dir)
    done = Splitter(texts).split(texts, "text")
    packed = F.when(F.col("tab") == "articles", ~F.col("listed").eqNullSafe(F.col("vals"))).otherwise(F.size("vals") >= 2)
    return done.filter(packed).select("tab", "row_id", F.posexplode("vals").alias("p", "val")).select("tab", "row_id", (F.col("p") + 1).cast("bigint").alias("pos"), "val")
