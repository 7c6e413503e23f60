"""Languages of documents and of the segments of mixed ones: a linear-chain conditional random field over words.

Features of a word are its affixes, character n-grams, script and itself (the lexicon), hashed; the transitions between
the languages of neighbouring words are learned too. It is trained on a bounded sample of rows with declared labels,
whose stretches are first relabelled by vote, as some labels are wrong and some texts are mixed.
Forward-backward gives each word's language probabilities; a segment takes the language that its words favour. Segments
end at punctuation, and without it where runs of words are surely of different languages.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookalikes import _CLASS, LOOKALIKES, PLAIN

LANGS = ("en", "de", "fr", "es", "pt", "nl", "ru", "hi")

#: Spellings of the languages' names and codes, small letters, before any '-' or '_'.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "nl": "nl nld dut dutch nederlands niederländisch",
    "ru": "ru rus russian русский russisch",
    "hi": "hi hin hindi हिन्दी हिंदी",
}
_CODE = {n: code for code, names in NAMES.items() for n in names.split()}

#: Size of the table of hashed features; most rows that the field is fitted to, per declared language.
FEATURES, ROWS_PER_LANGUAGE = 1 << 16, 1200

#: Stretches of one or two words need this confidence to be in another language than the stretch beside them.
SURE = 0.75

#: Inside a stretch another language begins only where its words gain so many nats; least probability of a word there.
TURN, DOUBT = 8.0, 0.02

#: Letters that another one, the first of its set, is taken for in Latin words.
_ALIKE = re.compile("[" + "".join(c for g in LOOKALIKES for c in g[1:]) + "]")

_MARKS = "̀-ͯ҃-҇ऀ-ःऺ-ॏ॑-ॗॢॣ‌‍"
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}]|['’](?=[^\W\d_]))*")
#: Where one stretch of text may end and another, in another language, begin.
_BREAK = re.compile(r"(?<=[.!?।…])[\"”»')\]]*\s+|\s*\n+\s*|\s*[:;]\s+|\s+[|/•·–—\-]\s+|\s*[|•·]\s*")


#: What any such place needs; most headlines have nothing of it, or one of ``_ENDING`` at their end only.
_POINT, _ENDING = re.compile(r"[.!?।…\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029:;|•·/–—\-]"), ".!?।…/–—-"
_MAY_BREAK = re.compile(r"[.!?।…][\"”»')\]]*\s|[\n:;|•·]|\s[/–—\-]\s")


def code_of(label: str | None) -> str | None:
    """Two-letter code that a label names; None if it names none of the languages."""
    return _CODE.get(re.split(r"[-_]", (label or "").strip().lower())[0])


def tidy(text: str) -> str:
    """Plain widths and blanks; look-alike letters of another script in a word become those of its other letters."""
    if text.isascii():
        return text
    # As ``plain`` has it, composed: composing undoes that it decomposes first.
    text = "\n".join([unicodedata.normalize("NFC", " ".join(x.translate(PLAIN).split())) for x in text.splitlines()])
    return _WORD.sub(lambda m: _one_script(m[0]), text) if _ALIKE.search(text) else text


@functools.lru_cache(maxsize=200_000)
def _one_script(w: str) -> str:
    if w.isascii() or not any(c in _CLASS for c in w):
        return w
    cyr = sum("Ѐ" <= c < "԰" and c not in _CLASS for c in w)
    lat = sum(c not in _CLASS and (c < "ɐ" and c.isalpha()) for c in w)
    low = sum("Ѐ" <= c < "԰" for c in w)
    to_cyr = cyr > lat or (cyr == lat and low * 2 > len(w))
    pick = (lambda g: next((x for x in g if "Ѐ" <= x < "԰"), g[0])) if to_cyr else (lambda g: g[0])
    return "".join(pick(_CLASS[c]) if c in _CLASS else c for c in w)


def stretches(text: str) -> list[tuple[int, int]]:
    """(from, to) of the sentences and headlines of a text."""
    point = _POINT.search(text)
    if point is None or (point.end() == len(text) and point[0] in _ENDING) or not _MAY_BREAK.search(text, max(0, point.start() - 1)):
        return [(0, len(text))] if text else []
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


_HASHES: dict[str, int] = {}


def _hash(kind: str, s: str) -> int:
    key = kind + s
    got = _HASHES.get(key)
    if got is None:
        if len(_HASHES) > 1_000_000:  # a cache only: pieces of words repeat
            _HASHES.clear()
        got = _HASHES[key] = zlib.crc32(key.encode()) % FEATURES
    return got


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, affixes, character n-grams, script and shape."""
    w = word.lower()
    e = f"^{w}$"
    out = [_hash("w", w), _hash("len", str(min(len(w), 12)))]
    out += [_hash("p", w[:k]) for k in (1, 2, 3, 4) if len(w) >= k] + [_hash("s", w[-k:]) for k in (1, 2, 3, 4) if len(w) >= k]
    out += [_hash("n", e[i : i + k]) for k in (2, 3, 4) for i in range(len(e) - k + 1)]
    out += [_hash("c", unicodedata.name(c, "?").split(" ")[0]) for c in {w[0], w[-1]}] + [_hash("x", c) for c in set(w) if not c.isascii()]
    return out


@dataclass
class Field:
    """Weights of the features (FEATURES x languages) and the transitions, and words whose scores are known."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    places: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return {"weights": self.weights, "trans": self.trans, "start": self.start, "places": {}, "table": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of words: (words, languages). Words that were met before are looked up."""
        if self.table is None or len(self.places) > 300_000:  # a cache only
            self.places.clear()
            self.table = np.zeros((1024, len(LANGS)))
        places = self.places
        at = [places.get(w, -1) for w in words]
        if new := list(dict.fromkeys(words[i] for i, k in enumerate(at) if k < 0)):
            first, feats = len(places), [features(w) for w in new]
            places.update(zip(new, range(first, first + len(new)), strict=True))
            if len(places) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), len(LANGS)))])
            ends = np.cumsum([0, *map(len, feats)])
            self.table[first : first + len(new)] = np.add.reduceat(self.weights[np.concatenate(feats)], ends[:-1], axis=0)
            at = [places[w] if k < 0 else k for w, k in zip(words, at, strict=True)]
        return self.table[at] if at else np.zeros((0, len(LANGS)))

    def posteriors(self, emissions: list[np.ndarray], pairs: np.ndarray | None = None) -> list[np.ndarray]:
        """Probabilities of the languages of each word of each text, by forward-backward over texts of like length.

        ``pairs``: array to which the expected number of each transition is added.
        """
        out: list[np.ndarray | None] = [None] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        at = 0
        while at < len(order):
            most, chunk = len(emissions[order[at]]), []
            while at < len(order) and len(chunk) < 256 and (len(emissions[order[at]]) <= max(8, most * 1.3)):
                chunk.append(order[at])
                at += 1
            for i, p in zip(chunk, self._batch([emissions[i] for i in chunk], pairs), strict=True):
                out[i] = p
        return out

    def _batch(self, emissions: list[np.ndarray], pairs: np.ndarray | None = None) -> list[np.ndarray]:
        n = np.array([len(e) for e in emissions])
        b, t, k = len(emissions), max(int(n.max()), 1), len(LANGS)
        x = np.zeros((b, t, k))
        for i, e in enumerate(emissions):
            if len(e):
                x[i, : len(e)] = e
        x = np.exp(np.clip(x - x.max(axis=2, keepdims=True), -60, 0))
        m, begin = np.exp(self.trans), np.exp(self.start)
        fw, bw = np.zeros((b, t, k)), np.ones((b, t, k))
        fw[:, 0] = begin * x[:, 0]
        fw[:, 0] /= fw[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, t):
            fw[:, j] = (fw[:, j - 1] @ m) * x[:, j]
            fw[:, j] /= fw[:, j].sum(axis=1, keepdims=True)
        for j in range(t - 2, -1, -1):
            step = (bw[:, j + 1] * x[:, j + 1]) @ m.T
            step /= step.sum(axis=1, keepdims=True)
            bw[:, j] = np.where((j + 1 < n)[:, None], step, 1.0)
        if pairs is not None and t > 1:
            # Forward * transition * emission * backward, scaled to 1 for each pair of neighbouring words.
            right = x[:, 1:] * bw[:, 1:]
            scale = (np.arange(1, t)[None] < n[:, None]) / ((fw[:, :-1] @ m) * right).sum(axis=2)
            pairs += m * ((fw[:, :-1] * scale[..., None]).reshape(-1, k).T @ right.reshape(-1, k))
        p = fw * bw
        p /= p.sum(axis=2, keepdims=True)
        return [p[i, : n[i]] for i in range(b)]


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of ``size`` places."""
    return np.stack([np.bincount(at, c, minlength=size) for c in rows.T], axis=1) if len(at) else np.zeros((size, rows.shape[1]))


def train(sequences: list[tuple[list[str], np.ndarray]], epochs: int = 6, rate: float = 0.3, seed: int = 5) -> Field:
    """Fit a field to (words, language number of each word) by AdaGrad on the likelihood of the labels."""
    k = len(LANGS)
    f = Field(np.zeros((FEATURES, k)), np.eye(k) * 2.0, np.zeros(k))
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for ws, _ in sequences]
    feats = [np.array(features(w)) for w in vocab]
    flat, sizes = (np.concatenate(feats) if feats else np.zeros(0, dtype=int)), np.array([len(x) for x in feats], dtype=int)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    gw, gt, gs = np.full((FEATURES, k), 1e-2), np.full((k, k), 1.0), np.full(k, 1.0)
    rng, place = np.random.default_rng(seed), np.zeros(FEATURES, dtype=np.int64)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 128)):
            part = [i for i in part if len(ids[i])]
            if not part:
                continue
            used, local = np.unique(np.concatenate([ids[i] for i in part]), return_inverse=True)
            rows = np.concatenate([flat[ends[u] : ends[u + 1]] for u in used])
            owner = np.repeat(np.arange(len(used)), sizes[used])
            scores = np.add.reduceat(f.weights[rows], np.concatenate([[0], np.cumsum(sizes[used])[:-1]]), axis=0)
            cut = np.cumsum([len(ids[i]) for i in part])[:-1]
            where = np.split(local, cut)
            labels = [sequences[i][1] for i in part]
            emissions = [scores[w] for w in where]
            errors = []
            dt, ds = np.zeros((k, k)), np.zeros(k)
            post = f.posteriors(emissions, dt)
            for y, p in zip(labels, post, strict=True):
                g = p.copy()
                g[np.arange(len(y)), y] -= 1.0
                errors.append(g)
                np.add.at(dt, (y[:-1], y[1:]), -1.0)
                ds += p[0]
                ds[y[0]] -= 1.0
            touched = np.flatnonzero(np.bincount(rows, minlength=FEATURES))
            place[touched] = np.arange(len(touched))
            at = place[rows]
            diff = _sums(np.concatenate(where), np.concatenate(errors), len(used))
            g = _sums(at, diff[owner], len(touched)) / len(part) + 1e-4 * f.weights[touched]
            gw[touched] += g**2
            f.weights[touched] -= rate * g / np.sqrt(gw[touched])
            for value, g, acc in ((f.trans, dt / len(part), gt), (f.start, ds / len(part), gs)):
                acc += g**2
                value -= 0.1 * g / np.sqrt(acc)
    return f


def _turns(p: np.ndarray) -> list[int]:
    """Words of a stretch at which another language begins, from the words' probabilities.

    Viterbi over the languages that have two words' weight or more: a turn must gain more than ``TURN`` nats, of which
    one word gives ``-log(DOUBT)`` at most, so that a name or two make no segment.
    """
    heavy = np.flatnonzero(p.sum(axis=0) >= 2.0)
    if len(heavy) < 2:
        return []
    held, came = [0.0] * len(heavy), []
    for row in np.log(np.maximum(p[:, heavy], DOUBT)).tolist():
        top = max(range(len(held)), key=held.__getitem__)
        turn = held[top] - TURN
        came.append([k if h >= turn else top for k, h in enumerate(held)])
        held = [(h if h >= turn else turn) + x for h, x in zip(held, row, strict=True)]
    at, out = max(range(len(held)), key=held.__getitem__), []
    for k in range(len(came) - 1, 0, -1):
        if came[k][at] != at:
            out.append(k)
            at = came[k][at]
    return out[::-1]


def _cut_at_turns(text: str, whole: list[tuple[int, int]], begins: list[int], p: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a text, cut where the language of their words turns without a mark; ``begins``: of the words."""
    out = []
    for a, b in whole:
        first, end = bisect.bisect_left(begins, a), bisect.bisect_left(begins, b)
        for k in _turns(p[first:end]):
            out.append((a, a + len(text[a : begins[first + k]].rstrip())))
            a = begins[first + k]
        out.append((a, b))
    return out


def read(f: Field, texts: list[str]) -> list[list[tuple[int, int, str | None, float]]]:
    """Of each text its stretches: (from, to, language, confidence), in the tidied text; a stretch without words has no language."""
    tidied = [tidy(t) for t in texts]
    found = [[(m.start(), m[0]) for m in _WORD.finditer(t)] for t in tidied]
    ends = np.cumsum([0, *map(len, found)])
    scores = f.scores([w for ws in found for _, w in ws])
    post = f.posteriors([scores[a:b] for a, b in itertools.pairwise(ends.tolist())])
    flat = np.concatenate(post) if post else np.zeros((0, len(LANGS)))
    turned = np.concatenate([[0], np.cumsum(np.diff(flat.argmax(axis=1), prepend=-1) != 0)])
    spans: list[list[tuple[int, int, int, int]]] = []  # of each text: (from, to, first word, last word) of its stretches
    for i, (t, ws) in enumerate(zip(tidied, found, strict=True)):
        begins, whole = [x for x, _ in ws], stretches(t)
        if ws and turned[ends[i + 1]] > turned[ends[i] + 1]:  # not all words are of one language
            whole = _cut_at_turns(t, whole, begins, post[i])
        k, at, own = 0, int(ends[i]), []
        for a, b in whole:
            first, k = k, bisect.bisect_left(begins, b, k) if b < len(t) else len(begins)
            own.append((a, b, at + first, at + k))
        spans.append(own)
    held = [(a, b) for own in spans for _, _, a, b in own if b > a]
    starts, sizes = np.array([a for a, _ in held], dtype=np.int64), np.array([b - a for a, b in held])
    means = np.add.reduceat(flat, starts, axis=0) / sizes[:, None] if held else flat  # every word lies in a stretch
    langs, sures, at, out = means.argmax(axis=1).tolist(), means.max(axis=1).tolist() if held else [], 0, []
    for own in spans:
        rows, told = [], []
        for a, b, x, y in own:
            if y > x:
                weak = y - x <= 2 and sures[at] < SURE  # a word or two that tell little, say before a cut
                told.append((len(rows), weak, at))
                rows.append((a, b, LANGS[langs[at]], sures[at]))
                at += 1
            else:
                rows.append((a, b, None, 0.0))
        for i, (k, weak, mean) in enumerate(told):
            near = told[i - 1] if i else (told[1] if len(told) > 1 else None)
            if weak and near and not (i == 0 and near[1]):
                a, b, _, _ = rows[k]
                lang = rows[near[0]][2]
                rows[k] = (a, b, lang, float(means[mean][LANGS.index(lang)]))
        out.append(rows)
    return out


def _sample(rows: DataFrame, limit: int, seed: int) -> pd.DataFrame:
    """At most about ``limit`` rows of each declared language, by hash of the text: (code, text)."""
    code = F.create_map(*[F.lit(x) for n, c in _CODE.items() for x in (n, c)])
    named = rows.select(F.try_element_at(code, F.element_at(F.split(F.lower(F.trim("lang")), "[-_]"), 1)).alias("code"), "text").filter("code IS NOT NULL AND text IS NOT NULL")
    counts = {r.code: r.n for r in named.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row per language
    h = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000))
    take = F.lit(False)
    for c, n in counts.items():
        take = take | ((F.col("code") == c) & (h < int(1_000_000 * min(1.0, limit / n))))
    got = named.filter(take).limit(2 * limit * len(LANGS)).toPandas()
    return got.sort_values(["code", "text"]).groupby("code", sort=True).head(limit)


def fit(rows: DataFrame, limit: int = ROWS_PER_LANGUAGE, seed: int = 5) -> Field:
    """Field fitted to a sample of ``rows`` (lang, text), at most ``limit`` texts of each declared language.

    Some labels are wrong and some texts mixed, so each stretch is first given the language under whose labels its
    words are relatively most frequent in the sample; the field learns from these.
    """
    got = _sample(rows, limit, seed)
    number = {c: i for i, c in enumerate(LANGS)}
    texts = [tidy(t) for t in got["text"]]
    parts: list[list[list[str]]] = [[[m[0] for m in _WORD.finditer(t[a:b])] for a, b in stretches(t)] for t in texts]
    labels = [np.full(len(p), number[c]) for p, c in zip(parts, got["code"], strict=True)]
    for _ in range(3):
        labels = _vote(parts, labels)
    return train([([w for ws in p for w in ws], np.repeat(y, [len(ws) for ws in p])) for p, y in zip(parts, labels, strict=True)])


def _vote(parts: list[list[list[str]]], labels: list[np.ndarray]) -> list[np.ndarray]:
    """Language of each stretch under the relative frequencies of its words by the stretches' present languages."""
    vocab: dict[str, int] = {}
    for p in parts:
        for ws in p:
            for w in ws:
                vocab.setdefault(w.lower(), len(vocab))
    n = np.zeros((len(vocab) + 1, len(LANGS)))
    for p, y in zip(parts, labels, strict=True):
        for ws, c in zip(p, y, strict=True):
            for w in set(ws):
                n[vocab[w.lower()], c] += 1
    score = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(vocab) + 1))
    return [np.array([int(score[[vocab[w.lower()] for w in ws]].sum(axis=0).argmax()) if ws else (y[i] if len(y) else 0) for i, ws in enumerate(p)], dtype=int) for p, y in zip(parts, labels, strict=True)]


def segments(values: DataFrame, keys: list[str], text: str, model: Field) -> DataFrame:
    """One row per stretch of one language: the key columns, (part, lang, confidence, n_chars).

    Neighbouring stretches of a language are one segment; stretches without words (numbers, scores) join the segment
    before them. Texts without words, blank and NULL ones give no rows. Whole texts are read.
    """
    shared = values.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", part int, lang string, confidence double, n_chars int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            rows = []
            for key, found in zip(b[keys].itertuples(index=False, name=None), read(f, b["qr_text"].tolist()), strict=True):
                part: list[list] = []
                for x, y, lang, conf in found:
                    if part and (lang is None or part[-1][0] == lang):
                        part[-1][1].append((conf, y - x) if lang else (part[-1][1][-1][0], 0))
                    elif lang:
                        part.append([lang, [(conf, y - x)]])
                for i, (lang, pieces) in enumerate(part):
                    size = sum(n for _, n in pieces)
                    rows.append((*key, i, lang, sum(c * n for c, n in pieces) / max(size, 1), size))
            yield pd.DataFrame(rows, columns=[*keys, "part", "lang", "confidence", "n_chars"])

    return values.select(*keys, F.col(text).alias("qr_text")).filter("qr_text IS NOT NULL AND qr_text <> ''").mapInPandas(run, schema)


def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/articles.parquet")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "description")]))
    return a.select("row_id", F.col("lang").alias("declared"), each.alias("e")).select("row_id", "declared", "e.field", "e.text").filter("text IS NOT NULL")


def article_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = article_fields(spark, sf_dir)
    model = fit(values.select(F.col("declared").alias("lang"), "text"))
    return segments(values, ["row_id", "declared", "field"], "text", model)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the sentences and headlines of each article field that the row's label doesn't name."""
    code = F.create_map(*[F.lit(x) for n, c in _CODE.items() for x in (n, c)])
    said = F.try_element_at(code, F.element_at(F.split(F.lower(F.trim(F.coalesce("declared", F.lit("")))), "[-_]"), 1))
    rows = article_segments(spark, sf_dir)
    return rows.filter(~F.coalesce(said, F.lit("")).eqNullSafe(F.col("lang"))).select("row_id", "field", "lang").distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every title and description with its language and confidence."""
    return article_segments(spark, sf_dir).select("row_id", "field", "part", "lang", "confidence", "n_chars")
