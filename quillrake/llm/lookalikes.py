"""Visually identical text brought to one form.

Invisible characters go, widths, ligatures and blanks take their plain form, and each word is read as a lattice of all
letters of other scripts that look like its own. Viterbi picks the path that character n-grams, counted over the whole
column, and a cost for each change of script favour. A word's lattice depends on how it looks only, so words that look
the same come out the same.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workdir, written

#: Letters of Latin, Cyrillic and Greek that look the same, one set per word: those of the confusables of
#: Unicode Technical Standard 39 that are of one case and one shape in print (not such as alpha and a, or small capitals).
LOOKALIKES = (
    "aа cсϲ dԁ eе gɡ hһ iі jјϳ lӏ oοо pр qԛ sѕ vνѵ wԝ xх yуү æӕ əәǝ ɵө ʒӡ ɔͻ þϸ "
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜϺ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YΥҮ ZΖ ÆӔ ƏӘ ƐԐ ƟӨ ƷӠ ƆϽ ÞϷ ÐĐƉ ΓГ ΠП ΦФ ΣƩ"
).split()

#: Characters whose compatibility decomposition looks otherwise; they stay as they are.
OTHER_LOOK = "ſϐϑϒϕϖϰϱϲϴϵϹ℀℁℅℆№℡℻"

#: Marks that look like a plain one.
PLAIN_MARKS = {"‐": "-", "‑": "-", "­": "", "͏": "", "ᅟ": "", "ᅠ": "", "ㅤ": "", "ﾠ": "", "ʼ": "’"}

#: Kinds of compatibility decompositions that don't show in print.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_CLASS = {c: group for group in LOOKALIKES for c in group}
_START = "^"

#: Cost (in nats) of a change of script inside a word; gain of the script that a text leans to; letters of an alphabet.
SWITCH, LEAN, ALPHABET = 12.0, 8.0, 100


def _plain_char(ch: str) -> str:
    if ch in PLAIN_MARKS:
        return PLAIN_MARKS[ch]
    kind = unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind in ("Cf", "Cc") or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    form = "" if ch in OTHER_LOOK else unicodedata.decomposition(ch)
    if form.startswith(_SAME_LOOK):
        # Accents that stand alone decompose to a blank and a mark; they stay.
        whole = unicodedata.normalize("NFKC", ch)
        return ch if whole.startswith(" ") and len(whole) > 1 else "".join(_plain_char(c) if c != ch else c for c in whole)
    return ch


class _PlainTable(dict):
    """Table for ``str.translate`` that fills itself."""

    def __missing__(self, code: int) -> str:
        got = self[code] = _plain_char(chr(code))
        return got


PLAIN = _PlainTable()


def plain(text: str) -> str:
    """Without invisible characters, in plain widths and blanks, decomposed; runs of blanks become one, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.translate(PLAIN))
    elif not text.isprintable():
        text = text.translate(PLAIN)
    return " ".join(text.split())


@functools.lru_cache(maxsize=10_000)
def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name in SCRIPTS else ""


@functools.lru_cache(maxsize=10_000)
def _readings(ch: str) -> tuple[tuple[str, str, str], ...]:
    """(letter, script, small letter) of all letters that look like one."""
    return tuple((b, script_of(b), b.lower()) for b in _CLASS.get(ch, ch))


def pair_counts(stretches: Counter) -> Counter:
    """Counts of (script, previous letter, letter), in small letters, in the words of one script."""
    out: Counter = Counter()
    for stretch, n in stretches.items():
        for w in _WORDS.findall(stretch):
            letters = [c for c in w.lower() if not unicodedata.combining(c)]
            scripts = {script_of(c) for c in letters}
            if len(scripts) == 1 and (s := scripts.pop()):
                for a, b in zip([_START, *letters], letters, strict=False):
                    out[s, a, b] += n
    return out


class Reader:
    """Reads words under pair counts {(script, a, b): n} of small letters."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.pairs = dict(counts)
        self.before: Counter = Counter()
        self.single: Counter = Counter()
        self.whole: Counter = Counter()
        for (s, a, b), n in counts.items():
            self.before[s, a] += n
            self.single[s, b] += n
            self.whole[s] += n
        total = sum(self.whole.values())
        self.prior = {s: math.log((self.whole[s] + 1) / (total + len(SCRIPTS))) for s in SCRIPTS}
        self.known: dict[str, dict[str, str]] = {}
        self.scored: dict[tuple[str, str, str], float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scored": {}}

    def pair(self, s: str, a: str, b: str) -> float:
        """log P(b | a) within script s, backed off to the letter alone."""
        got = self.scored.get((s, a, b))
        if got is None:
            alone = (self.single[s, b] + 0.5) / (self.whole[s] + 0.5 * ALPHABET)
            got = self.scored[s, a, b] = math.log((self.pairs.get((s, a, b), 0) + 2.0 * alone) / (self.before[s, a] + 2.0))
        return got

    def word(self, w: str, lean: str) -> str:
        """A stretch without blanks, its words read and all else as it is."""
        got = _WORDS.sub(lambda m: self._read(m[0], lean), w)
        known = self.known[lean]
        if len(known) > 500_000:  # a cache only: what it forgets is read again
            known.clear()
        known[w] = got
        return got

    def _read(self, w: str, lean: str) -> str:
        """Viterbi over letters; the lattice of a letter is its set of look-alikes in a fixed order."""
        if not any(c in _CLASS for c in w):
            return w
        pair, known = self.pair, self.scored
        begin = {s: self.prior[s] + (LEAN if s == lean else 0.0) for s in SCRIPTS}
        paths: list[tuple[float, str, str, str]] | None = None  # score, path, script and small form of its last letter
        for c in w:
            if unicodedata.combining(c):
                paths = [(v, p + c, s, a) for v, p, s, a in paths] if paths else [(0.0, c, "", c)]
                continue
            new = []
            for b, s, small in _readings(c):
                if paths is None:
                    new.append(((begin[s] + pair(s, _START, small)) if s else 0.0, b, s, small))
                    continue
                top, at = -math.inf, ""
                turn = begin[s] - SWITCH + pair(s, _START, small) if s else 0.0
                for v, p, t, a in paths:
                    if t == s and s:
                        got = known.get((s, a, small))
                        v += pair(s, a, small) if got is None else got
                    else:
                        v += turn
                    if v > top:
                        top, at = v, p
                new.append((top, at + b, s, small))
            paths = new
        return max(paths, key=lambda x: x[:2])[1] if paths else ""

    def text(self, text: str) -> str:
        """The one form of a text: of all texts that look like it.

        Words that any script could have written lean to the script of the letters that have no look-alike.
        """
        t = plain(text)
        lean = "CYRILLIC" if not t.isascii() and len(_CYRILLIC_ONLY.findall(t)) > len(_LATIN_ONLY.findall(t)) else "LATIN"
        known = self.known.setdefault(lean, {})
        return unicodedata.normalize("NFC", " ".join([known.get(w) or self.word(w, lean) for w in t.split(" ")]))


_RANGES = {"LATIN": (0x41, 0x250), "CYRILLIC": (0x400, 0x530), "GREEK": (0x370, 0x400)}
_ONLY = {s: re.compile("[" + "".join(c for c in map(chr, range(*r)) if c.isalpha() and c not in _CLASS) + "]") for s, r in _RANGES.items()}
_LATIN_ONLY, _CYRILLIC_ONLY = _ONLY["LATIN"], _ONLY["CYRILLIC"]
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def article_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, field, value) of the articles' titles and descriptions that aren't NULL."""
    a = spark.read.parquet(f"{sf_dir}/articles.parquet")
    each = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("description").alias("field"), F.col("description").alias("value"))))
    return a.select("row_id", each.alias("e")).select("row_id", "e.field", "e.value").filter("value IS NOT NULL")


def learn(values: DataFrame) -> Reader:
    """Reader with pair counts over all values; pairs of letters are bounded by the alphabets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        words: Counter = Counter()  # stretches without blanks
        for b in batches:
            for v in b["value"]:
                words.update(plain(v).split(" "))
            if len(words) > 200_000:
                out.update(pair_counts(words))
                words.clear()
        out.update(pair_counts(words))
        yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["s", "a", "b", "n"])

    rows = values.select("value").filter("value IS NOT NULL").mapInPandas(count, "s string, a string, b string, n long").groupBy("s", "a", "b").agg(F.sum("n").alias("n")).toPandas()
    return Reader({(s, a, b): int(n) for s, a, b, n in rows.itertuples(index=False)})


def canonical(values: DataFrame, reader: Reader | None = None) -> DataFrame:
    """``values`` (with ``value string``) and ``form string``: equal for values that look the same in print.

    NULL stays NULL; values of blanks and invisible characters only become ''. Every row comes out once. Whole texts
    are read, however long.
    """
    reader = reader or learn(values)
    shared = values.sparkSession.sparkContext.broadcast(reader)  # pairs of letters of three alphabets

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = shared.value
        for b in batches:
            yield b.map(lambda v: None if v is None else r.text(v))

    return values.withColumn("form", F.pandas_udf(run, "string")(F.col("value")))


def classes(values: DataFrame) -> DataFrame:
    """(row_id, field, class_id, variant): rows whose values look the same share a class, equal strings a variant.

    Ids are 128-bit hashes. Blank values have no class and don't come out.
    """
    c = canonical(values).filter("form <> ''")
    return c.select("row_id", "field", F.md5("form").alias("class_id"), F.md5("value").alias("variant"))


def pairs(values: DataFrame, slice_rows: int = 2000) -> DataFrame:
    """(field, row_id_1, row_id_2), row_id_1 < row_id_2: rows whose values look the same but are other strings.

    All such pairs come out. Variants of a class are paired first and their rows after, so no two copies of one string
    ever meet and the work is in proportion to the result. Rows of a large variant, and variants of a large class, are
    cut into slices on one side and repeated on the other, so that no task joins a whole one.
    """
    spark = values.sparkSession
    c = written(classes(values), workdir(spark, "lookalikes"))
    # Copies collapse in the map-side half of the first aggregate.
    variants = c.groupBy("field", "class_id", "variant").agg(F.count("*").alias("n"))
    size = variants.groupBy("field", "class_id").agg(F.count("*").alias("size")).filter("size > 1")
    several = written(variants.join(size, ["field", "class_id"]), workdir(spark, "variants"))
    slices = lambda n: F.ceil(F.col(n) / slice_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), slices(n) - 1))
    left = several.select("field", "class_id", F.col("variant").alias("v1"), F.col("n").alias("n1"), F.pmod(F.xxhash64("variant"), slices("size")).alias("slice"))
    right = several.select("field", "class_id", F.col("variant").alias("v2"), F.col("n").alias("n2"), every("size").alias("slice"))
    both = left.join(right, ["field", "class_id", "slice"]).filter("v1 < v2").select("field", "v1", "n1", "v2", "n2")
    rows = c.join(several.select("field", "variant", "n"), ["field", "variant"])
    rows = written(rows.select("field", "variant", "row_id", F.pmod(F.xxhash64("row_id"), slices("n")).alias("slice")), workdir(spark, "variant-rows"))
    named = lambda k: rows.select("field", F.col("variant").alias(f"v{k}"), F.col("row_id").alias(f"r{k}"), "slice")
    first = both.select("*", every("n1").alias("slice")).join(named(1), ["field", "v1", "slice"]).drop("slice", "v1", "n1")
    out = first.select("*", every("n2").alias("slice")).join(named(2), ["field", "v2", "slice"])
    return out.select("field", F.least("r1", "r2").alias("row_id_1"), F.greatest("r1", "r2").alias("row_id_2"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of article rows whose values of a field look the same in print but differ as strings."""
    return pairs(article_values(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every title and description."""
    return canonical(article_values(spark, sf_dir)).select("row_id", "field", "form")
