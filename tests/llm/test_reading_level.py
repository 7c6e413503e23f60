import random

import numpy as np

from quillrake.llm import reading_level as R

WORDS = {g: [f"{p}{c}{s}" for c in "bdfgk" for s in ("ab", "or", "in")] for g, p in zip(range(1, 6), ("ga", "lim", "prest", "conval", "xenothr"), strict=True)}
COMMON = ["the", "of", "and", "to", "in", "was"]


def text(rng, grade, n=120):
    out = []
    for _ in range(n):
        g = min(5, max(1, grade + rng.choice([0, 0, 0, 0, 1, -1])))
        out.append(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS[g]))
    return " ".join(out)


def test_levels_follow_the_grades(spark):
    rng = random.Random(1)
    graded = [(g, text(rng, g)) for g in range(1, 6) for _ in range(12)]
    docs, truth = [], {}
    for i in range(400):
        g = rng.randint(1, 5)
        truth[i] = g
        docs.append((i, rng.choice(["en", "en", "en", None]), text(rng, g, rng.choice([40, 200])), "x"))
    docs += [(900, "de", " ".join(rng.choice(["der", "haus", "und", "nicht"]) for _ in range(80)), "x") for _ in range(30)]
    docs += [(901, "en", None, "x"), (902, "en", "", "x"), (903, "en", "12 34 !!", "x"), (904, "en", text(rng, 5, 30_000), "x")]
    out, model = R.levels(spark.createDataFrame(docs, "doc_id long, lang string, text string, level string"), spark.createDataFrame(graded, "grade int, text string"))
    rows = out.collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    assert np.corrcoef([got[i].level for i in truth], list(truth.values()))[0, 1] > 0.9
    assert np.mean([got[i].demanding == (g >= 4) for i, g in truth.items()]) > 0.97
    assert got[901].level is None and not got[901].demanding and not got[902].demanding and not got[903].demanding
    assert not got[900].demanding and got[900].english_share < 0.5 and got[904].demanding
    assert 2.0 < model.cut < 5.0


def test_word_fit_recovers_slopes():
    rng = np.random.default_rng(1)
    slope, rate = rng.uniform(-1, 1, 300), np.log(rng.uniform(1e-3, 1e-2, 300))
    tokens = np.full(len(R.BINS), 200_000.0)
    counts = rng.poisson(np.exp(rate[:, None] + slope[:, None] * (R.BINS - 3)) * tokens)
    got, base = R.fit_words(counts.astype(float), tokens)
    assert np.abs(got - slope).max() < 0.1 and np.abs(base - rate).max() < 0.1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    graded = spark.createDataFrame([], "grade int, text string")
    assert R.levels(docs, graded)[0].count() == 0
    some = spark.createDataFrame([(1, "en", "a b c")], "doc_id long, lang string, text string")
    assert R.levels(some, graded)[0].count() == 1


def test_markup_and_case():
    assert R.buckets_of("<p>Ab &amp; ab</p>", {})[1] == [2]
