import random

import numpy as np
import pandas as pd

from quillrake.llm import truncation as T


def sentence(rng):
    a = rng.choice(["The mayor", "A striker", "The council", "Our teacher", "A farmer"])
    return f"{a} {rng.choice(['opens', 'rejects', 'praises', 'delays'])} the {rng.choice(['bridge', 'budget', 'stadium', 'harbour'])} {rng.choice(['near', 'in', 'at the port of'])} {rng.choice(['Kanezard', 'Lubonil', 'Fabesk', 'Ratobil'])}"


def corpus(rng, n):
    rows = []
    for _ in range(n):
        rows.append(("s", "description", sentence(rng) + ", as was expected. " + sentence(rng) + "."))
        rows.append(("s", "title", sentence(rng)))
    return rows


def test_held_out_cuts():
    rng = random.Random(1)
    scorer = T.fit(pd.DataFrame(corpus(rng, 1500), columns=["source", "field", "value"]), T.Limits())
    gen = np.random.default_rng(2)
    cuts = [(f, c[0]) for _, f, v in corpus(rng, 300) if (c := T.cut(gen, v))]
    found = np.mean([scorer.score("s", f, v) >= 0.5 for f, v in cuts])
    wrong = np.mean([scorer.score("s", f, v) >= 0.5 for _, f, v in corpus(rng, 300)])
    assert found > 0.85 and wrong < 0.03
    assert scorer.score("s", "description", "The mayor opens the...") > 0.5 and scorer.score("s", "title", "The mayor opens […]") > 0.5


def test_limits_show_as_peaks(spark):
    rng = random.Random(3)
    rows = [("a", "title", "".join(rng.choice("abcdef ") for _ in range(200))[: 60 if k % 2 else rng.randint(20, 59)]) for k in range(800)]
    rows += [("b", "title", "".join(rng.choice("abcdef") for _ in range(rng.randint(20, 90)))) for _ in range(800)]
    rows += [("b", "title", "one story that is told many times")] * 500 + [(None, "title", None)]
    got = T.limits(spark.createDataFrame(rows, "source string, field string, value string"))
    assert list(got.peaks) == [("a", "title")] and got.lengths("a", "title") == [60]


def test_a_limit_tells_unmarked_cuts():
    rng = random.Random(4)
    lim = T.Limits({("cut", "title"): {45: 6.0}})
    scorer = T.fit(pd.DataFrame(corpus(rng, 1500), columns=["source", "field", "value"]), lim)
    v = "The council rejects the harbour at the port of"[:45]
    assert len(v) == 45 and scorer.score("cut", "title", v) > scorer.score("s", "title", v) and scorer.score("cut", "title", v) > 0.5


def test_odd_values(spark):
    rng = random.Random(5)
    scorer = T.fit(pd.DataFrame(corpus(rng, 200), columns=["source", "field", "value"]), T.Limits())
    rows = [(1, None, "title", None), (2, None, "title", " "), (3, "s", "title", "x" * 100_000), (4, "s", "description", "One sentence."), (4, "s", "description", "One sentence.")]
    df = spark.createDataFrame(rows, "row_id long, source string, field string, value string")
    out = T.score(df, scorer, ["row_id"]).collect()
    assert len(out) == 5 and [r.truncated for r in out if r.row_id in (1, 2, 4)] == [False] * 4
    assert T.score(df.limit(0), scorer, ["row_id"]).count() == 0
    empty = T.learn(df.limit(0))
    assert empty.score("s", "title", "abc") == 0.5 and not empty.lim.peaks
