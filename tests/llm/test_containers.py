import random

import pytest

from quillrake.llm import containers as C
from quillrake.llm.tokens import told_apart


def brute(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
        if at is None:
            room.append(capacity)
            at = len(room) - 1
        room[at] -= sizes[k]
        out[k] = at
    return out


def test_tree_is_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        cap = rng.choice([1, 7, 50])
        sizes = [rng.randint(0, cap) for _ in range(rng.randint(0, 40))]
        assert C.first_fit_decreasing(sizes, cap) == brute(sizes, cap)


def check(rows, items, cap):
    left = {}
    for r in rows:
        left.setdefault((r.spec, r.grp, r.container), []).append(r.token_to - r.token_from)
    assert all(sum(x) <= cap for x in left.values())
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
    return left, spans


def test_pack_whole_items_and_splits(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 1, 5, 60, 99, 100, 101, 350])) for i in range(500)]
    rows = C.pack(spark.createDataFrame(items, "doc_id long, n_tokens long"), [("s", 100)], group_tokens=4000).collect()
    left, spans = check(rows, items, 100)
    assert len({g for _, g, _ in left}) > 1
    for i, n in items:
        got = sorted(spans[i])
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
        assert n > 100 or len(got) == 1
    assert sum(map(sum, left.values())) / (100 * len(left)) > 0.95


def test_odd_items(spark):
    df = spark.createDataFrame([(None, 5, "x"), (1, None, "y"), (1, 3, "z"), (1, 3, "z"), (2, 10, "w")], "doc_id long, n_tokens long, spec string")
    rows = C.pack(df, [("a", 10), ("b", 4)]).collect()
    assert len([r for r in rows if r.spec == "a"]) == 5
    assert sum(r.token_to - r.token_from for r in rows if r.spec == "b") == 21
    assert C.pack(df.limit(0), [("a", 10)]).count() == 0 and C.pack(df, []).count() == 0
    with pytest.raises(ValueError):
        C.pack(df, [("a", 0)])


def test_repeated_id_spreads_over_groups(spark):
    df = spark.range(3000).selectExpr("CAST(7 AS long) AS doc_id", "CAST(10 AS long) AS n_tokens")
    rows = C.pack(df, [("a", 100)], group_tokens=3000).groupBy("grp").count().collect()
    assert len(rows) == 10 and max(r["count"] for r in rows) < 600


def test_the_seed_fixes_the_result_whatever_the_layout(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randint(0, 300), rng.randint(0, 150)) for _ in range(900)], "doc_id long, n_tokens long")
    got = [sorted(tuple(r) for r in C.pack(x, [("s", 100)], group_tokens=9000).collect()) for x in (df, df.repartition(7, "n_tokens"), df.orderBy("n_tokens").coalesce(1))]
    assert got[0] == got[1] == got[2] and len({r[1] for r in got[0]}) > 3


def test_equal_rows_are_told_apart(spark):
    df = spark.createDataFrame([(1, None)] * 25 + [(2, 5)] * 3 + [(None, 1)], "doc_id long, n_tokens long")
    got = sorted((r.doc_id or 0, r.copy) for r in told_apart(df, step=10).collect())
    assert got == [(0, 0), *((1, k) for k in range(25)), (2, 0), (2, 1), (2, 2)]
