import random

from pyspark.sql import functions as F

from quillrake.llm import mixture as M


def brute(weights, caps, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        out[max(open_, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_apportionment_against_quotients():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        w, caps = [rng.choice([0.0, 0.1, 0.25, 1.0, rng.random()]) for _ in range(n)], [rng.choice([0, 3, 50, 1000]) for _ in range(n)]
        seats = rng.choice([0, 1, 5, 100, 333])
        assert M.sainte_lague(w, caps, seats) == brute(w, caps, seats)


def test_blocks_hold_equal_tokens():
    rng = random.Random(2)
    for _ in range(200):
        sizes, width = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))], rng.randint(1, 30)
        pieces = M.cut_blocks(sizes, width)
        held = {}
        for _, b, x, y in pieces:
            held[b] = held.get(b, 0) + y - x
        assert set(held.values()) <= {width} and len(held) == sum(sizes) // width
        tokens = [(k, t) for k, _, x, y in pieces for t in range(x, y)]
        assert tokens == [(k, t) for k, n in enumerate(sizes) for t in range(n)][: len(held) * width]


def test_draw():
    assert M.draw(0, 5, "k") == [] and M.draw(3, 0, "k") == [0, 0, 0] and M.draw(3, 6, "k") == [2, 2, 2]
    assert sorted(M.draw(5, 7, "k")) == [1, 1, 1, 2, 2] and M.draw(5, 7, "k") == M.draw(5, 7, "k")
    assert len({tuple(M.draw(5, 2, f"k{i}")) for i in range(30)}) > 3


def docs(spark, seed=1, n=4000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "tiny", "other", None]), rng.randint(0, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), rows


def test_shares_and_caps(spark):
    df, rows = docs(spark)
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 4), ("gone", 0.05, 3)]
    mix, shares = M.mix(df, targets, block_tokens=100, shard_tokens=30_000)
    s = {r.source: r for r in shares.collect()}
    for k, want in (("big", 0.5 / 0.95), ("mid", 0.3 / 0.95), ("tiny", 0.15 / 0.95)):
        assert abs(s[k].actual_share - want) < 0.01
    assert s["gone"].tokens == 0 and s["gone"].capped
    used = mix.collect()
    limit = {k: r for k, _, r in targets}
    assert all(1 <= r.uses <= limit[r.source] for r in used)
    size = {i: n for i, _, n in rows}
    assert all(0 <= r.token_from < r.token_to <= size[r.doc_id] and r.n_tokens == r.token_to - r.token_from for r in used)
    assert sum(r.n_tokens * r.uses for r in used) == sum(r.tokens for r in s.values())
    assert all(r.tokens % 100 == 0 for r in s.values())
    spans = {}
    for r in used:
        spans.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
    assert all(a[1] <= b[0] for x in spans.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    assert len({(r.source, r.shard) for r in used if r.source == "big"}) > 3


def test_too_large_total_fills_up_to_the_caps(spark):
    df, rows = docs(spark)
    total = sum(n for _, s, n in rows if s in ("big", "mid", "tiny"))
    _, shares = M.mix(df, [("big", 0.1, 1), ("mid", 0.6, 2), ("tiny", 0.3, 2)], total_tokens=total)
    s = {r.source: r for r in shares.collect()}
    assert s["mid"].capped and s["tiny"].capped and not s["big"].capped
    have = {k: sum(n for _, x, n in rows if x == k) for k in ("mid", "tiny")}
    assert all(have[k] * 2 - 2 * M.BLOCK_TOKENS <= s[k].tokens <= have[k] * 2 for k in have)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a", 10, 1), (1, "a", 10, 1), (1, "a", 10, 1), (2, "a", None, 1)], "doc_id long, source string, n_tokens long, shard int")
    mix, shares = M.mix(df, [("a", 1.0, 3)], block_tokens=5)
    assert sum(r.n_tokens * r.uses for r in mix.collect()) == 90 and shares.first().actual_share == 1.0
    mix, shares = M.mix(df.limit(0), [("a", 1.0, 3), ("b", None, None)])
    assert mix.count() == 0 and {r.tokens for r in shares.collect()} == {0}
    assert M.mix(df, [])[0].count() == 0


def test_the_seed_fixes_the_result_whatever_the_layout(spark):
    df, _ = docs(spark, n=800)
    df = df.unionByName(df.limit(40))  # some repeated rows
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4)]
    results = []
    for layout in (df, df.repartition(7, "n_tokens"), df.orderBy(F.desc("doc_id")).coalesce(1)):
        results.append(sorted(tuple(r) for r in M.mix(layout, targets, block_tokens=100, shard_tokens=20_000)[0].collect()))
    assert results[0] == results[1] == results[2] and results[0]
