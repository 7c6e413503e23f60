import random

from quillrake.llm import seen_keys as S
from quillrake.session import workdir


def run(spark, rows, old, **kw):
    a = S.seen_before(spark.createDataFrame(rows, "row_id long, key string, flag string"), spark.createDataFrame([(k,) for k in old], "key string"), **kw)
    return sorted(r.row_id for r in a.found.collect()), a


def brute(rows, old):
    seen, out = {k for k in old if k is not None}, []
    for i, k, _ in sorted(rows):
        if k is not None:
            if k in seen:
                out.append(i)
            seen.add(k)
    return out


def test_against_brute_force_with_a_filter_in_parts(spark):
    rng = random.Random(4)
    old = [f"o{rng.randint(0, 400)}" for _ in range(500)] + [None]
    rows = [(i, rng.choice(["hot", "hot", None, f"o{rng.randint(0, 800)}", f"n{rng.randint(0, 900)}", ""]), "x") for i in range(3000)]
    rng.shuffle(rows)
    for limit in (S.PART_BYTES, 640):  # 640 bytes: the filter goes round in several parts
        got, a = run(spark, rows, old, part_bytes=limit)
        assert got == brute(rows, old)
        assert a.counts["positives"] == a.counts["found"] + a.counts["first_of_several"] + a.counts["hash_collision"]
        assert a.errors.count() == a.counts["first_of_several"] + a.counts["hash_collision"]


def test_few_collisions_within_the_size(spark):
    _, a = run(spark, [(i, f"k{i}", "") for i in range(20_000)], [f"q{i}" for i in range(20_000)])
    assert a.counts["found"] == 0 and a.error_rate < 0.005


def test_empty_and_long(spark):
    assert run(spark, [], ["a"])[0] == []
    assert run(spark, [(1, "x" * 200_000, ""), (2, "x" * 200_000, ""), (3, None, "")], [])[0] == [2]


def test_a_store_is_extended_and_opens_again(spark):
    rng, root = random.Random(6), workdir(spark, "test-keys")
    seen, number = set(), 0
    for _ in range(10):  # more than eight filters: they are made into one
        rows = [(number + i, f"k{rng.randint(0, 600)}", "") for i in range(120)]
        number += 120
        store = S.KeyStore(spark, root, buckets=4, part_bytes=256)
        df = spark.createDataFrame(rows, "row_id long, key string, flag string")
        assert sorted(r.row_id for r in store.look_up(df).found.collect()) == brute(rows, seen)
        store.add(df)
        seen |= {k for _, k, _ in rows}
    assert len(store.state["filters"]) < 8


def test_the_earlier_keys_are_not_shuffled(spark):
    store = S.KeyStore(spark, workdir(spark, "test-keys"), buckets=4)
    store.add(spark.createDataFrame([(f"k{i}",) for i in range(1000)], "key string"))
    firsts = spark.createDataFrame([(f"k{i}", i, 1) for i in range(900, 1100)], "key string, row_id long, n long")
    missing = S.verified(firsts, store.keys())
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    assert sorted(r.row_id for r in missing.collect()) == list(range(1000, 1100))


def test_a_filter_of_fixed_bits_a_key_errs_as_rarely_with_more_keys(spark):
    rates = []
    for n in (2_000, 40_000):
        old = spark.range(n).selectExpr("concat('q', id) AS key")
        rates.append(S.seen_before(spark.range(n).selectExpr("id AS row_id", "concat('n', id) AS key"), old, part_bytes=8192).error_rate)
    assert max(rates) < 0.006
