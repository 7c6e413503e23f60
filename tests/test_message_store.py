import random

import pytest

from quillrake.operators.message_store import MessageStore
from quillrake.session import exclusive, workdir

SCHEMA = "delivery_id long, source string, message string, period string, body string"


def store(spark):
    return MessageStore(spark, workdir(spark, "test"), ("source", "message"), "delivery_id", "period")


def brute(rows):
    best, free = {}, []
    for r in rows:
        if r[1] is None or r[2] is None:
            free.append(r[0])
        elif (k := r[1:3]) not in best or r[0] < best[k]:
            best[k] = r[0]
    return sorted([*best.values(), *free])


def test_batches_against_brute_force(spark):
    rng = random.Random(3)
    ids = list(range(600))
    rng.shuffle(ids)  # also smaller ids that come later than larger ones
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, "hot", "hot", *(f"m{k}" for k in range(150))]), rng.choice(["2025-01", "2025-02", "2025-03", None]), f"body {i}") for i in ids]
    s = store(spark)
    for k in range(0, 600, 200):
        s.ingest(spark.createDataFrame(rows[k : k + 200], SCHEMA))
    kept = s.messages().collect()
    assert sorted(r.delivery_id for r in kept) == brute(rows)
    assert {r.delivery_id: r.body for r in kept} == {i: f"body {i}" for i in (r.delivery_id for r in kept)}
    lost = sorted(r.delivery_id for r in s.dropped().collect())
    assert lost == sorted(set(ids) - set(brute(rows)))


def test_only_affected_partitions_are_rewritten(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(1, "a", "x", "p1", ""), (2, "a", "y", "p2", ""), (3, "a", "z", "p3", "")], SCHEMA))
    before = {k: list(v) for k, v in s.state["parts"].items()}
    assert s.ingest(spark.createDataFrame([(4, "a", "y", "p4", ""), (5, "a", "new", "p5", "")], SCHEMA)) == ["=p2"]
    after = s.state["parts"]
    assert after["=p1"] == before["=p1"] and after["=p3"] == before["=p3"] and after["=p2"] != before["=p2"]
    assert sorted(r.delivery_id for r in s.messages().collect()) == [1, 2, 3, 5]


def test_a_store_opens_again_and_takes_a_late_winner(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(10, "a", "x", "p1", "late")], SCHEMA))
    again = MessageStore(spark, s.root, s.key, s.order, s.part)
    again.ingest(spark.createDataFrame([(4, "a", "x", "p2", "early")], SCHEMA))
    assert [(r.delivery_id, r.body) for r in again.messages().collect()] == [(4, "early")]
    assert [r.delivery_id for r in again.dropped().collect()] == [10]


def test_empty_batches_and_extra_columns(spark):
    s = store(spark)
    assert s.messages() is None and s.dropped().count() == 0
    s.ingest(spark.createDataFrame([], SCHEMA))
    s.ingest(spark.createDataFrame([(1, "a", "x" * 100_000, "p", "", "k"), (2, "a", "x" * 100_000, "p", "", "k")], SCHEMA + ", key_hash string"))
    s.ingest(spark.createDataFrame([], SCHEMA + ", key_hash string"))
    assert [r.delivery_id for r in s.messages().collect()] == [1]


def test_a_reader_of_the_old_manifest_still_reads(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(10, "a", "x", "p1", "v"), (11, "a", "y", "p1", "v")], SCHEMA))
    reader = MessageStore(spark, s.root, s.key, s.order, s.part)
    s.ingest(spark.createDataFrame([(4, "a", "x", "p1", "w")], SCHEMA))
    assert sorted(r.delivery_id for r in reader.messages().collect()) == [10, 11]
    for k in range(3):  # the replaced files go some batches later
        s.ingest(spark.createDataFrame([(20 + k, "a", f"z{k}", "p9", "")], SCHEMA))
    assert not s.state["retired"] and sorted(r.delivery_id for r in s.messages().collect()) == [4, 11, 20, 21, 22]


def test_a_batch_opens_the_index_buckets_it_needs(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(i, "a", f"m{i}", f"p{i % 3}", "") for i in range(300)], SCHEMA))
    assert len(s.state["index"]) == s.buckets
    opened = []
    s.index_paths = lambda buckets: opened.append(MessageStore.index_paths(s, buckets)) or opened[-1]
    assert s.ingest(spark.createDataFrame([(999, "a", "m7", "p", "")], SCHEMA)) == ["=p1"]
    assert [len(x) for x in opened] == [1]


def test_the_index_is_merged(spark):
    s = store(spark)
    s.index_files = 2
    for k in range(5):
        s.ingest(spark.createDataFrame([(k, "a", "x", f"p{k}", ""), (100 + k, "a", f"y{k}", f"p{k}", "")], SCHEMA))
        assert max(map(len, s.state["index"].values())) <= 2
    assert sorted(r.delivery_id for r in s.messages().collect()) == [0, 100, 101, 102, 103, 104]
    assert sorted(r.delivery_id for r in s.dropped().collect()) == [1, 2, 3, 4]


def test_one_writer_at_a_time(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(1, "a", "x", "p", "")], SCHEMA))
    with exclusive(spark, f"{s.root}/writer.lock"), pytest.raises(RuntimeError, match="another writer"):
        s.ingest(spark.createDataFrame([(2, "a", "y", "p", "")], SCHEMA))
    s.ingest(spark.createDataFrame([(2, "a", "y", "p", "")], SCHEMA))
    assert s.messages().count() == 2
