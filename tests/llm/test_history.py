"""New batches against all history, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import history, queries

EVENTS = "row_id long, bundle_id long, id string, session string, ts long, input_tokens long, output_tokens long, cache_read long, cache_write_5m long, cache_write_1h long, extra string"
BUNDLES = "bundle_id long, device_id string"
DEVICES = "device_id string, host string"


def brute(rows, machine):
    key = lambda i: (i or "").strip().lower().removeprefix("claude:v1:")
    top = {r[0]: r[0] for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            same = key(a[2]) and key(a[2]) == key(b[2])
            near = machine[a[1]] is not None and machine[a[1]] == machine[b[1]] and a[3] is not None and a[3] == b[3] and abs((a[4] or 0) - (b[4] or 0)) <= 120
            near = near and all(abs((x or 0) - (y or 0)) * 50 <= max(x or 0, y or 0) for x, y in zip(a[5:10], b[5:10]))
            if same or near:
                x, y = find(a[0]), find(b[0])
                top[max(x, y)] = min(x, y)
    return {r[0]: find(r[0]) for r in rows if find(r[0]) != r[0]}


def prepared(spark, rows):
    bundles = spark.createDataFrame([(0, "d0"), (1, "d1"), (2, "d2"), (3, "d3")], BUNDLES)
    devices = spark.createDataFrame([("d0", "anvil-1"), ("d1", "op@ANVIL-1.lab.example:22"), ("d2", None), ("d3", None)], DEVICES)
    return history.prepared(spark.createDataFrame(rows, EVENTS), bundles, devices)


MACHINE = {0: "anvil", 1: "anvil", 2: "d2", 3: "d3"}


def make(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base = rnd.choice([0, 7, 100, 5000])
        counts = [max(0, int(base * rnd.choice([1, 1, 1.005, 1.015, 1.03]))) for _ in range(5)]
        rows.append((i, rnd.randint(0, 3), rnd.choice([None, " ", f"m{rnd.randint(0, n)}", f"claude:v1:M{rnd.randint(0, n)} "]), rnd.choice(["", "main", "s1", "s2", None]), 1_700_000_000 + rnd.randint(0, 3000), *counts, "x"))
    return rows


def test_against_brute_force(spark):
    rows = make(1, 300)
    assert {r.row_id_b: r.row_id_a for r in history.repeats(prepared(spark, rows)).collect()} == brute(rows, MACHINE)


def test_hot_group_and_defined_cases(spark):
    hot = [(i, 0, None, "main", 1_700_000_000 + i % 5, 1000 + i % 7, 50, 0, 0, 0, None) for i in range(200)]
    other = [(200, 2, None, None, None, None, 1, 1, 1, 1, None), (201, 2, None, None, None, None, 1, 1, 1, 1, None), (202, 3, "x", "", None, None, 1, 1, 1, 1, None), (203, 3, "y", "", 0, 0, 1, 1, 1, 1, None)]
    got = {r.row_id_b: r.row_id_a for r in history.repeats(prepared(spark, hot + other)).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, 203: 202}
    assert history.repeats(prepared(spark, [])).count() == 0


def test_batch_by_batch(spark, tmp_path):
    rows = [(0, 0, "m1", "s", 1000, 100, 1, 1, 1, 1, ""), (1, 0, "m2", "s", 9000, 100, 1, 1, 1, 1, ""), (2, 1, "M1", "t", 5, 1, 1, 1, 1, 1, ""), (3, 1, "m3", "s", 9060, 101, 1, 1, 1, 1, ""), (4, 1, "m4", "s", 90_000, 1, 1, 1, 1, 1, ""), (5, 1, "m4 ", "u", 1, 1, 1, 1, 1, 1, "")]
    store = history.History(spark, str(tmp_path / "store"))
    found = {}
    for bundle in (0, 1):
        batch = prepared(spark, rows).where(F.col("bundle_id") == bundle)
        repeated = store.check(batch)
        found |= {r.row_id_b: r.row_id_a for r in repeated.collect()}
        store.append(batch, repeated)
    assert found == {2: 0, 3: 1, 5: 4} == brute(rows, MACHINE)


def in_batches(spark, folder, *batches):
    store = history.History(spark, str(folder))
    for rows in batches:
        store.accept(prepared(spark, rows))
    return {r.row_id_b: r.row_id_a for r in store.repeated().collect()}


def test_chain_through_rejected_rows(spark, tmp_path):
    at = lambda i, ts, id=None: (i, i % 2, id, "s", ts, 100, 1, 1, 1, 1, "")
    # 1 repeats 0 and is rejected; 2 and 3 repeat only 1, by time and by identifier.
    chain = [at(0, 1000), at(1, 1100, "m1"), at(2, 1200), at(3, 90_000, "M1")]
    assert in_batches(spark, tmp_path / "chain", chain[:1], chain[1:2], chain[2:]) == {1: 0, 2: 0, 3: 0} == brute(chain, MACHINE)
    # 2 joins 1 to 0, and 4 joins 3 to them all.
    apart = [at(0, 1000), at(1, 1220), at(2, 1110), at(3, 1450), at(4, 1330)]
    assert in_batches(spark, tmp_path / "apart", apart[:2], apart[2:4], apart[4:]) == {1: 0, 2: 0, 3: 0, 4: 0} == brute(apart, MACHINE)
    assert in_batches(spark, tmp_path / "late", apart[3:], apart[1:2], apart[:1] + apart[2:3]) == {1: 0, 2: 0, 3: 0, 4: 0}


def test_random_batches_against_brute_force(spark, tmp_path):
    rows = make(2, 200)
    assert in_batches(spark, tmp_path / "store", rows[:70], rows[70:140], [], rows[140:]) == brute(rows, MACHINE)


def test_query_goes_through_the_history(spark, tmp_path, monkeypatch):
    rows = [(i, i // 5, None, "main", 1_700_000_000 + 100 * i, 100, 1, 1, 1, 1, "") for i in range(20)]
    folder, sizes = tmp_path / "tables", []
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/bundle_event.parquet")
    spark.createDataFrame([(b, "d0") for b in range(4)], BUNDLES).write.parquet(f"{folder}/usage_bundle.parquet")
    spark.createDataFrame([("d0", "anvil-1")], DEVICES).write.parquet(f"{folder}/device_record.parquet")
    check = history.History.check
    monkeypatch.setattr(history.History, "check", lambda self, batch, old=None: sizes.append(batch.count()) or check(self, batch, old))
    assert {r.row_id_b: r.row_id_a for r in queries.p7_found(spark, str(folder)).collect()} == {i: 0 for i in range(1, 20)}
    assert len(sizes) > 1 and sum(sizes) == 20


def test_crowded_blocks_are_divided():
    """Against all pairs: few parts, many parts, and parts too narrow to be halved."""
    rnd = np.random.default_rng(3)
    for spread, wide in ((0.03, 60), (0.3, 2000), (3.0, 4000)):
        n = 400
        ts = rnd.integers(0, wide, n) + 1_700_000_000
        counts = np.floor(np.exp(rnd.uniform(5, 5 + spread, (n, 5)))).astype(np.int64)
        counts[rnd.random((n, 5)) < 0.2] = 0
        i, j = np.triu_indices(n, 1)
        found = history._agree(ts, counts, i, j)
        true = brute_classes(n, zip(i[found], j[found]))
        for most in (8, 64, 1_000):
            assert brute_classes(n, zip(*history.near_links(np.zeros(n, np.int64), ts, counts, most))) == true


def brute_classes(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_blocks_that_span_batches_of_arrow(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, 0, None, f"s{i % 3}", 1_700_000_000 + 70 * (i // 3), 1000, 50, 0, 0, 0, None) for i in range(60)]
        assert {r.row_id_b: r.row_id_a for r in history.repeats(prepared(spark, rows)).collect()} == {i: i % 3 for i in range(3, 60)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_buckets_stay_with_the_folder(spark, tmp_path):
    rows = make(4, 60)
    store = history.History(spark, str(tmp_path / "store"), 3)
    store.accept(prepared(spark, rows[:30]))
    spark.sql(f"drop table {store.table}")
    again = history.History(spark, str(tmp_path / "store"), 5)
    assert again.buckets == 3
    again.accept(prepared(spark, rows[30:]))
    assert {r.row_id_b: r.row_id_a for r in again.repeated().collect()} == brute(rows, MACHINE)
