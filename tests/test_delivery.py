"""Messages delivered more than once."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import delivery

SCHEMA = "seq long, source string, key string, rank int, output long"

def rank():
    return {"source": F.col("source"), "key": F.col("key"), "better": [F.col("rank"), F.col("output")], "row": F.col("seq")}


def seqs(df):
    return sorted(r.seq for r in df.collect())


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(0, "a", "m1", 0, 99), (1, "a", "m1", 1, 5)], [1]),  # finished beats unfinished
        ([(0, "a", "m1", 1, 5), (1, "a", "m1", 1, 50)], [1]),  # then more output
        ([(1, "a", "m1", 1, 5), (0, "a", "m1", 1, 5)], [0]),  # then the smaller number
        ([(0, "a", None, 0, 1), (1, "a", None, 0, 1), (2, "a", " \t", 0, 1)], [0, 1, 2]),  # null and blank never agree
        ([(0, "a", "m1", None, None), (1, "a", "m1", 0, None)], [1]),  # null rank is last
        ([(0, "a", "m1", 1, 1), (1, "b", "m1", 1, 1)], [0, 1]),  # sources apart
        ([(0, "a", "MSG_AB", 1, 1), (1, "a", " claude:v1:msg_ab\n", 1, 1), (2, "a", "Claude:msg_ab​", 1, 1), (3, "a", "fallback:v1:msg_ab", 1, 1)], [0, 3]),  # written in several ways
        ([(0, None, "m1", 1, 1), (1, None, "m1", 1, 1)], [0]),  # null source is a source
        ([], []),
    ],
)
def test_kept_and_surplus(spark, rows, kept):
    df = spark.createDataFrame(rows, SCHEMA)
    assert seqs(delivery.kept(df, **rank())) == kept
    assert seqs(delivery.surplus(df, **rank())) == sorted({r[0] for r in rows} - set(kept))


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(0, "a", "m", 1, 1, "x", "y"), (1, "a", "m", 0, 1, "x", "z")], SCHEMA + ", __key string, __PLACE string")
    out = delivery.kept(df, **rank()).collect()
    assert [(r["__key"], r["__PLACE"]) for r in out] == [("x", "y")]
    assert delivery.surplus(df, **rank()).columns == df.columns


def brute(rows):
    best = {}
    for r in rows:
        if r[2] is not None:
            k = (r[1], r[2])
            if k not in best or (-r[3], -r[4], r[0]) < (-best[k][3], -best[k][4], best[k][0]):
                best[k] = r
    return sorted([r[0] for r in best.values()] + [r[0] for r in rows if r[2] is None])


def test_hot_identifier_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), "hot" if i % 3 == 0 else rnd.choice([None, f"m{rnd.randint(0, 300)}"]), rnd.randint(0, 1), rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert seqs(delivery.kept(df, **rank())) == brute(rows)
    assert seqs(delivery.surplus(df, **rank())) == sorted(set(range(3000)) - set(brute(rows)))


def test_batches_equal_one_pass(spark):
    rnd = random.Random(2)
    rows = [(i, "a", f"m{rnd.randint(0, 40)}", rnd.randint(0, 1), rnd.randint(0, 3)) for i in range(200)]
    rnd.shuffle(rows)
    store = spark.createDataFrame([], SCHEMA)
    for begin in range(0, 200, 70):
        batch = spark.createDataFrame(rows[begin : begin + 70], SCHEMA)
        fresh, better = delivery.accept_batch(store, batch, **rank())
        beaten = {r.key for r in better.collect()}
        merged = [r for r in store.collect() if r.key not in beaten] + fresh.collect() + better.collect()
        store = spark.createDataFrame(merged, SCHEMA)
    assert seqs(store) == brute(rows)


def test_partitioning_does_not_matter(spark):
    rows = [(i, "a", f"m{i % 7}", 1, 1) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert seqs(delivery.kept(df.repartition(1), **rank())) == seqs(delivery.kept(df.repartition(9), **rank())) == list(range(7))
