"""Trailing totals by segment trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import rolling

SCHEMA = "project string, day int, tokens long"


def trees(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return rolling.plant(rolling.shards(rolling.daily(df, F.col("project"), F.col("day"), F.col("tokens"))))


def brute(rows, periods=(7, 30)):
    total, n = {}, {}
    for p, d, t in rows:
        if p is not None and d is not None:
            total[p, d] = total.get((p, d), 0) + (t or 0)
            n[p, d] = n.get((p, d), 0) + 1
    out = {}
    for p in {p for p, _ in total}:
        days = [d for q, d in total if q == p]
        for d in range(min(days), max(days) + 1):
            out[p, d] = tuple(x for k in periods for x in (sum(total.get((p, e), 0) for e in range(d - k + 1, d + 1)), sum(n.get((p, e), 0) for e in range(d - k + 1, d + 1))))
    return out


def result(df):
    return {(r.entity, r.day): (r.total_7, r.n_7, r.total_30, r.n_30) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"p{min(rnd.randint(0, 8), 5)}", 20_000 + int(rnd.random() ** 2 * 400), rnd.randint(0, 9)) for _ in range(400)]
    rows += [("idle", 20_000, 5), ("idle", 20_500, 7)]  # several shards without a row
    assert result(rolling.trailing(trees(spark, rows))) == brute(rows)


def test_defined_cases(spark):
    rows = [(None, 20_000, 1), ("a", None, 1), ("a", 20_001, None), ("a", 20_001, 4), ("a", 20_001, 4), ("b", -3, 2)]
    out = {(r.entity, r.day): (r.total_7, r.n_7, r.avg_7) for r in rolling.trailing(trees(spark, rows)).collect()}
    assert out == {("a", 20_001): (8, 3, 8 / 7), ("b", -3): (2, 1, 2 / 7)}
    assert rolling.trailing(trees(spark, [])).count() == 0
    with pytest.raises(ValueError):
        rolling.trailing(trees(spark, []), (0,))


@pytest.mark.parametrize("periods", [(64, 65), (66, 128), (129, 365)])
def test_periods_of_any_length(spark, periods):
    rnd = random.Random(sum(periods))
    rows = [(p, 20_000 + rnd.randint(0, 600), rnd.randint(1, 9)) for p in "ab" for _ in range(60)] + [("gap", 20_010, 3), ("gap", 20_500, 4)]
    got = {(r[0], r[1]): (r[2], r[3], r[5], r[6]) for r in rolling.trailing(trees(spark, rows), periods).collect()}
    assert got == brute(rows, periods)


def test_late_rows_update_trees(spark):
    rnd = random.Random(4)
    rows = [("a", 20_000 + rnd.randint(0, 300), rnd.randint(1, 9)) for _ in range(100)] + [("a", 20_000, 1), ("a", 20_300, 1), ("b", 20_100, 1)]
    late = [("a", 20_063, 5), ("a", 20_064, 6), ("a", 20_150, 7), ("b", 20_100, 2)]
    more = rolling.daily(spark.createDataFrame(late, SCHEMA), F.col("project"), F.col("day"), F.col("tokens"))
    assert result(rolling.trailing(rolling.correct(trees(spark, rows), more))) == brute(rows + late)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_of_any_day(spark, seed):
    """Before, behind and far from the days known so far, in gaps, of new entities, and rows taken back."""
    rnd = random.Random(seed)
    rows = [("one", 20_000, 5), ("gap", 20_000, 1), ("gap", 20_900, 1), ("still", 20_050, 2), ("gone", 20_000, 3)] + [("a", 20_000 + rnd.randint(0, 200), rnd.randint(1, 9)) for _ in range(20)]
    late = [("one", 19_990, 1, 1), ("one", 19_700, 2, 1), ("gap", 20_450, 3, 1), ("new", 21_000, 4, 1), ("new", 20_700, 4, 1), ("gone", 20_000, 3, -1), ("a", 20_264, 7, 1), ("a", 20_500, 7, 1)]
    taken = rnd.sample([r for r in rows if r[0] == "a"], 8)
    late += [(*r, -1) for r in taken] + [("gap", 20_900, 1, -1), (None, 1, 1, 1)]
    rest = list(rows)
    for r in [*taken, ("gap", 20_900, 1), ("gone", 20_000, 3)]:
        rest.remove(r)
    more = rolling.daily(spark.createDataFrame(late, SCHEMA + ", times int"), F.col("project"), F.col("day"), F.col("tokens"), F.col("times"))
    assert result(rolling.trailing(rolling.correct(trees(spark, rows), more))) == brute(rest + [r[:3] for r in late if r[3] > 0])


def test_update_touches_ancestors_only():
    tree = np.zeros((1, 2 * rolling.LEAVES), np.int64)
    rolling.update_trees(tree, np.array([5]), np.array([0]), np.array([3]))
    assert list(np.nonzero(tree[0])[0]) == sorted((rolling.LEAVES + 5) >> i for i in range(8))
    assert rolling.range_sum(tree, 5, 5)[0] == rolling.range_sum(tree, 0, rolling.LEAVES - 1)[0] == 3 and rolling.range_sum(tree, 6, 9)[0] == 0
