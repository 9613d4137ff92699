"""Totals and averages over trailing days, from segment trees per entity and time shard.

A shard is `SHARD` days of one entity. Its tree covers the shard and the one before it, so a
trailing period of up to `SHARD` days is answered by one tree: node 1 is the root, node n has
the children 2n and 2n+1, the leaves are the days. Each node stores the sum and the number of
rows below it. A longer period is the part of the tree where it begins, whole shards, and the part
of the tree where it ends. A late row changes its leaf and the leaf's ancestors, in the tree of its shard
and of the next; where it lies outside the days known so far, the trees in between are planted.

An entity's rows are first summed by day with partial aggregation, so a group that goes to
one task has at most `2 * SHARD` rows, however hot the entity is. Shards in which an entity
was idle get a tree as well: the day before a gap is sent on to every shard of the gap.

Defined cases: null amounts count as 0; rows with a null entity or day are left out; a day
without rows has sum 0 and count 0; an average divides by the days of the period, not by the
active ones; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 64
LEAVES = 2 * SHARD


def build_trees(days: np.ndarray, owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n trees as rows of an array; `days` are leaf numbers, `owner` the tree of each value."""
    trees = np.zeros((n, 2 * LEAVES), np.int64)
    np.add.at(trees, (owner, LEAVES + days), values)
    width = LEAVES
    while width > 1:
        half = width // 2
        trees[:, half:width] = trees[:, width : 2 * width : 2] + trees[:, width + 1 : 2 * width : 2]
        width = half
    return trees


def update_trees(trees: np.ndarray, days: np.ndarray, owner: np.ndarray, deltas: np.ndarray) -> None:
    """Adds late values in place, touching each leaf and its ancestors only."""
    node = LEAVES + days
    while node.size and node[0] >= 1:
        np.add.at(trees, (owner, node), deltas)
        node = node // 2


def range_sum(trees: np.ndarray, first: int, last: int) -> np.ndarray:
    """For every tree the sum of the leaves first..last."""
    total, left, right = np.zeros(len(trees), np.int64), first + LEAVES, last + 1 + LEAVES
    while left < right:
        if left & 1:
            total, left = total + trees[:, left], left + 1
        if right & 1:
            right -= 1
            total = total + trees[:, right]
        left, right = left // 2, right // 2
    return total


def daily(df: DataFrame, entity: Column, day: Column, amount: Column, times: Column | None = None) -> DataFrame:
    """entity, day (number since 1970), total, n. An entity's rows meet only as partial sums.
    times: how often a row counts, -1 for one that is taken back."""
    rows = df.select(entity.alias("entity"), day.cast("int").alias("day"), F.coalesce(amount, F.lit(0)).cast("long").alias("amount"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    return rows.where("entity is not null and day is not null").groupBy("entity", "day").agg(F.sum(F.col("amount") * F.col("times")).alias("total"), F.sum("times").alias("n"))


def _shard(day: Column) -> Column:
    return F.floor(day / SHARD).cast("int")


def shards(days: DataFrame) -> DataFrame:
    """One row for each tree: entity, shard, its first and last active day, leaves."""
    w = Window.partitionBy("entity")
    seen = days.withColumns({"first_day": F.min("day").over(w), "last_day": F.max("day").over(w), "next_day": F.lead("day").over(w.orderBy("day"))})
    upto = F.least(_shard(F.col("last_day")), F.greatest(_shard(F.col("day")) + 1, _shard(F.coalesce("next_day", "day"))))
    sent = seen.withColumn("shard", F.explode(F.sequence(_shard(F.col("day")), upto)))
    return sent.groupBy("entity", "shard").agg(F.first("first_day").alias("first_day"), F.first("last_day").alias("last_day"), F.collect_list(F.struct("day", "total", "n")).alias("leaves"))


def _leaves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, leaf number, total and n of a batch's leaves, those outside its trees left out."""
    shard, leaves = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("leaves")
    flat = leaves.flatten()
    owner = np.repeat(np.arange(len(shard)), leaves.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    day, total, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("day", "total", "n"))
    at = day - (shard[owner] - 1) * SHARD
    near = (at >= 0) & (at < LEAVES)
    return owner[near], at[near], total[near], n[near]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, rows):
            yield whole.slice(begin, rows)


def _matrix(column: pa.Array) -> np.ndarray:
    """The trees of a column; an empty one for null."""
    out = np.zeros((len(column), 2 * LEAVES), np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2 * LEAVES)
    return out


def _column(trees: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(trees) + 1, dtype=np.int32) * (2 * LEAVES)), pa.array(trees.ravel()))


def plant(parts: DataFrame) -> DataFrame:
    """The trees of `shards`, in the form that is stored: entity, shard, first_day, last_day, sums, counts."""
    kind = parts.schema["entity"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            owner, at, total, n = _leaves(batch)
            keep = {k: batch.column(k) for k in ("entity", "shard", "first_day", "last_day")}
            yield pa.RecordBatch.from_pydict(keep | {"sums": _column(build_trees(at, owner, total, batch.num_rows)), "counts": _column(build_trees(at, owner, n, batch.num_rows))})

    return parts.select("entity", "shard", "first_day", "last_day", "leaves").mapInArrow(build, f"entity {kind}, shard int, first_day int, last_day int, sums array<bigint>, counts array<bigint>")


def correct(trees: DataFrame, late: DataFrame) -> DataFrame:
    """Stored trees with the daily sums of late rows (as from `daily`) added. A late day goes to
    the tree of its shard and of the next; there it changes its leaf and the leaf's ancestors.
    Days before, after or between the ones known so far, and new entities, get the trees that they lack; sums
    taken back narrow an entity's days again. Trees of entities without late days pass unchanged."""
    shard, schema = _shard(F.col("day")), trees.schema
    changes = late.withColumn("shard", F.explode(F.array(shard, shard + 1))).groupBy("entity", "shard").agg(F.collect_list(F.struct("day", "total", "n")).alias("leaves"))
    own = trees.join(late.select("entity").distinct(), "entity", "left_semi")
    before = own.groupBy("entity").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    days = late.groupBy("entity").agg(F.min("day").alias("low"), F.max("day").alias("high")).join(before, "entity", "left")
    low, high = F.least("low", "first_day"), F.greatest("high", "last_day")
    every = days.select("entity", F.explode(F.sequence(_shard(low), _shard(high))).alias("shard"))
    # The tree behind the last one begins with that one's days.
    behind = own.where(F.col("shard") == _shard(F.col("last_day"))).select("entity", (F.col("shard") + 1).alias("shard"), F.col("sums").alias("sums_before"), F.col("counts").alias("counts_before"))
    meet = every.join(own.select("entity", "shard", "sums", "counts"), ["entity", "shard"], "left").join(behind, ["entity", "shard"], "left").join(changes, ["entity", "shard"], "left")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            new = ~batch.column("sums").is_valid().to_numpy(zero_copy_only=False)
            owner, at, total, n = _leaves(batch)
            out = {}
            for kind, added in (("sums", total), ("counts", n)):
                whole = _matrix(batch.column(kind))
                if new.any():
                    leaves = np.zeros((new.sum(), LEAVES), np.int64)
                    leaves[:, :SHARD] = _matrix(batch.column(f"{kind}_before"))[new, LEAVES + SHARD :]
                    where = np.nonzero(leaves)
                    whole[new] = build_trees(where[1], where[0], leaves[where], len(leaves))
                update_trees(whole, at, owner, added)
                out[kind] = whole
            active = out["counts"][:, LEAVES + SHARD :] > 0
            first_of_shard = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.int64) * SHARD
            none = ~active.any(1)
            low, high = first_of_shard + active.argmax(1), first_of_shard + SHARD - 1 - active[:, ::-1].argmax(1)
            yield pa.RecordBatch.from_pydict({"entity": batch.column("entity"), "shard": batch.column("shard"), "first_day": pa.array(low, pa.int32(), mask=none), "last_day": pa.array(high, pa.int32(), mask=none), "sums": _column(out["sums"]), "counts": _column(out["counts"])})

    changed = meet.select("entity", "shard", "sums", "counts", "sums_before", "counts_before", "leaves").mapInArrow(change, schema)
    # An entity's days from all its trees; a tree outside of them goes. One row a shard of days.
    w = Window.partitionBy("entity")
    spanned = changed.withColumns({"first_day": F.min("first_day").over(w), "last_day": F.max("last_day").over(w)})
    kept = spanned.where((F.col("shard") >= _shard(F.col("first_day"))) & (F.col("shard") <= _shard(F.col("last_day"))))
    return kept.unionByName(trees.join(late.select("entity").distinct(), "entity", "left_anti"))


def trailing(trees: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, day, and for each period N total_N, n_N and avg_N (total over N days), for every
    day between an entity's first and last, from range queries on the trees of `plant`."""
    if min(periods) < 1:
        raise ValueError("a period has at least one day")
    kind = trees.schema["entity"].dataType.simpleString()
    fields = "".join(f", total_{n} bigint, n_{n} bigint, avg_{n} double" for n in periods)
    # A long period begins in the tree of `back` shards before; the shards in between count whole.
    rows, long = trees, {n: (n - 1) // SHARD for n in periods if n > SHARD}
    for n, back in long.items():
        between = Window.partitionBy("entity").orderBy("shard").rangeBetween(1 - back, -1)
        own_half = lambda c: F.coalesce(F.sum(F.element_at(c, 4)).over(between) if back > 1 else F.lit(0), F.lit(0))  # noqa: B023, E731
        rows = rows.withColumns({f"total_between_{n}": own_half("sums").cast("long"), f"n_between_{n}": own_half("counts").cast("long")})
    for n, back in long.items():
        begins = trees.select("entity", (F.col("shard") + back).alias("shard"), F.col("sums").alias(f"sums_{n}"), F.col("counts").alias(f"counts_{n}"))
        rows = rows.join(begins, ["entity", "shard"], "left")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            whole = {"total": _matrix(batch.column("sums")), "n": _matrix(batch.column("counts"))}
            days = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.int64)[:, None] * SHARD + np.arange(SHARD)
            first, last = (batch.column(k).to_numpy(zero_copy_only=False)[:, None] for k in ("first_day", "last_day"))
            inside = (days >= first) & (days <= last)
            out = {"entity": batch.column("entity").take(pa.array(np.nonzero(inside)[0])), "day": pa.array(days[inside].astype(np.int32))}

            def sums(of: str, n: int) -> np.ndarray:
                if n not in long:
                    return np.stack([range_sum(whole[of], SHARD + i - n + 1, SHARD + i) for i in range(SHARD)], 1)
                begins, rest = _matrix(batch.column(f"{'sums' if of == 'total' else 'counts'}_{n}")), (n - 1) % SHARD
                between = batch.column(f"{of}_between_{n}").to_numpy(zero_copy_only=False)
                return np.stack([range_sum(begins, SHARD + i - rest, LEAVES - 1) + between + range_sum(whole[of], SHARD, SHARD + i) for i in range(SHARD)], 1)

            for n in periods:
                total, count = sums("total", n)[inside], sums("n", n)[inside]
                out |= {f"total_{n}": pa.array(total), f"n_{n}": pa.array(count), f"avg_{n}": pa.array(total / n)}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(answer, f"entity {kind}, day int{fields}")
