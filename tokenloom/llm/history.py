"""Deduplicating new batches against all history.

Every event has a content hash (its identifier, however written) and block hashes for finding
near copies: machine, session, a cell of time and a cell of its tokens. Hashes are stored in a
bucketed table, an identifier or a content once, each with what is compared. A new batch asks for
the cells of its contents and for the neighbouring ones within reach; it is semi-joined to the
table bucket by bucket, without moving what is stored, and compared with the stored events of
these cells. Then its new hashes are appended. Repeats are stored too, under the root of their
group, so that later events find it through them.

Two events repeat each other if their identifiers agree, or if machine and session are the same,
their times lie at most `SECONDS` apart and every token class agrees within `SHARE` of the larger.

A group of copies may hold a third of all rows. Copies of one identifier and events equal in
content are linked to the smallest of their group, in salted parts; only distinct contents are
compared. They are sorted by block and time, and each is compared with those after it in reach
that are not linked to it yet (`near_links`); what leaves a task is a tree of each group, not its
pairs. A crowded block is first halved along its widest measure, with an overlap as wide as the
reach, until its parts are small, and a part that can't be halved is so narrow that it falls into
a few cells in which all repeat each other. One block, `SECONDS_OF_CELL` of one session with totals within
25 percent, is read by one task.

Defined cases: a null or blank identifier equals no other; a null session or machine has no near
copies; a blank session is a session; null tokens and times count as 0; repeated rows and ties go
to the smallest row number; an empty batch or history gives an empty result.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import blank_to_null, message_key
from tokenloom.operators.graph import checkpointed, components, scratch, stars
from tokenloom.sources.tables import TOKENS

SECONDS, SHARE = 120, 0.02
#: Natural logarithm of the ratio of two counts that agree within SHARE, a little more.
STEP = 0.0203
#: Widths of a block's cells of time and of the logarithm of the total.
SECONDS_OF_CELL, WIDTH = 5 * SECONDS, 11 * STEP
#: Batches in which a whole table is given to the history.
BATCHES = 3
CONTENT = ["machine", "session", "ts", *TOKENS]


def machine(host: Column, device: Column) -> Column:
    """A machine by its host, without scheme, user, port, domain and case; by the device's id where the host is null."""
    h = F.regexp_replace(F.lower(blank_to_null(host)), r"^[a-z]+://|^[^@]*@|[:/].*$", "")
    h = F.regexp_replace(F.regexp_replace(h, r"^[^@]*@", ""), r"[:/].*$|\.+$", "")
    h = F.when(h.rlike(r"^\d+(\.\d+){3}$"), h).otherwise(F.regexp_replace(h, r"\..*$", ""))
    return F.coalesce(F.concat(F.lit("host "), h), F.concat(F.lit("device "), device))


def prepared(events: DataFrame, bundles: DataFrame, devices: DataFrame) -> DataFrame:
    """row_id, bundle_id, id_key, machine, session, ts and the five counts of each event."""
    of_device = devices.select("device_id", "host").dropDuplicates(["device_id"])
    of_bundle = bundles.select("bundle_id", "device_id").dropDuplicates(["bundle_id"]).join(of_device, "device_id", "left").select("bundle_id", machine(F.col("host"), F.col("device_id")).alias("machine"))
    counts = [F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in TOKENS]
    return events.select("row_id", "bundle_id", message_key(F.col("id")).alias("id_key"), "session", F.coalesce("ts", F.lit(0)).alias("ts"), *counts).join(of_bundle, "bundle_id", "left")


def block_hashes(rows: DataFrame, reach: tuple[int, ...]) -> DataFrame:
    """`rows` with a block hash as `h` for each cell of time and total that an event touches, when
    moved by the given multiples of the reach. With (0,) that is its own cell; two events that
    repeat each other have a cell of (0, -1) in common, and the cell of either is among (-1, 0, 1)
    of the other."""
    total = sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))
    log = F.log(F.greatest(total, F.lit(1)).cast("double"))
    times = F.array_distinct(F.array(*(F.floor((F.col("ts") + k * SECONDS) / SECONDS_OF_CELL) for k in reach)))
    # Nothing has a cell of its own.
    totals = F.array_distinct(F.array(*(F.when(total <= 0, F.lit(-1_000)).otherwise(F.floor((log + k * STEP) / WIDTH)) for k in reach)))
    cells = rows.where("machine is not null and session is not null").withColumn("__t", F.explode(times)).withColumn("__c", F.explode(totals))
    return cells.withColumn("h", F.xxhash64("machine", "session", "__t", "__c")).drop("__t", "__c")


def _union(to: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b, pair by pair, in place; `to` points every position to the first of its class."""
    while True:
        x, y = to[a], to[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := to[to], to):
            to[:] = further


def _agree(ts: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = counts[i], counts[j]
    return (np.abs(ts[i] - ts[j]) <= SECONDS) & (np.abs(a - b) * 100 <= np.maximum(a, b) * int(SHARE * 100)).all(1)


def _sweep(rows: np.ndarray, block: np.ndarray, ts: np.ndarray, counts: np.ndarray, to: np.ndarray) -> None:
    """Compares each of `rows`, ordered by block and time, with those after it within reach."""
    for k in range(1, len(rows)):
        i, j = rows[:-k], rows[k:]
        near = (block[i] == block[j]) & (ts[j] - ts[i] <= SECONDS)
        if not near.any():
            return
        apart = near & (to[i] != to[j])
        i, j = i[apart], j[apart]
        found = _agree(ts, counts, i, j)
        _union(to, i[found], j[found])


def _divide(rows: np.ndarray, at: np.ndarray, block: np.ndarray, ts: np.ndarray, counts: np.ndarray, to: np.ndarray, most: int) -> None:
    """Compares the rows of one crowded block. `at`: their places, in units of the reach."""
    waiting = [rows]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            _sweep(rows, block, ts, counts, to)
            continue
        place = at[rows]
        cuts = [(x[x <= m + 1.001].size, x[x >= m].size, k, m) for k in range(place.shape[1]) for x in [place[:, k]] for m in (np.median(x), (x.min() + x.max()) / 2)]
        low, high, k, m = min(cuts, key=lambda c: max(c[:2]))
        if max(low, high) < 0.9 * len(rows):
            waiting += [rows[place[:, k] <= m + 1.001], rows[place[:, k] >= m]]
            continue
        # Too narrow to be halved. All rows of such a cell repeat each other; cells are compared where a pair may be in reach.
        cells, cell = np.unique(np.floor((place - place.min(0)) / 0.999).astype(np.int64), axis=0, return_inverse=True)
        order = np.argsort(cell.ravel(), kind="stable")
        rows, cell = rows[order], cell.ravel()[order]
        first = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1, [len(rows)]])
        _union(to, np.repeat(rows[first[:-1]], np.diff(first)), rows)
        parts = [rows[a:b] for a, b in zip(first[:-1], first[1:])]
        for n, one in enumerate(parts):
            for o in np.nonzero((np.abs(cells[:n] - cells[n]) <= 2).all(1))[0]:
                other = parts[o]
                for begin in range(0, len(one), 256):
                    if to[one[0]] == to[other[0]]:
                        break
                    i, j = (x.ravel() for x in np.meshgrid(one[begin : begin + 256], other, indexing="ij"))
                    found = np.nonzero(_agree(ts, counts, i, j))[0][:1]
                    _union(to, i[found], j[found])


def near_links(block: np.ndarray, ts: np.ndarray, counts: np.ndarray, most: int = 2_048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that link all events of a block that repeat each other: each event that is
    not the first of its class, with that first one. `most`: the events of a block from which it is divided."""
    order = np.lexsort((ts, block))
    block, ts, counts = block[order], ts[order], counts[order]
    to = np.arange(len(order))
    first = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(block)]])
    size = np.repeat(np.diff(first), np.diff(first)) if len(block) else np.zeros(0, np.int64)
    _sweep(np.nonzero((size > 1) & (size <= most))[0], block, ts, counts, to)
    if (size > most).any():
        at = np.concatenate([ts[:, None] / SECONDS, np.where(counts > 0, np.log(np.maximum(counts, 1)) / -np.log(1 - SHARE), -1_000.0)], 1)
        for a, b in zip(first[:-1], first[1:]):
            if b - a > most:
                _divide(np.arange(a, b), at, block, ts, counts, to, most)
    linked = np.nonzero(to != np.arange(len(to)))[0]
    return order[to[linked]], order[linked]


def near(contents: DataFrame) -> DataFrame:
    """Links a, b between the distinct `contents` that repeat each other. Besides its hash a block has a
    second one of machine and session, so that no two share it by chance."""
    rows = block_hashes(contents, (0, -1)).select("h", F.xxhash64(F.lit("who"), "machine", "session").alias("who"), "row_id", "ts", *TOKENS)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            h, who, row, ts, *counts = (whole.column(k).to_numpy() for k in range(whole.num_columns))
            order, block = np.lexsort((who, h)), np.zeros(len(h), np.int64)
            block[order[1:]] = np.cumsum((np.diff(h[order]) != 0) | (np.diff(who[order]) != 0))
            a, b = near_links(block, ts, np.stack(counts, 1))
            return pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], ["a", "b"])

        # Rows come block by block; a block that a batch ends in is kept until its end.
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last or rest and rest[-1].column(0)[-1].as_py() != h[0]:
                yield links([*rest, batch.slice(0, last)])
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield links(rest)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(link, "a bigint, b bigint")


def linked(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, root: the groups of rows that repeat each other, those of one row left out. known: links a, b found before."""
    same_id, _ = stars(rows.where("id_key is not null").select("row_id", "id_key"), ["id_key"])
    same_content, distinct = stars(rows.where("machine is not null and session is not null").select("row_id", *CONTENT), CONTENT)
    links = same_id.unionByName(same_content).unionByName(near(distinct))
    return components(links.unionByName(known) if known else links)


def repeats(rows: DataFrame) -> DataFrame:
    """row_id_a, row_id_b: each row that repeats an earlier one, with the earliest of its group."""
    return linked(rows).where("node <> root").select(F.col("root").alias("row_id_a"), F.col("node").alias("row_id_b"))


class History:
    """All events so far in a shared folder: `hashes`, a table bucketed by hash that holds each
    identifier and each content once, with a row that has it; `roots`, a part a batch with each row
    and the root of its group as it was stored (moved 0), and the stored roots whose group the batch
    joined to an earlier one (moved 1).
    A new history has as many buckets as the session has shuffle partitions, so that a batch meets
    it in one shuffle of its own; the number stays with the folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        there = [n.removeprefix("hashes_") for n in self._names() if n.startswith("hashes_")]
        self.buckets = int(there[0]) if there else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"history_{md5(self.folder.encode()).hexdigest()}"
        columns = ", ".join(["h long", "row_id long", "root long", "id_key string", "machine string", "session string", "ts long", *(f"{t} long" for t in TOKENS)])
        spark.sql(f"create table if not exists {self.table} ({columns}) using parquet clustered by (h) into {self.buckets} buckets location '{self.folder}/hashes_{self.buckets}'")

    def _names(self, below: str = "") -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    @staticmethod
    def _hashes(rows: DataFrame, reach: tuple[int, ...] = (0,)) -> DataFrame:
        """Equal identifiers and equal contents are in one group, so one row stands for all."""
        first = [F.min(c).alias(c) for c in ("row_id", "root")]
        ids = rows.where("id_key is not null").groupBy(F.xxhash64("id_key").alias("h"), "id_key").agg(*first)
        contents = block_hashes(rows.where("machine is not null and session is not null").groupBy(*CONTENT).agg(*first), reach)
        return ids.unionByName(contents, allowMissingColumns=True)

    def _roots(self, moved: int) -> DataFrame:
        """row_id, root of all batches so far."""
        if "roots" not in self._names():
            return self.spark.createDataFrame([], "row_id long, root long")
        return self.spark.read.schema("row_id long, root long, batch int, moved int").parquet(f"{self.folder}/roots").where(F.col("moved") == moved).select("row_id", "root")

    def _moves(self) -> DataFrame:
        """root, to: roots only move to smaller ones, so the smallest is the last."""
        return self._roots(1).groupBy(F.col("row_id").alias("root")).agg(F.min("root").alias("to"))

    def _now(self, rows: DataFrame) -> DataFrame:
        """`rows` with the root that their group has now."""
        return rows.join(self._moves(), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")

    def within_reach(self, batch: DataFrame) -> DataFrame:
        """What is stored of the batch's identifiers and of the cells within reach of its contents,
        with the roots of now. The stored table is read bucket by bucket and isn't moved."""
        asked = self._hashes(batch.withColumn("root", F.col("row_id")), (-1, 0, 1)).select("h").distinct()
        return checkpointed(self._now(self.spark.table(self.table).join(asked, "h", "left_semi")))

    def check(self, batch: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """row_id_a, row_id_b of the batch's rows that repeat a stored or an earlier row of the
        batch, and of stored roots whose group the batch joins to an earlier one. old: from `within_reach`."""
        old = old or self.within_reach(batch)
        columns = ["row_id", "id_key", *CONTENT]
        groups = linked(old.select(columns).unionByName(batch.select(columns)), old.select(F.col("root").alias("a"), F.col("row_id").alias("b")))
        asked = batch.select("row_id").unionByName(old.select(F.col("root").alias("row_id"))).distinct()
        return groups.where("node <> root").select(F.col("root").alias("row_id_a"), F.col("node").alias("row_id_b")).join(asked.withColumnRenamed("row_id", "row_id_b"), "row_id_b", "left_semi")

    def append(self, batch: DataFrame, found: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """Stores the batch's rows under the roots in `found`, the moves of stored roots, and the
        batch's new hashes. Returns `found`, as it was written."""
        old = old or self.within_reach(batch)
        roots = found.select(F.col("row_id_b").alias("row_id"), F.col("row_id_a").alias("root"))
        rows = batch.select("row_id").join(roots, "row_id", "left").select("row_id", F.coalesce("root", "row_id").alias("root"), F.lit(0).alias("moved"))
        moved = roots.join(batch, "row_id", "left_anti").withColumn("moved", F.lit(1))
        before = self._moves().join(moved.select(F.col("row_id").alias("to"), F.col("root").alias("__to")), "to").select(F.col("root").alias("row_id"), F.col("__to").alias("root"), F.lit(1).alias("moved"))
        part = f"{self.folder}/roots/batch={len([n for n in self._names('roots') if n.startswith('batch=')])}"
        rows.unionByName(moved).unionByName(before).write.partitionBy("moved").parquet(part)
        written = self.spark.read.schema("row_id long, root long, moved int").parquet(part)
        own = self._hashes(batch.join(written.where("moved = 0").select("row_id", "root"), "row_id"))
        same = [own[c].eqNullSafe(old[c]) for c in ("h", "id_key", *CONTENT)]
        fresh = own.join(old, reduce(and_, same), "left_anti")
        fresh.select(self.spark.table(self.table).columns).repartition(self.buckets, "h").write.insertInto(self.table)
        return written.where("root <> row_id").select(F.col("root").alias("row_id_a"), F.col("row_id").alias("row_id_b"))

    def accept(self, batch: DataFrame) -> DataFrame:
        """Checks a batch and appends it; what `check` gives."""
        old = self.within_reach(batch)
        return self.append(batch, self.check(batch, old), old)

    def repeated(self) -> DataFrame:
        """row_id_a, row_id_b: each stored row that repeats an earlier one, with the earliest of its group."""
        rows = self._now(self._roots(0))
        return rows.where("row_id <> root").select(F.col("root").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def batched(rows: DataFrame) -> DataFrame:
    """What `repeats` gives, from a history to which the bundles come in `BATCHES` batches, in their order."""
    store = History(rows.sparkSession, scratch(rows.sparkSession))
    cuts = sorted(set(rows.where("bundle_id is not null").approxQuantile("bundle_id", [k / BATCHES for k in range(1, BATCHES)], 0.001)))
    number = sum(((F.coalesce("bundle_id", F.lit(-1)) > c).cast("int") for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        store.accept(checkpointed(rows.where(number == k)))
    return store.repeated()
