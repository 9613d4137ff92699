"""Filling containers of fixed capacity with texts, sized in tokens.

Best-two-fit: a container is filled greedily, each time with the largest item that fits; then its
smallest item is replaced by the two unpacked items that fill the widened gap most tightly, as
long as that leaves less space. A text longer than the capacity is split: its full parts are
containers of their own, the rest is an item.

Items are spread over groups of about `GROUP` by a hash of their identifier, and each group is
packed in one task; a group wastes at most what its last containers leave.

Defined cases: a text without tokens (null, empty) needs no space and is listed with a null
container; ties of size go by doc_id; repeated rows are items of their own; an empty table gives
an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
GROUP = 20_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, numbered from 0, of each item; all sizes lie between 1 and the capacity."""
    order = np.argsort(-sizes, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1]:
        waiting[sizes[i]].append(int(i))
    there = np.zeros(capacity + 1, np.int64)
    np.add.at(there, sizes, 1)
    numbers = np.arange(capacity + 1)
    upto = np.maximum.accumulate(np.where(there > 0, numbers, 0))  # the largest size waiting that is at most x
    left, container, place = len(sizes), 0, np.empty(len(sizes), np.int64)

    def refresh(low: int) -> None:
        before = upto[low - 1] if low else 0
        upto[low:] = np.maximum.accumulate(np.maximum(np.where(there[low:] > 0, numbers[low:], 0), before))

    while left:
        inside, gap = [], capacity
        while left and (size := int(upto[gap])):
            inside.append(size)
            there[size] -= 1
            left -= 1
            gap -= size
            if not there[size]:
                refresh(size)
        while gap and left >= 2:
            smallest = inside[-1] if inside else 0
            wide = gap + smallest
            ones = numbers[1:wide][there[1:wide] > 0]
            if not ones.size:
                break
            twos = upto[wide - ones]
            # A size that waits once can't be taken twice.
            alone = (twos == ones) & (there[ones] < 2)
            twos = np.where(alone, upto[np.maximum(ones - 1, 0)], twos)
            total = np.where(twos > 0, ones + twos, 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            a, b = int(ones[best]), int(twos[best])
            inside.pop()
            there[smallest] += 1
            there[a] -= 1
            there[b] -= 1
            left -= 1
            inside += sorted((a, b), reverse=True)
            inside.sort(reverse=True)
            gap = wide - a - b
            refresh(min(a, b, smallest))
        taken: list[int] = []
        for size in inside:
            taken.append(waiting[size].pop())
        place[taken] = container
        container += 1
    return place


def containers(sized: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rows: int | None = None) -> DataFrame:
    """container_id, doc_id, part_no (from 0), first_token, n_tokens of each part of each text."""
    rows = sized.count() if rows is None else rows
    groups = max(1, -(-rows // group))
    kind = sized.schema["doc_id"].dataType.simpleString()

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        first_id = key[0].as_py() << 40
        n = table.column("n_tokens").to_numpy().astype(np.int64)
        full, rest = n // capacity, n % capacity
        items = np.nonzero(rest)[0]
        place = pack(rest[items], capacity)
        used = int(place.max()) + 1 if len(place) else 0
        none = np.nonzero(n == 0)[0]
        owner = np.concatenate([np.repeat(np.arange(len(n)), full), items, none])
        start = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
        part = np.concatenate([start, full[items], n[none]])
        where = np.concatenate([used + np.arange(len(start)), place, n[none]]) + first_id
        size = np.concatenate([np.full(len(start), capacity), rest[items], n[none]])
        yield pa.RecordBatch.from_arrays([
            pa.array(where, pa.int64(), mask=size == 0), table.column("doc_id").combine_chunks().take(pa.array(owner)), pa.array(part, pa.int32()),
            pa.array(part * capacity, pa.int64()), pa.array(size, pa.int64())], ["container_id", "doc_id", "part_no", "first_token", "n_tokens"])

    # Every text goes through the groups, so that the sizes are computed once.
    spread = sized.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"))
    return spread.groupBy("g").applyInArrow(fill, f"container_id bigint, doc_id {kind}, part_no int, first_token bigint, n_tokens bigint")
