"""State that a transcript carries from line to line, as windows over each file.

The frame always ends at the current line or the one before, so files can be read in any
order and an appended file gives the same rows as a whole one.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

COUNTERS = ("input", "cached", "output")


def _so_far(file: str = "file", line: str = "line") -> WindowSpec:
    return Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(lines: DataFrame, *columns: str) -> DataFrame:
    """Each column with its last value at or before the line."""
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(_so_far()) for c in columns})


def first_seen(lines: DataFrame, *columns: str) -> DataFrame:
    """Each column with the first value of its file, from there on."""
    return lines.withColumns({c: F.first(c, ignorenulls=True).over(_so_far()) for c in columns})


def deltas(snapshots: DataFrame) -> DataFrame:
    """What each snapshot of cumulative counters adds: file, line, lane, duplicate and fresh
    input, cache_read, output, and the other columns of `snapshots`.

    `total` and `last` are structs of the counters, either may be null. A snapshot is a duplicate
    if it has a total and equals the lane's last snapshot with a total, or the file's previous
    one. A duplicate adds nothing; `last` is taken as it is; else the total counts above the
    highest total so far, field by field, never below 0.
    """
    rows = snapshots.withColumn("sign", F.struct("total", "last"))
    in_file = Window.partitionBy("file").orderBy("line")
    in_lane = Window.partitionBy("file", "lane", F.col("total").isNotNull()).orderBy("line")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    previous, lane_previous = F.lag("sign").over(in_file), F.lag("sign").over(in_lane)
    repeat = F.col("total").isNotNull() & (F.col("sign").eqNullSafe(previous) | F.col("sign").eqNullSafe(lane_previous))
    marked = rows.where("total is not null or last is not null").withColumns({
        "duplicate": F.coalesce(repeat, F.lit(False)), **{f"high_{c}": F.coalesce(F.max(F.col(f"total.{c}")).over(before), F.lit(0)) for c in COUNTERS},
    })
    added = {c: F.when(F.col("duplicate"), 0).when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.greatest(F.col(f"total.{c}") - F.col(f"high_{c}"), F.lit(0))) for c in COUNTERS}
    rest = [c for c in snapshots.columns if c not in ("file", "line", "lane", "total", "last")]
    out = marked.select("file", "line", "lane", "duplicate", *rest, *(F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in added.items()))
    cached = F.least("cached", "input")
    return out.select("file", "line", "lane", "duplicate", *rest, (F.col("input") - cached).alias("input"), cached.alias("cache_read"), "output")
