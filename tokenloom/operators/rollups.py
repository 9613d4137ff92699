"""Roll-ups of usage events: one set of measures, by any dimension.

Each is one aggregate with partial aggregation; token sums stop at the largest whole number of 64 bits. `all_rollups` computes those that partition the
events in a single pass over them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.json_fields import summed
from tokenloom.operators.filters import SHARED
from tokenloom.sources.tables import TOKENS


def measures(cost: bool = False) -> list[Column]:
    out = [summed(t).alias(t) for t in TOKENS] + [summed("total").alias("total"), F.count("*").alias("requests"), sessions().alias("sessions"), F.coalesce(F.max("ts"), F.lit(0)).alias("last_ts")]
    if cost:
        out += [F.sum("cost").alias("cost"), F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens")]
    return out


def sessions() -> Column:
    """Sessions by source and id; an empty id isn't a session."""
    return F.count_distinct(F.when(F.col("session") != "", F.struct("source", "session")))


def rollup(events: DataFrame, *dimensions: str | Column, cost: bool = False) -> DataFrame:
    return events.groupBy(*dimensions).agg(*measures(cost))


def device_bucket() -> Column:
    """The one device that saw an event, or the bucket of shared events; null where none did."""
    n = F.size("observed_on")
    return F.when(n == 1, F.col("observed_on")[0]).when(n > 1, SHARED)


def day() -> Column:
    return F.when(F.col("ts") > 0, F.to_date(F.timestamp_seconds("ts")))


def hour() -> Column:
    return F.when(F.col("ts") > 0, F.hour(F.timestamp_seconds("ts")))


def all_rollups(events: DataFrame) -> DataFrame:
    """dimension, label and additive measures of the total and of every source, model, project,
    device, day and hour, by grouping sets over one scan."""
    dims = {"source": F.col("source"), "model": F.col("model"), "project": F.col("project"), "device": device_bucket(), "day": day().cast("string"), "hour": F.when(hour().isNotNull(), F.format_string("%02d", hour()))}
    rows = events.withColumns({f"d_{k}": c for k, c in dims.items()})
    columns = [f"d_{k}" for k in dims]
    grouped = rows.groupingSets([[], *([F.col(c)] for c in columns)], *(F.col(c) for c in columns)).agg(
        F.grouping_id().alias("gid"), *(summed(t).alias(t) for t in TOKENS), summed("total").alias("total"), F.count("*").alias("requests"))
    whole = (1 << len(columns)) - 1
    name = F.when(F.col("gid") == whole, "total")
    for i, k in enumerate(dims):
        name = name.when(F.col("gid") == whole - (1 << (len(columns) - 1 - i)), k)
    label = F.coalesce(*columns)
    return grouped.select(name.alias("dimension"), label.alias("label"), *TOKENS, "total", "requests").where("dimension = 'total' or label is not null")


def tops(events: DataFrame, by: list[str], what: list[str]) -> DataFrame:
    """For each of `what` its value with most tokens in each group, as top_...; ties go to the smallest name.
    All are found in one pass; a group without any value is left out."""
    columns = [F.col(c) for c in (*by, *what)]
    sums = events.groupingSets([[*(F.col(c) for c in by), F.col(w)] for w in what], *columns).agg(F.grouping_id().alias("__gid"), F.sum("total").alias("__t"))
    whole = (1 << len(what)) - 1
    best = []
    for i, w in enumerate(what):
        own = (F.col("__gid") == whole - (1 << (len(what) - 1 - i))) & F.col(w).isNotNull()
        best.append(F.min_by(w, F.when(own, F.struct(-F.col("__t"), F.col(w)))).alias(f"top_{w}"))
    return sums.groupBy(*by).agg(*best).where(F.coalesce(*(F.col(f"top_{w}") for w in what)).isNotNull())
