"""Fields of JSON records, read permissively, as column expressions on variants and strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def seconds(text: Column) -> Column:
    """Unix seconds of a complete timestamp with offset; 0 for anything else."""
    return F.coalesce(F.when(text.rlike(_RFC3339), F.unix_seconds(F.try_to_timestamp(text))), F.lit(0))


def millis(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(_RFC3339), F.unix_millis(F.try_to_timestamp(text))), F.lit(0))


def u64(record: Column, path: str) -> Column:
    """A whole number without sign; 0 where the field is missing or anything else."""
    value = F.try_variant_get(record, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\((19|20),0\)$")
    number = F.when(whole & value.rlike(r"^[0-9]+$"), value.cast("decimal(20,0)"))
    return F.coalesce(F.when(number <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), number), F.lit(0).cast("decimal(20,0)"))


#: Counts are kept as whole numbers of 64 bits with sign; larger ones count as the largest.
MOST = (1 << 63) - 1


def count(record: Column, path: str) -> Column:
    """A whole number without sign, at most `MOST`; 0 where the field is missing or anything else."""
    return F.least(u64(record, path), F.lit(MOST).cast("decimal(20,0)")).cast("long")


def added(*counts: Column) -> Column:
    """The sum of counts without nulls, at most `MOST`."""
    out = counts[0]
    for c in counts[1:]:
        out = F.try_add(out, c)
    return F.coalesce(out, F.lit(MOST))


def summed(c: Column | str) -> Column:
    """The sum of a group's counts, at most `MOST`; null where there is none."""
    return F.coalesce(F.try_sum(c), F.when(F.count(c) > 0, F.lit(MOST)))


def first_present(record: Column, *paths: str) -> Column:
    """The first path that is there, even if it holds null; as string."""
    out = F.lit(None).cast("string")
    for path in reversed(paths):
        there = F.try_variant_get(record, path, "variant").isNotNull()
        out = F.when(there, F.try_variant_get(record, path, "string")).otherwise(out)
    return out


def split_cache_write(total: Column, five: Column, hour: Column, split: Column) -> tuple[Column, Column]:
    """(5 minutes, 1 hour) of a cache-write total, in the proportion of a breakdown that may not add up."""
    d = lambda c: c.cast("decimal(38,0)")
    both = d(five) + d(hour)
    scaled = F.floor(d(five.cast("decimal(19,0)") * total.cast("decimal(19,0)")) / F.when(both != 0, both)).cast("decimal(38,0)")
    a = F.when((total == 0) | ~split | (both == 0), d(total)).when(both == d(total), d(five)).otherwise(scaled)
    return a, d(total) - a
