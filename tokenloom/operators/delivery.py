"""Messages delivered at least once: keep exactly one copy of each.

Rows are partitioned by message identifier and ranked; the best is kept. Ties are broken by
the row's own number (a whole number), so the result doesn't depend on how rows are spread.

An identifier may hold a third of all rows. `kept` needs only the winner of each, and ranks by
an aggregate: every task sends on one row an identifier. `surplus` needs all the others, and
ranks twice: first within a salted part of each identifier, then among the parts' winners, of
which there are at most `SALTS`.

Nulls: a null or blank identifier never equals another, such rows are always kept. A null
rank or count sorts last. Repeated rows (equal in every column but the row number) are
surplus but for the one with the smallest number. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tokenloom.functions.names import unused
from tokenloom.functions.text import message_key

SALTS = 32


def _ranked(df: DataFrame, source: Column, key: Column, better: list[Column], row: Column, clean: bool) -> tuple[DataFrame, list[str], WindowSpec, WindowSpec]:
    """`df` with helper columns, their names (identifier last), and the rankings within a salt and over all."""
    names = s, t, k = unused(df, "__source", "__salt", "__key")
    keyed = df.withColumns({s: source, t: F.pmod(F.xxhash64(row), F.lit(SALTS)), k: message_key(key) if clean else key})
    order = [c.desc_nulls_last() for c in better] + [row.asc()]
    return keyed, names, Window.partitionBy(s, k, t).orderBy(*order), Window.partitionBy(s, k).orderBy(*order)


def kept(df: DataFrame, source: Column, key: Column, better: list[Column], row: Column, clean: bool = True) -> DataFrame:
    """`df` with one row of each message, and all rows without an identifier. Unless `clean`,
    identifiers count as they are written.

    The rows of a message meet as partial winners, one a task, in a single shuffle; rows without
    an identifier are groups of their own by their number."""
    keyed, names, _, _ = _ranked(df, source, key, better, row, clean)
    s, t, k = names
    alone, best = unused(keyed, "__alone", "__best")
    groups = keyed.drop(t).withColumn(alone, F.when(F.col(k).isNull(), row)).groupBy(s, k, alone)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return groups.agg(F.max_by(F.struct(*columns), F.struct(*better, -row)).alias(best)).select(f"{best}.*")


def surplus(df: DataFrame, source: Column, key: Column, better: list[Column], row: Column, clean: bool = True) -> DataFrame:
    """The rows of `df` that `kept` leaves out."""
    keyed, names, within, over = _ranked(df, source, key, better, row, clean)
    s, _, k = names
    local, final = unused(keyed, "__local", "__final")
    placed = keyed.where(F.col(k).isNotNull()).withColumn(local, F.row_number().over(within))
    # Losers within a salt are surplus already. They go on with a partition of their own each, so
    # that the second ranking sees only winners without reading the rows twice.
    lost = F.col(local) > 1
    second = Window.partitionBy(s, k, F.when(lost, row)).orderBy(*[c.desc_nulls_last() for c in better], row.asc())
    ranked = placed.withColumn(final, F.row_number().over(second))
    return ranked.where(lost | (F.col(final) > 1)).drop(local, final, *names)


def accept_batch(stored: DataFrame, batch: DataFrame, source: Column, key: Column, better: list[Column], row: Column, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new, better): of a newly arrived batch the messages not stored yet (an anti-join against
    the stored identifiers) and those that beat the stored copy. Replacing the stored rows of
    the second and appending the first leaves the store as one pass over everything would.
    Both tables need the same columns; `stored` holds one row a message.
    """
    name = message_key(key) if clean else key
    s, k, old, at = unused(batch, "__source", "__key", "__old", "__row")
    best = kept(batch, source, key, better, row, clean).withColumns({s: source, k: name})
    ids = stored.select(source.alias(s), name.alias(k), F.struct(*better).alias(old), row.alias(at)).where(F.col(k).isNotNull())
    fresh = best.join(ids.select(s, k), [s, k], "left_anti").drop(s, k)
    now = F.struct(*better)
    wins = (now > F.col(old)) | ((now == F.col(old)) & (row < F.col(at)))
    return fresh, best.join(ids, [s, k]).where(wins).drop(s, k, old, at)
