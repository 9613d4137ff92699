"""Which files to read again: a listing against the manifest of the last run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """path, action, begin of every file of either table. `manifest` has path, identity, offset,
    modified; `listing` has path, identity, size, modified. An action is Full, Append (from
    `begin`), Unchanged or Forgotten."""
    old = manifest.select("path", F.col("identity").alias("was"), "offset", F.col("modified").alias("read_at"))
    both = old.join(listing, "path", "full")
    known = F.col("offset").isNotNull()
    action = (
        F.when(F.col("size").isNull(), "Forgotten").when(~known, "Full").when(~F.col("was").eqNullSafe(F.col("identity")) | (F.col("size") < F.col("offset")), "Full")
        .when(F.col("size") > F.col("offset"), "Append").when(F.col("modified") == F.col("read_at"), "Unchanged").otherwise("Full")
    )
    return both.select("path", action.alias("action"), F.when(action == "Append", F.col("offset")).otherwise(0).alias("begin"))


def changed() -> Column:
    """Whether a plan calls for writing the manifest anew; an aggregate over `action`."""
    return F.bool_or(F.col("action") != "Unchanged")
