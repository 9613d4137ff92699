"""Costs of events from a table of rates, with explicit coverage.

The rates are the caller's: model, and US dollars a million tokens for `input`, `output` and,
where they differ from the usual multiples of the input rate, `cache_read`, `cache_write_5m`
and `cache_write_1h`. Sums are decimal, so totals don't depend on how rows are spread.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.models import pricing_key

CLASSES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
COLUMNS = ("input_tokens", "output_tokens", "cache_read", "cache_write_5m", "cache_write_1h")
#: A cache rate that is left out, as a multiple of the input rate.
MULTIPLES = {"cache_read": "0.10", "cache_write_5m": "1.25", "cache_write_1h": "2.00"}
RATE = "decimal(12,6)"


def effective(rates: DataFrame) -> DataFrame:
    """`rates` with every class filled in."""
    filled = {k: F.coalesce(F.col(k), F.col("input") * F.lit(m).cast("decimal(4,2)")).cast(RATE) for k, m in MULTIPLES.items()}
    return rates.select("model", F.col("input").cast(RATE).alias("input"), F.col("output").cast(RATE).alias("output"), *(c.alias(k) for k, c in filled.items()))


def valid(rates: DataFrame) -> DataFrame:
    """model, problem of the rates that can't be used: null, negative, not finite, or nameless."""
    bad = F.lit(False)
    for k in CLASSES:
        x = F.col(k).cast("double")
        bad |= F.coalesce((x < 0) | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(k in ("input", "output")))
    return rates.where(bad | (F.coalesce("model", F.lit("")) == "")).select("model", F.when(F.coalesce("model", F.lit("")) == "", "no model").otherwise("bad rate").alias("problem"))


def overridden(rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """`rates` with the rows of `overrides` put in or over them. A row of zeros is a placeholder: for
    an unknown model it is left out; for a known one it may mean two things, so it is refused
    (`refused_overrides`) and the rate stays."""
    new = overrides.select("model", *(F.col(k).alias(f"new_{k}") for k in CLASSES), F.lit(True).alias("over"))
    both = rates.join(new, "model", "full")
    zero = _zeros("new_")
    kept = both.where(F.col("input").isNotNull() | ~zero)
    return kept.select("model", *(F.when(F.col("over") & ~zero, F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in CLASSES))


def _zeros(prefix: str = "") -> Column:
    out = F.lit(True)
    for k in CLASSES:
        out &= F.coalesce(F.col(prefix + k), F.lit(None if k in ("input", "output") else 0)) == 0
    return F.coalesce(out, F.lit(False))


def refused_overrides(rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """The models whose override is all zeros although they have a rate."""
    return overrides.where(_zeros()).join(rates.select("model"), "model", "left_semi").select("model").distinct()


def priced(events: DataFrame, rates: DataFrame) -> DataFrame:
    """`events` with cost (decimal), priced_tokens and unpriced_tokens: by the rate of the model
    itself, else of its pricing key. The planner broadcasts the rates while they are small."""
    full = effective(rates).select(F.col("model").alias("__rate_model"), F.struct(*CLASSES).alias("__rate"))
    exact = full.withColumnsRenamed({"__rate_model": "__m1", "__rate": "__exact"})
    by_key = full.withColumnsRenamed({"__rate_model": "__m2", "__rate": "__by_key"})
    joined = events.withColumn("__key", pricing_key(F.col("model"))).join(exact, F.col("model") == F.col("__m1"), "left").join(by_key, F.col("__key") == F.col("__m2"), "left")
    rate = F.coalesce("__exact", "__by_key")
    cost = sum((F.col(c).cast("decimal(20,0)") * rate[k] for c, k in zip(COLUMNS, CLASSES)), F.lit(0).cast("decimal(38,6)")).cast("decimal(38,6)")
    known = rate.isNotNull()
    return joined.withColumns({
        "cost": F.when(known, cost).otherwise(F.lit(0).cast("decimal(38,6)")), "priced_tokens": F.when(known, F.col("total")).otherwise(0),
        "unpriced_tokens": F.when(known, 0).otherwise(F.col("total")),
    }).drop("__key", "__m1", "__m2", "__exact", "__by_key")


def unpriced_models(events: DataFrame, rates: DataFrame) -> DataFrame:
    """The models observed that neither their id nor their key finds in `rates`."""
    seen = events.select("model").where("model is not null").distinct().withColumn("__key", pricing_key(F.col("model")))
    names = rates.select(F.col("model").alias("__rate_model"))
    left = seen.join(names, F.col("model") == F.col("__rate_model"), "left_anti")
    return left.join(names, F.col("__key") == F.col("__rate_model"), "left_anti").select("model")


def coverage(priced_tokens: Column, unpriced_tokens: Column) -> Column:
    """The share of tokens that are priced; 1 where there are none."""
    total = priced_tokens + unpriced_tokens
    return F.when(total == 0, F.lit(1.0)).otherwise(priced_tokens / total)


def dollars(cost: Column) -> Column:
    """Of a decimal sum of tokens times rates."""
    return cost.cast("double") / 1e6
