"""How numbers, times and texts are shown, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 4096
ELLIPSIS = "…"


def _fixed(x: Column, digits: int) -> Column:
    """A double of at least 0 with so many digits, rounded by its exact binary value, ties to even.

    The product with the power of ten is taken with its rounding error (the factor's halves are
    multiplied exactly), so that 1.015, which is a little less, becomes 1.01."""
    x = x.cast("double")
    ten = float(10**digits)
    p = x * F.lit(ten)
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    error = (high * F.lit(ten) - p) + (x - high) * F.lit(ten)
    low = F.floor(p)
    rest = p - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    n = low + F.when(up, 1).otherwise(0)
    if not digits:
        return n.cast("string")
    return F.format_string(f"%d.%0{digits}d", F.floor(n / 10**digits), n % 10**digits)


def _one_or_none(x: Column) -> Column:
    return F.when(x < 10, _fixed(x, 1)).otherwise(_fixed(x, 0))


def tokens(n: Column) -> Column:
    out = n.cast("string")
    for size, unit in ((1_000, "k"), (1_000_000, "M"), (1_000_000_000, "B"), (1_000_000_000_000, "T")):
        out = F.when(n >= size, F.concat(_one_or_none(n / F.lit(float(size))), F.lit(unit))).otherwise(out)
    return out


def count(n: Column) -> Column:
    return F.format_number(n, 0)


def money(v: Column) -> Column:
    grouped = F.concat(F.lit("$"), F.format_number(F.round(v).cast("long"), 0))
    return F.when(v >= 1000, grouped).when(v >= 1, F.concat(F.lit("$"), _fixed(v, 2))).when(v > 0, F.concat(F.lit("$"), _fixed(v, 3))).otherwise("$0")


def money_partial(cost: Column, coverage: Column) -> Column:
    return F.when(coverage <= 0, "—").when(coverage >= 0.999, money(cost)).otherwise(F.concat(money(cost), F.lit("+")))


def share(fraction: Column) -> Column:
    pct = fraction * 100
    return F.when((pct > 0) & (pct < 0.5), "<1%").when((pct >= 99.5) & (pct < 100), ">99%").otherwise(F.concat(_fixed(pct, 0), F.lit("%")))


def relative(ts: Column, now: Column) -> Column:
    s = now - ts
    step = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return (
        F.when(ts == 0, "—").when(s < 90, "just now").when(s < 3600, step(60, "m ago")).when(s < 86_400, step(3600, "h ago"))
        .when(s < 172_800, "yesterday").when(s < 604_800, step(86_400, "d ago")).otherwise(short_date(F.timestamp_seconds(ts)))
    )


def short_date(d: Column) -> Column:
    return F.date_format(d, "MMM d")


def hour_label(h: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.when(h == 0, "12a").when(h < 12, F.concat(s(h), F.lit("a"))).when(h == 12, "12p").otherwise(F.concat(s(h - 12), F.lit("p")))


def hour_band(h: Column) -> Column:
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def ellipsize(s: Column, most: int) -> Column:
    if most == 0:
        return F.when(s.isNotNull(), "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(most - 1)), F.lit(ELLIPSIS)))


def terminal_text(s: Column) -> Column:
    """Control and direction marks replaced, one for one."""
    return F.regexp_replace(s, "[\\p{Cc}؜‎‏‪-‮⁦-⁩]", "�")


def size_in_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in ((1 << 10, " kB"), (1 << 20, " MB"), (1 << 30, " GB")):
        out = F.when(n >= size, F.concat(_fixed(n / F.lit(float(size)), 1), F.lit(unit))).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    s = ms / F.lit(1000.0)
    return F.when(ms >= 10_000, F.concat(_fixed(s, 1), F.lit("s"))).when(ms >= 1000, F.concat(_fixed(s, 2), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def preview(s: Column) -> Column:
    """White space folded, cut behind `PREVIEW` characters."""
    c = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    kept = F.when(F.substring(c, PREVIEW + 1, 1) == " ", F.left(c, F.lit(PREVIEW + 1))).otherwise(F.left(c, F.lit(PREVIEW)))
    return F.when(F.length(c) <= PREVIEW, c).otherwise(F.concat(kept, F.lit(ELLIPSIS)))


def replay_time(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    m = F.floor(s / 60)
    long = F.format_string("+%d:%02d:%02d", F.floor(m / 60), m % 60, s % 60)
    return F.when(m >= 60, long).otherwise(F.format_string("+%d:%02d", m, s % 60))


def wall_range(first_ms: Column, last_ms: Column) -> Column:
    a, b = F.timestamp_millis(first_ms), F.timestamp_millis(last_ms)
    end = F.when(F.to_date(a) == F.to_date(b), F.date_format(b, "HH:mm")).otherwise(F.date_format(b, "MMM d HH:mm"))
    return F.when((first_ms <= 0) | (last_ms <= 0), "").otherwise(F.concat(F.date_format(a, "MMM d HH:mm"), F.lit("–"), end))
