"""One composable filter over usage events."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARED = "@shared"


@dataclass(frozen=True)
class UsageFilter:
    """All parts are optional and hold together. `since` and `until` are inclusive dates
    (yyyy-mm-dd) in the session's time zone; undated rows (`ts` 0) go only where there is a
    lower bound. `device` needs `observed_on`; SHARED stands for more than one device."""

    sources: tuple[str, ...] = field(default=())
    since: str | None = None
    until: str | None = None
    model: str | None = None
    project: str | None = None
    session: str | None = None
    device: str | None = None

    def column(self) -> Column:
        parts: list[Column] = []
        if self.sources:
            parts.append(F.col("source").isin(*self.sources))
        if self.since or self.until:
            # Bounds on the number itself reach the scan; days start where the session's time zone says.
            dated = F.col("ts") != 0
            if self.since:
                dated &= F.col("ts") >= F.unix_timestamp(F.lit(f"{self.since} 00:00:00"))
            if self.until:
                dated &= F.col("ts") < F.unix_timestamp(F.date_add(F.lit(self.until).cast("date"), 1).cast("timestamp"))
            parts.append(dated if self.since else (F.col("ts") == 0) | dated)
        for name in ("model", "project", "session"):
            if (value := getattr(self, name)) is not None:
                parts.append(F.col(name) == value)
        if self.device == SHARED:
            parts.append(F.size("observed_on") > 1)
        elif self.device:
            parts.append(F.array_contains("observed_on", self.device))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.column())


def last_days(as_of: str, days: int) -> UsageFilter:
    """The `days` days that end with `as_of`."""
    from datetime import date, timedelta

    if not 1 <= days <= 36_500:
        raise ValueError("days lie between 1 and 36500")
    return UsageFilter(since=str(date.fromisoformat(as_of) - timedelta(days - 1)), until=as_of)


def billable() -> Column:
    return F.col("total") > 0


def synthetic() -> Column:
    return F.coalesce(F.col("model").startswith("<"), F.lit(False))
