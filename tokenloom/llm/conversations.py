"""Rebuilding conversations from message rows.

Rows of a session (trimmed, lower case) are ordered by time, then arrival order, undated rows
last by arrival order. Roles are inferred from loosely written kinds. A conversation is split
into parts at inactivity gaps calibrated on the corpus, and sessions that are empty, broken or
lack a reply are dropped, each with its reason.

A session can hold a third of all rows, so nothing sorts a whole session in one task. Rows are
sorted within shards (`HOURS` of dated rows, `ORDERS` arrival numbers of undated ones); a shard of
more than `CROWDED` rows is divided into as many equal spans, from its first to its last row, as it
has such numbers of rows. Each
shard is reduced to one row (count, first and last message, whether two User messages meet),
and only these meet per session. All other checks are aggregates with partial aggregation. The
timeline is written once to the shared folder, and every check reads it from there.

Defined cases: a null or blank session (or source) is one named by the empty string; of rows with one
`dedup_key` the first delivered (smallest `event_id`) counts, rows without a key all count; an
unknown or null kind is no message and no tool row; blank details are those of white space in
the Unicode sense; ties in time and order go by `event_id`, and a null `order_no` comes first; a requested session without rows is
empty; empty tables give an empty result; extra columns are carried or ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tokenloom.functions.text import strip
from tokenloom.operators.graph import checkpointed

HOURS = 6
ORDERS = 4096
CROWDED, MOST_SPANS = 50_000, 4096
KEY = ["source", "session"]
#: Letters of a kind, whatever stands between them, and the role that speaks.
ROLES = {"user": "user", "assistant": "assistant", "system": "system", "toolcall": "assistant", "toolresult": "tool", "toolerror": "tool"}


def session_id(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def kind_letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def timeline(events: DataFrame, *carried: str) -> DataFrame:
    """One row an event, each delivery counted once: source, session, undated, ts, order_no,
    event_id, kind (letters only), call_id, talks (a message with text), and `carried` columns."""
    said = F.col("kind").isin("user", "assistant") & (strip(F.col("detail")) != "")
    rows = events.select(
        session_id(F.col("source")).alias("source"), session_id(F.col("session")).alias("session"), "dedup_key", "event_id",
        (F.coalesce("ts_ms", F.lit(0)) <= 0).alias("undated"), F.greatest(F.coalesce("ts_ms", F.lit(0)), F.lit(0)).alias("ts"),
        "order_no", kind_letters(F.col("kind")).alias("kind"), "call_id", *dict.fromkeys(("detail", *carried)),
    ).withColumn("talks", F.coalesce(said, F.lit(False)))
    rows = rows if "detail" in carried else rows.drop("detail")
    rest = [c for c in rows.columns if c not in (*KEY, "dedup_key", "event_id")]
    first = rows.where("dedup_key is not null").groupBy(*KEY, "dedup_key").agg(F.min(F.struct("event_id", *rest)).alias("x"))
    once = first.select(*KEY, "dedup_key", "x.*")
    return once.unionByName(rows.where("dedup_key is null")).drop("dedup_key")


def with_shard(rows: DataFrame, crowded: int | None = None) -> DataFrame:
    """`rows` with shard, which rises with time. Crowded shards are found by a count over all rows."""
    crowded = crowded or CROWDED
    at = F.when(F.col("undated"), F.coalesce("order_no", F.lit(0)) / ORDERS).otherwise(F.col("ts") / (HOURS * 3_600_000))
    placed = rows.withColumns({"shard": F.floor(at), "within": at - F.floor(at)})
    full = placed.groupBy(*SHARD).agg(F.count("*").alias("n"), F.min("within").alias("low"), F.max("within").alias("high")).where((F.col("n") > crowded) & (F.col("low") < F.col("high")))
    full = full.withColumn("spans", F.least(F.ceil(F.col("n") / crowded), F.lit(MOST_SPANS))).drop("n")
    # None of these columns is null, so an equal join finds every shard.
    divided = placed.join(full, SHARD, "left")
    span = F.least(F.floor((F.col("within") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("spans")), F.col("spans") - 1)
    return divided.withColumn("shard", F.col("shard") * MOST_SPANS + F.coalesce(span, F.lit(0))).drop("within", "low", "high", "spans")


SHARD = [*KEY, "undated", "shard"]


def _in_shard() -> WindowSpec:
    return Window.partitionBy(*SHARD).orderBy("ts", "order_no", "event_id")


def _over_shards() -> WindowSpec:
    """One row a shard."""
    return Window.partitionBy(*KEY).orderBy("undated", "shard")


def _missing_reply(rows: DataFrame) -> DataFrame:
    """source, session of the sessions in which a User message gets no reply. rows: with shards."""
    said = rows.where("talks").withColumn("next_kind", F.lead("kind").over(_in_shard()))
    shards = said.groupBy(*SHARD).agg(
        F.min(F.struct("ts", "order_no", "event_id", "kind")).alias("first"), F.max(F.struct("ts", "order_no", "event_id", "kind")).alias("last"),
        F.bool_or((F.col("kind") == "user") & (F.col("next_kind") == "user")).alias("unanswered"),
    )
    met = shards.withColumn("then", F.lead("first.kind").over(_over_shards()))
    lacks = F.coalesce("unanswered", F.lit(False)) | ((F.col("last.kind") == "user") & (F.coalesce("then", F.lit("user")) == "user"))
    return met.where(lacks).select(*KEY).distinct()


def defects(events: DataFrame, requests: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """source, session, defect of the sessions to be dropped. rows: the timeline with its shards, written."""
    rows = checkpointed(with_shard(timeline(events))) if rows is None else rows
    at = F.struct("undated", "ts", "order_no", "event_id")
    calls = rows.where("kind in ('toolcall', 'toolresult', 'toolerror')").groupBy(*KEY, "call_id").agg(
        F.min(F.when(F.col("kind") == "toolcall", at)).alias("called"), F.min(F.when(F.col("kind") != "toolcall", at)).alias("answered"))
    orphans = calls.where("answered is not null and (call_id is null or called is null or called > answered)").select(*KEY).distinct().withColumn("orphan", F.lit(True))
    # Arrival numbers first meet as distinct (session, number) pairs.
    numbers = rows.where("order_no is not null").select(*KEY, "order_no").distinct().groupBy(*KEY).agg(F.count_if(F.col("order_no") >= 0).alias("there"), F.max("order_no").alias("largest"))
    messages = rows.where("talks").groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct(at.alias("at"), "kind")).alias("opening"))
    asked = requests.select(session_id(F.col("source")).alias("source"), session_id(F.col("session")).alias("session"))
    every = rows.select(*KEY).unionByName(asked).distinct()
    silent = _missing_reply(rows).withColumn("silent", F.lit(True))
    joined = every
    for other in (messages, numbers, orphans, silent):
        joined = joined.join(other, KEY, "left")
    broken = (F.col("there") < F.col("largest") + 1) | (F.col("opening.kind") == "assistant") | F.coalesce("orphan", F.lit(False))
    defect = F.when(F.col("n").isNull(), "empty").when(broken, "broken").when(F.col("silent"), "missing_reply")
    return joined.select(*KEY, defect.alias("defect")).where("defect is not null")


def gap_bins(rows: DataFrame) -> dict[int, int]:
    """The number of gaps between dated rows by power of two (bin 5 is 32 to 63 ms), within shards
    (of `rows`) and from each to the next of its session. The driver gets one row a bin, 64 at most."""
    dated = rows.where("not undated")
    within = dated.select((F.col("ts") - F.lag("ts").over(_in_shard())).alias("gap"))
    shards = dated.groupBy(*SHARD).agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    between = shards.select((F.col("from_ts") - F.lag("to_ts").over(_over_shards())).alias("gap"))
    gaps = within.unionByName(between).where("gap > 0")
    return {r["bin"]: r["count"] for r in gaps.groupBy(F.floor(F.log2("gap")).cast("int").alias("bin")).count().collect()}


def calibrated_gap(rows: DataFrame, least_ms: int = 60_000) -> int:
    """The inactivity gap in ms above which a conversation is taken up anew: the emptiest bin of
    the histogram of gaps (powers of two) between its two highest modes, from `least_ms` on."""
    bins = gap_bins(rows)
    if not bins:
        return 30 * 60_000
    low = max(min(bins), least_ms.bit_length() - 1)
    usual = max(bins, key=lambda b: (bins[b], -b))
    later = [b for b in range(max(usual, low) + 1, max(bins) + 1)]
    if len(later) < 2:
        return 1 << (max(bins) + 1)
    peak = max(later, key=lambda b: (bins.get(b, 0), b))
    between = [b for b in later if b <= peak]
    return 1 << min(between, key=lambda b: (bins.get(b, 0), b))


def conversations(events: DataFrame, requests: DataFrame, gap_ms: int | None = None) -> DataFrame:
    """source, session, turn_no (from 0), part_no (from 0, a new part after each long gap), role,
    ts_ms, event_id, title, detail of all conversations without a defect, every event once."""
    rows = checkpointed(with_shard(timeline(events, "title", "detail")))
    gap_ms = gap_ms or calibrated_gap(rows)
    cut = rows.join(defects(events, requests, rows), KEY, "left_anti")
    placed = cut.withColumns({"i": F.row_number().over(_in_shard()) - 1, "before": F.lag("ts").over(_in_shard())})
    placed = placed.withColumn("cuts", F.sum(F.when(~F.col("undated") & (F.col("ts") - F.col("before") > gap_ms), 1).otherwise(0)).over(_in_shard()))
    sums = placed.groupBy(*SHARD).agg(F.count("*").alias("rows"), F.max("cuts").alias("all_cuts"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    gone = _over_shards().rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("opens", F.when(~F.col("undated") & (F.col("from_ts") - F.lag("to_ts").over(_over_shards()) > gap_ms), 1).otherwise(0))
    sums = sums.select(*SHARD, F.coalesce(F.sum("rows").over(gone), F.lit(0)).alias("turns"), (F.coalesce(F.sum("all_cuts").over(gone), F.lit(0)) + F.sum("opens").over(_over_shards())).alias("parts"))
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return placed.join(sums, SHARD).select(
        *KEY, (F.col("turns") + F.col("i")).alias("turn_no"), (F.col("parts") + F.col("cuts")).alias("part_no"),
        F.coalesce(role[F.col("kind")], F.lit("unknown")).alias("role"), F.col("ts").alias("ts_ms"), "event_id", "title", "detail")
