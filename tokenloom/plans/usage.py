"""Queries on usage events: deduplication, filters, roll-ups, costs, calendars, devices, reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import display
from tokenloom.functions.json_fields import MOST
from tokenloom.operators import calendar, delivery, devices, pricing, reports, rollups
from tokenloom.operators.filters import SHARED, UsageFilter, billable, last_days, synthetic
from tokenloom.operators.graph import checkpointed
from tokenloom.plans.registry import Registry
from tokenloom.sources.tables import TOKENS, table

#: Queries end with a given day instead of the clock's.
AS_OF, NOW = "2025-06-29", 1751241599
#: The local device of the queries; it has events at every scale.
LOCAL = "dev-55ea50a63b"
TOTAL = f"coalesce(try_add(try_add(try_add(try_add(input_tokens, output_tokens), cache_read), cache_write_5m), cache_write_1h), {MOST})"


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """usage_event with counts in place of nulls, and their total."""
    rows = table(spark, folder, "usage_event").fillna(0, list(TOKENS))
    return rows.withColumn("total", F.expr(TOTAL))


def events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each message once, by its identifier as written. columns: those that are needed besides the key and the
    rank; a winner is carried as one value, of which later pruning takes nothing."""
    rank = [F.col("dedup_rank"), F.col("output_tokens")]
    rows = raw(spark, folder)
    rows = rows.select(*dict.fromkeys(("seq", "dedup_key", "dedup_rank", "output_tokens", *columns))) if columns else rows
    return delivery.kept(rows, F.lit(""), F.col("dedup_key"), rank, F.col("seq"), clean=False)


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """Each message once, with the devices that hold it."""
    return devices.merged(devices.with_canonical_id(raw(spark, folder)))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates made from the reference list; every fourth model has none."""
    n = F.col("model_ref_id")
    own = lambda m, k: F.when(n % m == 0, (n % k + 1) / F.lit(10)).cast("decimal(12,6)")
    return table(spark, folder, "model_reference").where("model_ref_id % 4 <> 3").select(
        F.col("model_name").alias("model"), (n % 7 + 1).cast("decimal(12,6)").alias("input"), (n % 11 + 5).cast("decimal(12,6)").alias("output"),
        own(2, 3).alias("cache_read"), own(3, 5).alias("cache_write_5m"), own(5, 4).alias("cache_write_1h"))


RAW = f"""raw as (select seq, batch_no, source, ts, model, session, project, device_id, coalesce(input_tokens, 0) as input_tokens, coalesce(output_tokens, 0) as output_tokens,
  coalesce(cache_read, 0) as cache_read, coalesce(cache_write_5m, 0) as cache_write_5m, coalesce(cache_write_1h, 0) as cache_write_1h, dedup_key, dedup_rank,
  coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write_5m, 0) + coalesce(cache_write_1h, 0) as total from usage_event)"""
EVENTS = RAW + """, ev as (select *, case when ts > 0 then cast(make_timestamp(ts * 1000000) as date) end as day, case when ts > 0 then cast(hour(make_timestamp(ts * 1000000)) as bigint) end as hr
  from raw qualify dedup_key is null or row_number() over (partition by dedup_key order by dedup_rank desc, output_tokens desc, seq) = 1)"""
_CONTENT = "sha256(concat_ws(chr(1), " + ", ".join(f"coalesce(length(cast({c} as varchar)), 0) || ':' || coalesce(cast({c} as varchar), '')" for c in ("source", "ts", "model", "session", "project", *TOKENS)) + "))"
OBSERVED = RAW + f""", ids as (select *, case when dedup_key is not null then case when source = 'claude' and not starts_with(dedup_key, 'claude:') then 'claude:v1:' || dedup_key else dedup_key end
    else 'fallback:v1:' || {_CONTENT} || ':' || (row_number() over (partition by device_id, case when dedup_key is null then {_CONTENT} end order by seq) - 1) end as id from raw),
  seen as (select id, list_sort(list(distinct device_id)) as observed_on from ids group by id),
  ob as (select x.*, s.observed_on from (select * from ids qualify row_number() over (partition by id order by dedup_rank desc, output_tokens desc, seq) = 1) x join seen s using (id))"""
RATES = """rates as (select model_name as model, cast(model_ref_id % 7 + 1 as decimal(12,6)) as input, cast(model_ref_id % 11 + 5 as decimal(12,6)) as output,
  case when model_ref_id % 2 = 0 then cast((model_ref_id % 3 + 1) / 10.0 as decimal(12,6)) end as cache_read, case when model_ref_id % 3 = 0 then cast((model_ref_id % 5 + 1) / 10.0 as decimal(12,6)) end as cache_write_5m,
  case when model_ref_id % 5 = 0 then cast((model_ref_id % 4 + 1) / 10.0 as decimal(12,6)) end as cache_write_1h from model_reference where model_ref_id % 4 <> 3),
 full_rates as (select model, input, output, coalesce(cache_read, cast(input * 0.10 as decimal(12,6))) as cache_read, coalesce(cache_write_5m, cast(input * 1.25 as decimal(12,6))) as cache_write_5m,
  coalesce(cache_write_1h, cast(input * 2.00 as decimal(12,6))) as cache_write_1h from rates)"""
PKEY = "case when regexp_full_match(model, '(?s).+-[0-9]{8}') then regexp_replace(model, '(?s)^(.+)-[0-9]{8}$', '\\1') else regexp_replace(model, '(?s)^(.+)-(?:minimal|low|medium|high|xhigh)$', '\\1') end"
PRICED = EVENTS + ", " + RATES + f""", pr as (select e.*, case when coalesce(a.model, b.model) is null then 0 else e.input_tokens * coalesce(a.input, b.input) + e.output_tokens * coalesce(a.output, b.output)
    + e.cache_read * case when a.model is null then b.cache_read else a.cache_read end + e.cache_write_5m * case when a.model is null then b.cache_write_5m else a.cache_write_5m end
    + e.cache_write_1h * case when a.model is null then b.cache_write_1h else a.cache_write_1h end end as cost,
  case when coalesce(a.model, b.model) is null then 0 else total end as priced_tokens, case when coalesce(a.model, b.model) is null then total else 0 end as unpriced_tokens
  from ev e left join full_rates a on a.model = e.model left join full_rates b on b.model = {PKEY.replace('model,', 'e.model,')})"""
SUMS = ", ".join(f"cast(sum({t}) as bigint) as {t}" for t in TOKENS) + ", cast(sum(total) as bigint) as total, count(*) as requests, count(distinct case when session <> '' then source || chr(1) || session end) as sessions, coalesce(max(ts), 0) as last_ts"
COSTS = "cast(sum(cost) as double) / 1e6 as cost_usd, cast(sum(priced_tokens) as bigint) as priced_tokens, cast(sum(unpriced_tokens) as bigint) as unpriced_tokens, case when sum(total) = 0 then 1.0 else cast(sum(priced_tokens) as double) / cast(sum(total) as double) end as coverage"

_all = Registry()
query, QUERIES, SQL = _all.query, _all.queries, _all.sql


def with_cost(df: DataFrame) -> DataFrame:
    """Cost sums as shown: dollars and coverage."""
    return df.withColumns({"cost_usd": pricing.dollars(F.col("cost")), "coverage": pricing.coverage(F.col("priced_tokens"), F.col("unpriced_tokens"))}).drop("cost")


def priced(spark: SparkSession, folder: str) -> DataFrame:
    return pricing.priced(events(spark, folder), rates(spark, folder))


def daily(spark: SparkSession, folder: str, cost: bool = False) -> DataFrame:
    rows = priced(spark, folder) if cost else events(spark, folder)
    return rollups.rollup(rows.where("ts > 0"), rollups.day().alias("date"), cost=cost)


# Deduplication


@query("dedup_rank", "with " + EVENTS + " select seq, dedup_key, dedup_rank, output_tokens from ev where dedup_key is not null")
def dedup_rank(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "dedup_key").where("dedup_key is not null").select("seq", "dedup_key", "dedup_rank", "output_tokens")


@query("dedup_keyless", "with " + EVENTS + " select seq, source, total from ev where dedup_key is null")
def dedup_keyless(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "source", "total").where("dedup_key is null").select("seq", "source", "total")


@query("incremental_merge", "with " + EVENTS + " select seq, source, total from ev where dedup_key is not null")
def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The later half of the batches put into the store of the earlier half: as one pass over all."""
    rank = {"source": F.lit(""), "key": F.col("dedup_key"), "better": [F.col("dedup_rank"), F.col("output_tokens")], "row": F.col("seq"), "clean": False}
    rows = raw(spark, folder).where("dedup_key is not null").select("seq", "batch_no", "source", "dedup_key", "dedup_rank", "output_tokens", "total")
    half = rows.agg(F.floor(F.max("batch_no") / 2)).scalar()
    old, new = rows.where(F.col("batch_no") <= half), rows.where(F.col("batch_no") > half)
    stored = delivery.kept(old, **rank)
    fresh, better = delivery.accept_batch(stored, new, **rank)
    unbeaten = stored.join(better.select("dedup_key"), "dedup_key", "left_anti")
    return unbeaten.unionByName(fresh).unionByName(better).select("seq", "source", "total")


# Filters


def _filtered(f: UsageFilter, seen: bool = False):  # noqa: ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f.apply((observed if seen else events)(spark, folder)).select("seq", "source", "ts", "total")

    return run


def _filter(name: str, f: UsageFilter, where: str, seen: bool = False) -> None:
    query(name, f"with {OBSERVED if seen else EVENTS} select seq, source, ts, total from {'ob' if seen else 'ev'} where {where}")(_filtered(f, seen))


_DAY = 86_400
_MAY = 1746057600  # 2025-05-01
_filter("filter_source", UsageFilter(sources=("codex",)), "source = 'codex'")
_filter("filter_undated", UsageFilter(until="2025-05-31"), f"ts = 0 or ts < {_MAY + 31 * _DAY}")
_filter("filter_date_window", UsageFilter(since="2025-05-01", until="2025-05-31"), f"ts >= {_MAY} and ts < {_MAY + 31 * _DAY}")
_filter("filter_exact_dims", UsageFilter(model="glimmerot-4.1", project="/srv/work/atlas-ledger"), "model = 'glimmerot-4.1' and project = '/srv/work/atlas-ledger'")
_filter("filter_last_days", last_days(AS_OF, 7), f"ts >= {NOW + 1 - 7 * _DAY} and ts <= {NOW}")
_filter("filter_drill", UsageFilter(sources=("claude", "codex"), since="2025-06-01", until=AS_OF, model="quorumex-3"), f"model = 'quorumex-3' and ts >= {_MAY + 31 * _DAY} and ts <= {NOW}")
_filter("filter_device", UsageFilter(device=LOCAL), f"list_contains(observed_on, '{LOCAL}')", True)
_filter("filter_local_only", UsageFilter(device=LOCAL, until=AS_OF), f"list_contains(observed_on, '{LOCAL}') and ts <= {NOW}", True)
_filter("filter_shared", UsageFilter(device=SHARED), "len(observed_on) > 1", True)


@query("filter_billable", "with " + EVENTS + " select seq, total from ev where total > 0")
def filter_billable(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "total").where(billable()).select("seq", "total")


@query("filter_synthetic", "with " + EVENTS + " select source, count(*) as kept, (select count(*) from ev where starts_with(model, '<')) as skipped from ev where not coalesce(starts_with(model, '<'), false) group by source")
def filter_synthetic(spark: SparkSession, folder: str) -> DataFrame:
    by_source = events(spark, folder, "source", "model").groupBy("source").agg(F.count_if(~synthetic()).alias("kept"), F.count_if(synthetic()).alias("own"))
    return by_source.select("source", "kept", by_source.agg(F.sum("own")).scalar().alias("skipped"))


_LATEST = EVENTS + f", fl as (select * from ev where ts <= {NOW}), la as (select session, arg_max(source, (ts, seq)) as source, max(ts) as last_ts, count(*) as requests from fl group by session)"


def _latest_source(rows: DataFrame) -> DataFrame:
    """session, source (that of its latest event, of equally late ones the last to arrive), last_ts, requests."""
    return rows.groupBy("session").agg(F.max_by("source", F.struct("ts", "seq")).alias("source"), F.max("ts").alias("last_ts"), F.count("*").alias("requests"))


@query("session_latest_source", f"with {_LATEST} select * from la")
def session_latest_source(spark: SparkSession, folder: str) -> DataFrame:
    """Of the events that the filter admits, which source a session's timeline is read from."""
    return _latest_source(UsageFilter(until=AS_OF).apply(events(spark, folder, "source", "session", "ts")))


@query("session_events", f"with {_LATEST} select seq, ts, total from fl where session = (select min(session) from la where session <> '') and source = (select source from la where session = (select min(session) from la where session <> ''))")
def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """The admitted events of the first session by name, from its latest source."""
    rows = UsageFilter(until=AS_OF).apply(events(spark, folder, "source", "session", "ts", "total")).where("session <> ''")
    first = _latest_source(rows).agg(F.min(F.struct("session", "source")).alias("x")).select("x.*")
    return rows.where((F.col("session") == first.select("session").scalar()) & (F.col("source") == first.select("source").scalar())).select("seq", "ts", "total")


# Roll-ups


def _rollup(name: str, keys: list[Column | str], sql_keys: str, where: str = "true", cost: bool = False) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = (priced if cost else events)(spark, folder).where(where)
        out = rollups.rollup(rows, *[k() if callable(k) else k for k in keys], cost=cost)
        return with_cost(out) if cost else out

    group = f"group by {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else ""
    query(name, f"with {PRICED if cost else EVENTS} select {sql_keys + ', ' if sql_keys else ''}{SUMS}{', ' + COSTS if cost else ''} from {'pr' if cost else 'ev'} where {where} {group}")(run)


_rollup("rollup_total", [], "", cost=True)
_rollup("rollup_source", ["source"], "source", cost=True)
_rollup("rollup_model", ["model"], "model", cost=True)
_rollup("rollup_project", ["project"], "project", cost=True)
_rollup("rollup_session", ["source", "session"], "source, session")
_rollup("rollup_daily", [lambda: rollups.day().cast("string").alias("date")], "strftime(day, '%Y-%m-%d') as date", "ts > 0", cost=True)


@query("rollup_device", "with " + OBSERVED + f" select case when len(observed_on) = 1 then coalesce(any_value(d.name), observed_on[1]) else 'Shared' end as device, case when len(observed_on) = 1 then observed_on[1] else '@shared' end as bucket, {SUMS} from ob left join device_record d on d.device_id = observed_on[1] group by bucket, observed_on[1], len(observed_on)".replace("group by bucket, observed_on[1], len(observed_on)", "group by all").replace("coalesce(any_value(d.name), observed_on[1])", "coalesce(d.name, observed_on[1])"))
def rollup_device(spark: SparkSession, folder: str) -> DataFrame:
    rows = rollups.rollup(observed(spark, folder).withColumn("bucket", rollups.device_bucket()).where("bucket is not null"), "bucket")
    names = table(spark, folder, "device_record").select(F.col("device_id").alias("bucket"), "name")
    return rows.join(names, "bucket", "left").withColumn("device", F.when(F.col("bucket") == SHARED, "Shared").otherwise(F.coalesce("name", "bucket"))).drop("name")


@query("rollup_hour", "with " + EVENTS + ", hours as (select unnest(range(24)) as hour) select printf('%02d', hour) as label, cast(coalesce(sum(total), 0) as bigint) as total, count(ev.seq) as requests from hours left join ev on hr = hour group by hour")
def rollup_hour(spark: SparkSession, folder: str) -> DataFrame:
    sums = events(spark, folder, "ts", "total").where("ts > 0").groupBy(rollups.hour().alias("hour")).agg(F.sum("total").alias("total"), F.count("*").alias("requests"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(sums, "hour", "left").fillna(0).select(F.format_string("%02d", "hour").alias("label"), "total", "requests")


_SETS = "total source model project device day hour".split()


@query("rollup_all", "with " + OBSERVED + """, x as (select *, case when len(observed_on) = 1 then observed_on[1] else '@shared' end as device, case when ts > 0 then strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') end as day,
  case when ts > 0 then strftime(make_timestamp(ts * 1000000), '%H') end as hour from ob) """ + " union all ".join(
    f"select '{d}' as dimension, {'null' if d == 'total' else d} as label, " + ", ".join(f"cast(sum({t}) as bigint) as {t}" for t in (*TOKENS, "total")) + f", count(*) as requests from x {'' if d == 'total' else f'where {d} is not null group by {d}'}" for d in _SETS))
def rollup_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every partitioning roll-up in one scan of the events."""
    return rollups.all_rollups(observed(spark, folder))


@query("activity_span", "with " + EVENTS + " select coalesce(min(ts), 0) as first_ts, coalesce(max(ts), 0) as last_ts from ev where ts > 0")
def activity_span(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "ts").where("ts > 0").agg(F.coalesce(F.min("ts"), F.lit(0)).alias("first_ts"), F.coalesce(F.max("ts"), F.lit(0)).alias("last_ts"))


@query("count_sessions", "with " + EVENTS + " select project, count(distinct case when session <> '' then source || chr(1) || session end) as sessions from ev group by project")
def count_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "project", "source", "session").groupBy("project").agg(rollups.sessions().alias("sessions"))


@query("session_top_dims", "with " + EVENTS + """, m as (select * from (select source, session, model, sum(total) as t from ev where model is not null group by all) qualify row_number() over (partition by source, session order by t desc, model) = 1),
  p as (select * from (select source, session, project, sum(total) as t from ev where project is not null group by all) qualify row_number() over (partition by source, session order by t desc, project) = 1)
  select source, session, m.model as top_model, p.project as top_project from m full join p using (source, session)""")
def session_top_dims(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.tops(events(spark, folder, "source", "session", "model", "project", "total"), ["source", "session"], ["model", "project"])


@query("session_devices", "with " + OBSERVED + ", f as (select source, session, unnest(observed_on) as d from ob) select source, session, case when count(distinct d) = 1 then min(d) else 'Shared' end as device from f group by source, session")
def session_devices(spark: SparkSession, folder: str) -> DataFrame:
    seen = observed(spark, folder).select("source", "session", F.explode("observed_on").alias("d")).groupBy("source", "session").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return seen.select("source", "session", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("Shared").alias("device"))


@query("headline_shape", "with " + EVENTS + " select count(distinct case when session <> '' then source || chr(1) || session end) as sessions, count(distinct project) as projects, count(distinct model) as models from ev")
def headline_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Three counts over one deduplication."""
    rows = events(spark, folder, "source", "session", "project", "model")
    return rows.agg(rollups.sessions().alias("sessions"), F.count_distinct("project").alias("projects"), F.count_distinct("model").alias("models"))


@query("scan_stats", "with " + RAW + """, k as (select count(*) as n, count(distinct dedup_key) + count(*) filter (dedup_key is null) as kept, count(*) filter (starts_with(model, '<')) as synthetic from raw)
  select n as events, n - kept as duplicates, synthetic from k""")
def scan_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw(spark, folder).select("dedup_key", "model")
    counted = rows.groupBy("dedup_key").agg(F.count("*").alias("n"), F.count_if(synthetic()).alias("s"))
    return counted.agg(F.sum("n").alias("events"), F.sum(F.when(F.col("dedup_key").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum("s").alias("synthetic"))


@query("text_bytes", "with " + EVENTS + " select source, cast(sum(coalesce(strlen(model), 0) + strlen(session) + coalesce(strlen(project), 0) + coalesce(strlen(dedup_key), 0)) as bigint) as bytes from ev group by source")
def text_bytes(spark: SparkSession, folder: str) -> DataFrame:
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("model", "session", "project", "dedup_key")), F.lit(0))
    return events(spark, folder, "source", "model", "session", "project").groupBy("source").agg(F.sum(size).alias("bytes"))


@query("breakdown_share", "with " + EVENTS + " select project, cast(sum(total) as bigint) as total, case when sum(sum(total)) over () = 0 then 0 else cast(sum(total) as double) * 100 / cast(sum(sum(total)) over () as double) end as share from ev group by project")
def breakdown_share(spark: SparkSession, folder: str) -> DataFrame:
    """The grand total is a scalar subquery over the same sums, whose shuffle is reused."""
    sums = events(spark, folder, "project", "total").groupBy("project").agg(F.sum("total").alias("total"))
    grand = sums.agg(F.sum("total")).scalar()
    return sums.withColumn("share", F.when(grand == 0, F.lit(0.0)).otherwise(F.col("total").cast("double") * 100 / grand.cast("double")))


@query("bar_fraction", "with " + EVENTS + " select model, cast(sum(total) as double) / greatest(cast(max(sum(total)) over () as double), 1) as fraction from ev group by model")
def bar_fraction(spark: SparkSession, folder: str) -> DataFrame:
    sums = events(spark, folder, "model", "total").groupBy("model").agg(F.sum("total").alias("total"))
    most = sums.agg(F.max("total")).scalar()
    return sums.select("model", (F.col("total").cast("double") / F.greatest(most.cast("double"), F.lit(1.0))).alias("fraction"))


# Costs


@query("price_events", "with " + PRICED + " select seq, cast(cost as double) / 1e6 as cost_usd, cast(priced_tokens as bigint) as priced_tokens, cast(unpriced_tokens as bigint) as unpriced_tokens from pr")
def price_events(spark: SparkSession, folder: str) -> DataFrame:
    return priced(spark, folder).select("seq", pricing.dollars(F.col("cost")).alias("cost_usd"), "priced_tokens", "unpriced_tokens")


@query("unpriced_models", "with " + PRICED + " select distinct model from pr where model is not null and model not in (select model from rates) and (" + PKEY + ") not in (select model from rates)")
def unpriced_models(spark: SparkSession, folder: str) -> DataFrame:
    return pricing.unpriced_models(events(spark, folder, "model"), rates(spark, folder))


@query("cost_coverage", "with " + PRICED + f" select project, {COSTS}, case when cast(sum(unpriced_tokens) as double) / greatest(cast(sum(total) as double), 1) >= 0.5 then 'serious' when sum(unpriced_tokens) > 0 then 'warning' else 'none' end as severity from pr group by project")
def cost_coverage(spark: SparkSession, folder: str) -> DataFrame:
    sums = with_cost(priced(spark, folder).groupBy("project").agg(F.sum("cost").alias("cost"), F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens")))
    missing = F.col("unpriced_tokens") / F.greatest(F.col("priced_tokens") + F.col("unpriced_tokens"), F.lit(1))
    return sums.withColumn("severity", F.when(missing >= 0.5, "serious").when(F.col("unpriced_tokens") > 0, "warning").otherwise("none"))


@query("rate_table", "with " + RATES + " select model, cast(input as double) as input, cast(output as double) as output, cast(cache_read as double) as cache_read, cast(cache_write_5m as double) as cache_write_5m, cast(cache_write_1h as double) as cache_write_1h from full_rates")
def rate_table(spark: SparkSession, folder: str) -> DataFrame:
    full = pricing.effective(rates(spark, folder))
    return full.select("model", *(F.col(k).cast("double").alias(k) for k in pricing.CLASSES)).orderBy("model")


@query("validate_rates", "select model_name as model, case when model_ref_id % 9 = 0 then 'no model' else 'bad rate' end as problem from (select case when model_ref_id % 9 = 0 then '' else model_name end as model_name, model_ref_id from model_reference) where model_ref_id % 9 = 0 or model_ref_id % 5 = 0 or model_ref_id % 7 = 0 or model_ref_id % 11 = 0")
def validate_rates(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("model_ref_id")
    given = table(spark, folder, "model_reference").select(
        F.when(n % 9 == 0, "").otherwise(F.col("model_name")).alias("model"), F.when(n % 5 != 0, F.lit(1.5)).alias("input"), F.when(n % 7 == 0, F.lit(-1.0)).otherwise(2.0).alias("output"),
        F.when(n % 11 == 0, F.lit(float("nan"))).alias("cache_read"), F.lit(None).cast("double").alias("cache_write_5m"), F.lit(None).cast("double").alias("cache_write_1h"))
    return pricing.valid(given)


@query("pricing_overrides", "with " + RATES + """, over as (select case when model_ref_id % 4 = 0 then model_name else model_name || '-new' end as model, case when model_ref_id % 3 = 0 then 0.0 else 9.5 end as input, case when model_ref_id % 3 = 0 then 0.0 else 19.5 end as output
  from model_reference where model_ref_id % 4 in (0, 1))
  select model, cast(case when o.input + o.output > 0 then o.input else r.input end as double) as input, cast(case when o.input + o.output > 0 then o.output else r.output end as double) as output, coalesce(o.input = 0 and o.output = 0, false) as refused
  from rates r full join over o using (model) where r.model is not null or not (o.input = 0 and o.output = 0)""")
def pricing_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Overrides as they are delivered: one JSON object from model to rate. Zeros for a model with a
    rate are refused, zeros for another one a placeholder."""
    n = F.col("model_ref_id")
    name = F.when(n % 4 == 0, F.col("model_name")).otherwise(F.concat("model_name", F.lit("-new")))
    rate = F.when(n % 3 == 0, F.struct(F.lit(0.0).alias("input"), F.lit(0.0).alias("output"))).otherwise(F.struct(F.lit(9.5).alias("input"), F.lit(19.5).alias("output")))
    document = table(spark, folder, "model_reference").where("model_ref_id % 4 in (0, 1)").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name, rate)))).alias("json"))
    read = document.select(F.explode(F.from_json("json", "map<string,struct<input:decimal(12,6),output:decimal(12,6),cache_read:decimal(12,6),cache_write_5m:decimal(12,6),cache_write_1h:decimal(12,6)>>")).alias("model", "rate"))
    old, new = rates(spark, folder), read.select("model", "rate.*")
    refused = pricing.refused_overrides(old, new).withColumn("refused", F.lit(True))
    out = pricing.overridden(old, new).join(refused, "model", "left")
    return out.select("model", F.col("input").cast("double").alias("input"), F.col("output").cast("double").alias("output"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query("pricing_starter", "with " + PRICED + " select model, coalesce(cast(any_value(r.input) as double), 0) as input, coalesce(cast(any_value(r.output) as double), 0) as output from (select distinct model from ev where model is not null) left join full_rates r using (model) group by model")
def pricing_starter(spark: SparkSession, folder: str) -> DataFrame:
    """The models observed with their rate; zeros stand for rates to be filled in."""
    seen = events(spark, folder, "model").select("model").where("model is not null").distinct()
    full = pricing.effective(rates(spark, folder)).select("model", F.col("input").cast("double").alias("input"), F.col("output").cast("double").alias("output"))
    return seen.join(full, "model", "left").fillna(0.0)


# Calendars


def _date_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


@query("daily_dense", "with " + EVENTS + f", d as (select cast(unnest(range(date '{AS_OF}' - 29, date '{AS_OF}' + 1, interval 1 day)) as date) as date) select strftime(date, '%Y-%m-%d') as date, cast(coalesce(sum(total), 0) as bigint) as total, count(ev.seq) as requests from d left join ev on day = date group by 1")
def daily_dense(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder).select("date", "total", "requests")
    return _date_text(calendar.dense(spark, rows, AS_OF, 30, {"total": 0, "requests": 0}))


@query("report_daily_csv", "with " + PRICED + f""", d as (select cast(unnest(range(date '{AS_OF}' - 29, date '{AS_OF}' + 1, interval 1 day)) as date) as date),
  s as (select date, cast(coalesce(sum(total), 0) as bigint) as total, cast(round(coalesce(sum(cost), 0), 0) as bigint) as micro, cast(coalesce(sum(priced_tokens), 0) as bigint) as priced, count(pr.seq) as requests from d left join pr on day = date group by date),
  c as (select *, case when total = 0 then 1000000 else (2000000 * priced + total) // (2 * total) end as cover from s)
  select strftime(date, '%Y-%m-%d') || ',' || total || ',' || micro // 1000000 || '.' || lpad(cast(micro % 1000000 as varchar), 6, '0') || ',' || cover // 1000000 || '.' || lpad(cast(cover % 1000000 as varchar), 6, '0') || ',' || requests as line from c union all select 'date,tokens,cost_usd,cost_coverage,requests'""")
def report_daily_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A header, then date,tokens,cost_usd,cost_coverage,requests of each day, both fractions with 6 digits."""
    rows = daily(spark, folder, cost=True).select("date", "total", F.round("cost", 0).cast("long").alias("micro"), "priced_tokens", "requests")
    full = calendar.dense(spark, rows, AS_OF, 30, {"total": 0, "micro": 0, "priced_tokens": 0, "requests": 0})
    cover = F.when(F.col("total") == 0, 1_000_000).otherwise(F.floor((F.col("priced_tokens").cast("decimal(28,0)") * 2_000_000 + F.col("total")) / (F.col("total") * 2)))
    six = lambda c: F.format_string("%d.%06d", F.floor(c / 1_000_000), c % 1_000_000)
    header = spark.range(1).select(F.lit(0).alias("n"), F.lit("date,tokens,cost_usd,cost_coverage,requests").alias("line"))
    lines = full.select(F.lit(1).alias("n"), F.concat_ws(",", F.col("date").cast("string"), F.col("total").cast("string"), six(F.col("micro")), six(cover.cast("long")), F.col("requests").cast("string")).alias("line"))
    return header.unionByName(lines).orderBy("n", "line").select("line")


@query("today_bucket", "with " + EVENTS + f" select strftime(day, '%Y-%m-%d') as date, {SUMS} from ev where day = date '{AS_OF}' group by day")
def today_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """No row where nothing was used; the day's bounds reach the scan."""
    today = last_days(AS_OF, 1).apply(events(spark, folder))
    return _date_text(rollups.rollup(today, rollups.day().alias("date")))


@query("month_to_date", "with " + PRICED + f" select cast(sum(total) as bigint) as total, {COSTS} from pr where day between date '2025-06-01' and date '{AS_OF}'")
def month_to_date(spark: SparkSession, folder: str) -> DataFrame:
    days = calendar.month_to_date(daily(spark, folder, cost=True), AS_OF)
    return with_cost(days.agg(F.sum("total").alias("total"), F.sum("cost").alias("cost"), F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens")))


@query("current_streak", "with " + EVENTS + f""", d as (select distinct day from ev where project = '/srv/work/atlas-ledger' and total > 0 and day <= date '{AS_OF}'), r as (select day, day - cast(row_number() over (order by day) as int) as island from d),
  s as (select max(day) as last, count(*) as n from r group by island) select coalesce(max(n) filter (last >= date '{AS_OF}' - 1), 0) as streak from s""")
def current_streak(spark: SparkSession, folder: str) -> DataFrame:
    rows = UsageFilter(project="/srv/work/atlas-ledger").apply(events(spark, folder)).where("ts > 0")
    return calendar.streak(rollups.rollup(rows, rollups.day().alias("date")), AS_OF)


@query("chart_span", "with " + EVENTS + f" select project, greatest(30, least(365, ({NOW} - min(ts)) // 86400 + 1)) as days from ev where ts > 0 group by project")
def chart_span(spark: SparkSession, folder: str) -> DataFrame:
    first = events(spark, folder, "project", "ts").where("ts > 0").groupBy("project").agg(F.min("ts").alias("first"))
    return first.select("project", F.greatest(F.lit(30), F.least(F.lit(365), F.floor((NOW - F.col("first")) / 86_400) + 1)).alias("days"))


@query("busiest_day", "with " + EVENTS + " select strftime(day, '%Y-%m-%d') as date, cast(sum(total) as bigint) as total from ev where ts > 0 group by day having sum(total) > 0 order by sum(total) desc, day desc limit 1")
def busiest_day(spark: SparkSession, folder: str) -> DataFrame:
    days = daily(spark, folder).where("total > 0")
    return days.agg(F.max_by(F.col("date").cast("string"), F.struct("total", "date")).alias("date"), F.max("total").alias("total"))


@query("hour_rebucket", "with " + EVENTS + " select hr // 3 as bucket, cast(sum(total) as bigint) as total from ev where ts > 0 group by 1")
def hour_rebucket(spark: SparkSession, folder: str) -> DataFrame:
    """Hours merged for a plot of 8 columns."""
    return events(spark, folder, "ts", "total").where("ts > 0").groupBy(F.floor(rollups.hour() / 3).alias("bucket")).agg(F.sum("total").alias("total"))


@query("hour_band_rollup", "with " + EVENTS + " select case when hr < 6 then 'night' when hr < 12 then 'morning' when hr < 18 then 'afternoon' else 'evening' end as band, cast(sum(total) as bigint) as total from ev where ts > 0 group by 1")
def hour_band_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "ts", "total").where("ts > 0").groupBy(display.hour_band(rollups.hour()).alias("band")).agg(F.sum("total").alias("total"))


# Top lists


def _top(name: str, key: str, n: int, offset: int = 0) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sums = events(spark, folder, key, "total").groupBy(key).agg(F.sum("total").alias("total"), F.count("*").alias("requests"))
        return sums.orderBy(F.col("total").desc(), F.col(key).asc_nulls_last()).offset(offset).limit(n)

    query(name, f"with {EVENTS} select {key}, cast(sum(total) as bigint) as total, count(*) as requests from ev group by {key} order by sum(total) desc, {key} nulls last limit {n} offset {offset}")(run)


_top("top_models", "model", 12)
_top("top_projects", "project", 10)
_top("page_models", "model", 20, 20)


@query("recent_sessions", "with " + EVENTS + " select source, session, max(ts) as last_ts, cast(sum(total) as bigint) as total from ev group by source, session order by max(ts) desc, sum(total) desc, source, session limit 25")
def recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sums = events(spark, folder, "source", "session", "ts", "total").groupBy("source", "session").agg(F.max("ts").alias("last_ts"), F.sum("total").alias("total"))
    return sums.orderBy(F.col("last_ts").desc(), F.col("total").desc(), "source", "session").limit(25)


@query("report_text_models", "with " + PRICED + f" select coalesce(model, 'unknown') as model, cast(sum(total) as bigint) as total, case when cast(sum(priced_tokens) as double) / greatest(cast(sum(total) as double), 1) >= 0.999 then 'priced' else '—' end as cost from pr group by 1 order by sum(total) desc, 1 limit 12")
def report_text_models(spark: SparkSession, folder: str) -> DataFrame:
    """The list of the text report: a cost only where the model is fully priced."""
    sums = priced(spark, folder).groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.sum("total").alias("total"), F.sum("priced_tokens").alias("p"))
    full = F.col("p") / F.greatest("total", F.lit(1)) >= 0.999
    return sums.select("model", "total", F.when(full, "priced").otherwise("—").alias("cost")).orderBy(F.col("total").desc(), "model").limit(12)


_REPORT = OBSERVED + ", " + RATES + f""", pr as (select e.*, case when coalesce(a.model, b.model) is null then 0 else e.input_tokens * coalesce(a.input, b.input) + e.output_tokens * coalesce(a.output, b.output)
    + e.cache_read * case when a.model is null then b.cache_read else a.cache_read end + e.cache_write_5m * case when a.model is null then b.cache_write_5m else a.cache_write_5m end
    + e.cache_write_1h * case when a.model is null then b.cache_write_1h else a.cache_write_1h end end as cost,
  case when coalesce(a.model, b.model) is null then 0 else total end as priced_tokens, case when coalesce(a.model, b.model) is null then total else 0 end as unpriced_tokens
  from ob e left join full_rates a on a.model = e.model left join full_rates b on b.model = {PKEY.replace('model,', 'e.model,')}),
  x as (select *, coalesce(model, 'unknown') as m, coalesce(project, 'unknown') as p, case when len(observed_on) = 1 then observed_on[1] else '@shared' end as dv, case when ts > 0 then strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') end as dy,
    case when ts > 0 then strftime(make_timestamp(ts * 1000000), '%H') end as hr from pr)"""
_SECTIONS = {"by_source": "source", "by_model": "m", "by_project": "p", "by_device": "dv", "daily": "dy", "by_hour": "hr"}
_SQL_MEASURES = f"{SUMS}, {COSTS.replace('cast(sum(priced_tokens) as bigint) as priced_tokens, cast(sum(unpriced_tokens) as bigint) as unpriced_tokens, ', '').replace('as coverage', 'as cost_coverage')}"
_NONE = ", ".join(f"0 as {c}" for c in (*TOKENS, "total", "requests", "sessions", "last_ts", "cost_usd", "cost_coverage"))
_NO_MEASURES = _NONE.replace("0 as total", "{total} as total")


@query("report_json", "with " + _REPORT + f" select 'total' as section, '' as label, '' as name, {_SQL_MEASURES} from x union all select 'today', dy, '', {_SQL_MEASURES} from x where dy = '{AS_OF}' group by dy union all "
       + " union all ".join(f"select '{k}', {c}, {'case when ' + c + chr(61) + chr(39) + '@shared' + chr(39) + ' then ' + chr(39) + 'Shared' + chr(39) + ' else coalesce((select name from device_record d where d.device_id = ' + c + '), ' + c + ') end' if k == 'by_device' else chr(39) * 2}, {_SQL_MEASURES} from x where {c} is not null group by {c}" for k, c in _SECTIONS.items())
       + f" union all select 'devices', device_id, name, {_NO_MEASURES.format(total='coalesce(generated_at, 0)')} from device_record union all select 'unpriced_models', model, '', {_NO_MEASURES.format(total='0')} from (select distinct model from x where model is not null and priced_tokens + unpriced_tokens >= 0 and model not in (select model from rates) and ({PKEY}) not in (select model from rates))"
       + f" union all select 'scan', k, '', {_NO_MEASURES.format(total='v')} from (select unnest(['events', 'duplicates', 'synthetic']) as k, unnest([count(*), count(*) - (count(distinct dedup_key) + count(*) filter (dedup_key is null)), count(*) filter (starts_with(model, '<'))]) as v from raw)")
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """The report is one JSON document; what it says is read back from it, every bucket of every section."""
    doc = checkpointed(json_report(spark, folder)).select(F.parse_json("json").alias("doc"))  # one row, read by each section
    counts = [*TOKENS, "total"]
    schema = "label string, tokens struct<" + ", ".join(f"{t}: bigint" for t in counts) + ">, cost_usd double, cost_coverage double, requests bigint, sessions bigint, last_ts bigint, device string"
    bucket = lambda b, section: [F.lit(section).alias("section"), b["label"].alias("label"), b["device"].alias("name"), *(b["tokens"][t].alias(t) for t in counts), *(b[m].alias(m) for m in ("requests", "sessions", "last_ts", "cost_usd", "cost_coverage"))]
    got = lambda path, kind: F.from_json(F.to_json(F.try_variant_get("doc", path, "variant")), kind)
    out = [doc.select(got(f"$.{k}", schema).alias("b")).where("b.tokens is not null").select(*bucket(F.col("b"), k)) for k in ("total", "today")]
    for k in _SECTIONS:
        rows = doc.select(F.explode(got(f"$.{k}", f"array<struct<{schema.replace(' string', ': string').replace(' struct', ': struct').replace(' double', ': double').replace('requests bigint', 'requests: bigint').replace('sessions bigint', 'sessions: bigint').replace('last_ts bigint', 'last_ts: bigint')}>>")).alias("b"))
        out.append(rows.select(*bucket(F.col("b"), k)).where("requests > 0"))
    empty = {c: F.lit(None).cast("double" if c.startswith("cost") else "bigint") for c in (*counts, "requests", "sessions", "last_ts", "cost_usd", "cost_coverage")}
    other = lambda section, df: df.select(F.lit(section).alias("section"), "label", "name", *((F.col(c) if c in df.columns else v).alias(c) for c, v in empty.items()))
    known = doc.select(F.explode(got("$.devices", "array<struct<id: string, name: string, synced_ts: bigint>>")).alias("d")).select(F.col("d.id").alias("label"), "d.name", F.col("d.synced_ts").alias("total"))
    missing = doc.select(F.explode(got("$.unpriced_models", "array<string>")).alias("label")).withColumn("name", F.lit(None).cast("string"))
    scan = doc.select(F.explode(got("$.scan", "map<string, bigint>")).alias("label", "total")).withColumn("name", F.lit(None).cast("string"))
    for section, df in (("devices", known), ("unpriced_models", missing), ("scan", scan)):
        out.append(other(section, df))
    return reduce(DataFrame.unionByName, out).fillna(0).fillna("")


def _report_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buckets, written once as each part of a report reads them, models without a price, and the scan's numbers."""
    seen = observed(spark, folder)
    return checkpointed(reports.buckets(pricing.priced(seen, rates(spark, folder)))), pricing.unpriced_models(seen, rates(spark, folder)), scan_stats(spark, folder)


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """json: the whole report, with all devices."""
    found, missing, scan = _report_parts(spark, folder)
    return reports.json_document(found, table(spark, folder, "device_record"), missing, scan, AS_OF, NOW)


@query("report_text")
def report_text(spark: SparkSession, folder: str) -> DataFrame:
    """n, line: the report as it is printed."""
    return reports.text_lines(*_report_parts(spark, folder), AS_OF, NOW)


# Devices


@query("device_merge", "with " + OBSERVED + " select id, seq, source, total, array_to_string(observed_on, ',') as observed_on from ob")
def device_merge(spark: SparkSession, folder: str) -> DataFrame:
    return observed(spark, folder).select("id", "seq", "source", "total", F.concat_ws(",", "observed_on").alias("observed_on"))


@query("device_local_only", f"with {EVENTS} select seq, total, '{LOCAL}' as observed_on from ev where device_id = '{LOCAL}'")
def device_local_only(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).where(F.col("device_id") == LOCAL)
    return devices.observed_locally(own, LOCAL).select("seq", "total", F.concat_ws(",", "observed_on").alias("observed_on"))


@query("device_status", "select device_id, name, is_local, coalesce(problem, case when not available then 'unavailable' end) as problem, row_number() over (order by is_local desc, name, device_id) as place from device_record")
def device_status(spark: SparkSession, folder: str) -> DataFrame:
    return devices.status(table(spark, folder, "device_record"))


@query("fn_canonical_id", "with " + OBSERVED + " select seq, id from ids")
def fn_canonical_id(spark: SparkSession, folder: str) -> DataFrame:
    return devices.with_canonical_id(raw(spark, folder)).select("seq", "id")


@query("bundle_export", "with " + OBSERVED + " select device_id, count(*) as events, count(distinct id) as ids, cast(sum(total) as bigint) as total from ids group by device_id")
def bundle_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = devices.exported(raw(spark, folder))
    return rows.groupBy("device_id").agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"), F.sum(F.expr(TOTAL)).alias("total"))


_UNSAFE = r"(coalesce({c}, '') = '' or strlen({c}) > 4096 or regexp_matches({c}, '[\p{{Cc}}\x{{061c}}\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]'))"


_NOT_NAMED = _UNSAFE.replace("4096", "128")


@query("validate_bundle", "with e as (select bundle_id, count(*) filter (" + " or ".join(_UNSAFE.format(c=c) for c in ("id", "model", "session", "project")) + f") as bad from bundle_event group by bundle_id), p as (select bundle_id, case when bundle_version is distinct from 1 then 'version' when not coalesce(regexp_full_match(b.device_id, '[A-Za-z0-9-]{{1,96}}'), false) then 'device id' when b.device_id = '{LOCAL}' then 'local device' when {_UNSAFE.format(c='b.exporter_version')} then 'exporter version' when {_NOT_NAMED.format(c='name')} then 'device name' when bad > 0 then 'unsafe text' end as problem from usage_bundle b left join e using (bundle_id) left join device_record d on d.device_id = b.device_id) select * from p where problem is not null")
def validate_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return devices.bundle_problems(table(spark, folder, "usage_bundle"), table(spark, folder, "bundle_event"), table(spark, folder, "device_record"), LOCAL)


@query("bundle_read", "select source, count(*) as events, cast(sum(input_tokens + output_tokens + cache_read + cache_write_5m + cache_write_1h) as bigint) as total from bundle_event where source = 'claude' group by source")
def bundle_read(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles as JSON documents, read with a fixed schema that refuses anything else; the
    source filter goes to the events before they are unpacked."""
    rows = table(spark, folder, "bundle_event")
    line = rows.select(F.to_json(F.struct("id", "source", "ts", "model", "session", "project", *TOKENS)).alias("json"))
    schema = "id string, source string, ts bigint, model string, session string, project string, " + ", ".join(f"{t} bigint" for t in TOKENS)
    read = line.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*").where("source = 'claude'")
    return read.groupBy("source").agg(F.count("*").alias("events"), F.sum(F.expr(TOTAL)).alias("total"))


@query("project_alias_join", "with " + EVENTS + """, alias as (select project as path, min('alias-' || right(project, 3)) as name from ev where project like '/srv/work/%' group by project)
  select coalesce(a.name, e.project) as project, cast(sum(total) as bigint) as total from ev e left join alias a on a.path = e.project group by 1""")
def project_alias_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder, "project", "total")
    aliases = rows.where(F.col("project").startswith("/srv/work/")).select(F.col("project").alias("path"), F.concat(F.lit("alias-"), F.right("project", F.lit(3))).alias("name")).distinct()
    return devices.aliased(rows, aliases).groupBy("project").agg(F.sum("total").alias("total"))


@query("session_replayable", "with " + OBSERVED + f" select source, session, max(case when list_contains(observed_on, '{LOCAL}') then 1 else 0 end) = 1 as local from ob group by source, session")
def session_replayable(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a session's transcript lies on the local device."""
    return observed(spark, folder).groupBy("source", "session").agg(F.bool_or(F.array_contains("observed_on", LOCAL)).alias("local"))
