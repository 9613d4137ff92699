"""Queries on transcripts as text: which files and lines count, and what the parsers make of them.

The lines are made from the tables, as JSON in the shape of the two sources.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.json_fields import summed
from tokenloom.operators import delivery, manifest, parse_a, parse_b, snapshots
from tokenloom.operators.graph import scratch
from tokenloom.plans.registry import Registry
from tokenloom.sources import files, transcripts
from tokenloom.sources.tables import TOKENS, table

_all = Registry()
query, QUERIES, SQL = _all.query, _all.queries, _all.sql
ROOT = "/data/projects"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all depths, from the files of assistant_record."""
    n, name = F.col("record_no") % 6, F.col("file_name")
    folders = F.when(n == 0, "").when(n == 1, "p1/").when(n == 2, "p1/s1/subagents/").when(n == 3, "p1/s1/subagents/workflows/w/").when(n == 4, "p1/archived_sessions/").otherwise("p1/s1/deeper/")
    rows = table(spark, folder, "assistant_record")
    return rows.select("record_no", "session", F.concat(F.lit(f"{ROOT}/"), folders, name).alias("path"))


_PATHS = f"paths as (select record_no, session, '{ROOT}/' || case record_no % 6 when 0 then '' when 1 then 'p1/' when 2 then 'p1/s1/subagents/' when 3 then 'p1/s1/subagents/workflows/w/' when 4 then 'p1/archived_sessions/' else 'p1/s1/deeper/' end || file_name as path from assistant_record)"


@query("scan_depth_globs", f"with {_PATHS} select record_no, path from paths where record_no % 6 in (1, 2, 3)")
def scan_depth_globs(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, folder).where(transcripts.at_depths(ROOT, F.col("path"))).select("record_no", "path")


@query("scan_recursive_prune", f"with {_PATHS} select record_no, path from paths where record_no % 6 <> 4")
def scan_recursive_prune(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, folder).where(transcripts.not_archived(F.col("path"))).select("record_no", "path")


@query("scan_union_sources", f"with {_PATHS} select 'claude' as source, count(distinct path) as files from paths where record_no % 6 in (1, 2, 3) union all select 'codex', count(distinct path) from paths where record_no % 6 <> 4")
def scan_union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The source is a literal of each branch: a filter on it prunes the other one."""
    a = scan_depth_globs(spark, folder).select(F.lit("claude").alias("source"), "path")
    b = scan_recursive_prune(spark, folder).select(F.lit("codex").alias("source"), "path")
    return a.unionByName(b).distinct().groupBy("source").agg(F.count("*").alias("files"))


@query("replay_path_prune", f"with {_PATHS} select record_no, path from paths where record_no % 6 = 5 or contains(string_split(path, '/')[-1], session) or list_contains(string_split(path, '/'), session)")
def replay_path_prune(spark: SparkSession, folder: str) -> DataFrame:
    session = F.when(F.col("record_no") % 6 == 5, "s1").otherwise(F.col("session"))
    return _paths(spark, folder).where(transcripts.of_session(F.col("path"), session)).select("record_no", "path")


def _raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_record").select("file_no", F.col("file_name").alias("path"), F.col("line_no").alias("line"), F.col("raw_line").alias("value"))


@query("scan_complete_lines", """with n as (select *, row_number() over (partition by file_no order by line_no desc) as back from raw_record)
  select file_no, count(*) as lines, cast(sum(strlen(raw_line)) as bigint) as bytes from n where not (back = 1 and file_no % 3 = 0) group by file_no""")
def scan_complete_lines(spark: SparkSession, folder: str) -> DataFrame:
    """raw_record as real files. Of every third the last line has no line feed, and isn't read, whatever it holds."""
    base = scratch(spark)
    files.write_files(_torn(_raw_lines(spark, folder).withColumn("path", F.format_string("%d.jsonl", "file_no")), F.col("file_no") % 3 == 0), base)
    lines = transcripts.complete(transcripts.read_lines(spark, [base], "claude", recursive=True))
    file_no = F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long")
    return lines.groupBy(file_no.alias("file_no")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).cast("long").alias("bytes"))


def _torn(lines: DataFrame, unfinished: Column) -> DataFrame:
    """`lines` with torn: the last line of the files that are `unfinished`."""
    last = F.max("line").over(Window.partitionBy("path"))
    return lines.withColumn("torn", unfinished & (F.col("line") == last))



# Source A


def lines_a(spark: SparkSession, folder: str, output: Column | None = None) -> DataFrame:
    """assistant_record as transcript lines, with a line of another kind for every fifth. output: in place of output_tokens."""
    usage = F.struct(
        F.col("input_tokens"), (F.col("output_tokens") if output is None else output).alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), (F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cache_creation_input_tokens"),
        F.struct(F.col("cache_write_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    message = F.struct(F.col("message_id").alias("id"), "model", F.when(F.col("has_stop_reason"), "end_turn").alias("stop_reason"), usage.alias("usage"))
    stamp = F.when(F.col("ts") > 0, F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    line = F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), F.col("session").alias("sessionId"), "cwd", message.alias("message"))
    rows = table(spark, folder, "assistant_record").fillna(0, list(TOKENS))
    spoken = rows.select(F.concat(F.lit("/x/projects/-a-b/"), "file_name").alias("path"), (F.col("record_no") * 2).alias("line"), F.to_json(line).alias("value"))
    other = rows.where("record_no % 5 = 0").select(F.concat(F.lit("/x/projects/-a-b/"), "file_name").alias("path"), (F.col("record_no") * 2 - 1).alias("line"), F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("/from/"), F.col("record_no").cast("string")).alias("cwd"))).alias("value"))
    return spoken.unionByName(other)


_A = f"""l as (select record_no * 2 as line, file_name, message_id, model, session, ts, has_stop_reason, cwd, {", ".join(f"coalesce({t}, 0) as {t}" for t in TOKENS)} from assistant_record
    union all select record_no * 2 - 1, file_name, null, null, null, null, null, '/from/' || record_no, 0, 0, 0, 0, 0 from assistant_record where record_no % 5 = 0),
  c as (select *, last_value(cwd ignore nulls) over (partition by file_name order by line) as folder from l)"""
_USAGE_A = f"""select line, coalesce(ts, 0) as ts, trim(model) as model, session, coalesce(case when regexp_replace(trim(folder), '[/\\\\]+$', '') = '' then trim(folder) else regexp_replace(trim(folder), '[/\\\\]+$', '') end, 'a-b') as project,
  {", ".join(TOKENS)}, message_id as dedup_key, case when has_stop_reason then 1 else 0 end as dedup_rank from c where message_id is not null and not starts_with(trim(model), '<') and {" + ".join(TOKENS)} > 0"""


@query("parse_a", f"with {_A} {_USAGE_A}")
def parse_a_usage(spark: SparkSession, folder: str) -> DataFrame:
    return parse_a.usage(lines_a(spark, folder)).drop("path", "source")


@query("scan_prefilter", "select count(*) + count(*) filter (record_no % 5 = 0) as lines, count(*) + count(*) filter (record_no % 5 = 0) as kept from assistant_record")
def scan_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    lines = lines_a(spark, folder)
    return lines.agg(F.count("*").alias("lines"), F.count_if(transcripts.may_bill_a(F.col("value"))).alias("kept"))


@query("window_carry_forward", "with " + _A + " select line, folder from c")
def window_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines_a(spark, folder).select(F.col("path").alias("file"), "line", F.try_variant_get(F.try_parse_json("value"), "$.cwd", "string").alias("folder"))
    return snapshots.carried(rows, "folder").select("line", "folder")


@query("window_first_value", "with " + _A + " select line, first_value(session ignore nulls) over (partition by file_name order by line rows between unbounded preceding and current row) as session from l")
def window_first_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines_a(spark, folder).select(F.col("path").alias("file"), "line", F.try_variant_get(F.try_parse_json("value"), "$.sessionId", "string").alias("session"))
    return snapshots.first_seen(rows, "session").select("line", "session")


# A tree of transcripts, from the files to the roll-up


def _form() -> Column:
    """What a file is an example of: 0 too deep, 1 a sub-agent, 2 a workflow, 4 unfinished."""
    return F.pmod(F.ascii("file_name") + F.ascii(F.substring("file_name", 3, 1)), F.lit(6))


def _tree(spark: SparkSession, folder: str, base: str) -> None:
    """Transcripts of the first source, at the depths that count, too deep, and without line feed at the end."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    lines = lines_a(spark, folder).withColumn("file_name", name)
    below = F.when(_form() == 0, "deep/er/still").when(_form() == 1, "s1/subagents").when(_form() == 2, "s1/subagents/workflows/w").otherwise("")
    path = F.concat(F.lit("projects/-a-b/"), below, F.when(below != "", "/").otherwise(""), name)
    files.write_files(_torn(lines.withColumn("path", path), _form() == 4), base)


_FILE_KIND = "((ascii(file_name) + ascii(substr(file_name, 3, 1))) % 6)"
_SCANNED = f"""{_A.replace("l as (", "every_line as (", 1).split("c as (")[0]} l as (select * from (select *, {_FILE_KIND} as form, row_number() over (partition by file_name order by line desc) as back from every_line) where form <> 0 and not (form = 4 and back = 1)),
  c as (select *, last_value(cwd ignore nulls) over (partition by file_name order by line) as folder from l),
  u as ({_USAGE_A}),
  k as (select * from u qualify row_number() over (partition by dedup_key order by dedup_rank desc, {", ".join(f"{t} desc" for t in ("output_tokens", "input_tokens", "cache_read", "cache_write_5m", "cache_write_1h"))}) = 1)"""


@query("scan_folder", f"""with {_SCANNED} select (select count(distinct file_name) from l) as files, (select count(*) from l) as lines, (select count(*) from u) as events, (select count(*) from u) - (select count(*) from k) as duplicates,
  (select count(*) from l where starts_with(trim(model), '<')) as synthetic, {", ".join(f"(select cast(sum({t}) as bigint) from k) as {t}" for t in TOKENS)}""")
def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files on disk, lines that are complete, events, each message once across files: the scan's numbers and the sums."""
    base = scratch(spark)
    _tree(spark, folder, base)
    lines = transcripts.complete(transcripts.read_lines(spark, [f"{base}/projects/{d}" for d in transcripts.DEPTHS], "claude"))
    usage = parse_a.usage(lines)
    best = [F.col(c) for c in ("dedup_rank", "output_tokens", "input_tokens", "cache_read", "cache_write_5m", "cache_write_1h")]
    kept = delivery.kept(usage, F.lit(""), F.col("dedup_key"), best, F.lit(0), clean=False)
    own = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.message.model", "string"), F.lit(""))
    seen = lines.agg(F.count_distinct("path").alias("files"), F.count("*").alias("lines"), F.count_if(F.trim(own).startswith("<")).alias("synthetic"))
    counted = usage.agg(F.count("*").alias("events"))
    sums = kept.agg(F.count("*").alias("kept"), *(summed(t).alias(t) for t in TOKENS))
    return seen.crossJoin(counted).crossJoin(sums).select("files", "lines", "events", (F.col("events") - F.col("kept")).alias("duplicates"), "synthetic", *TOKENS)


@query("parse_saturated", f"""with {_A.replace("c as (", "l2 as (select * replace (case when line % 14 = 0 then 9223372036854775807 else output_tokens end as output_tokens) from l), c as (").replace("from l)", "from l2)").replace("from l2), c as", "from l), c as")} , u as ({_USAGE_A.replace(" + ".join(TOKENS), " + ".join(f"cast({t} as hugeint)" for t in TOKENS))})
  select dedup_rank, count(*) as requests, count(distinct project) as projects, cast(least(sum(output_tokens), 9223372036854775807) as bigint) as output_tokens, cast(sum(input_tokens) as bigint) as input_tokens from u group by dedup_rank""")
def parse_saturated(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the largest count without sign: it is cut to 64 bits with sign, and sums stop there."""
    huge = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
    lines = lines_a(spark, folder, F.when(F.col("record_no") % 7 == 0, huge).otherwise(F.col("output_tokens").cast("decimal(20,0)")))
    return parse_a.usage(lines).groupBy("dedup_rank").agg(F.count("*").alias("requests"), F.count_distinct("project").alias("projects"), summed("output_tokens").alias("output_tokens"), summed("input_tokens").alias("input_tokens"))


# Source B


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """events as cumulative counters: file by user, lane by type, repeats where the number in
    props is a multiple of 10, no `last` where it is one of 3."""
    k = F.get_json_object("props", "$.k").cast("long")
    by_file = Window.partitionBy("file").orderBy("event_id")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, folder, "events").select(F.col("user_id").alias("file"), "event_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("lane"), k.alias("k"), F.floor(F.abs("value")).cast("long").alias("v"))
    repeat = F.col("k") % 10 == 0
    add = {"input": F.when(repeat, 0).otherwise(F.col("v")), "cached": F.when(repeat, 0).otherwise(F.least(F.col("k"), F.col("v"))), "output": F.when(repeat, 0).otherwise(F.floor(F.col("k") / 2))}
    total = F.struct(*(F.sum(c).over(so_far).alias(n) for n, c in add.items()))
    own = F.when(F.col("k") % 3 != 0, F.struct(*(c.cast("long").alias(n) for n, c in add.items())))
    out = rows.withColumns({"line": F.row_number().over(by_file).cast("long"), "total": total, "own": own})
    return out.select("file", "line", "event_id", "ts", "lane", "k", "total", F.when(repeat, F.lag("own").over(Window.partitionBy("file").orderBy("line"))).otherwise(F.col("own")).alias("last"))


_SNAPSHOTS = """e as (select user_id as file, event_id, ts, case when event_type <> 'error' then event_type end as lane, cast(json_extract(props, '$.k') as bigint) as k, cast(floor(abs(value)) as bigint) as v from events),
  a as (select *, case when k % 10 = 0 then 0 else v end as i, case when k % 10 = 0 then 0 else least(k, v) end as c, case when k % 10 = 0 then 0 else k // 2 end as o from e),
  s as (select *, row_number() over w as line, cast(sum(i) over w as bigint) as ti, cast(sum(c) over w as bigint) as tc, cast(sum(o) over w as bigint) as t_o, case when k % 3 <> 0 then struct_pack(i := i, c := c, o := o) end as own from a window w as (partition by file order by event_id)),
  t as (select *, case when k % 10 = 0 then lag(own) over (partition by file order by line) else own end as last from s),
  g as (select *, ti || ',' || tc || ',' || t_o || '/' || coalesce(cast(last as varchar), '-') as sign from t),
  d as (select *, coalesce(sign = lag(sign) over (partition by file order by line), false) or coalesce(sign = lag(sign) over (partition by file, lane order by line), false) as duplicate,
     coalesce(max(ti) over h, 0) as hi, coalesce(max(tc) over h, 0) as hc, coalesce(max(t_o) over h, 0) as ho from g window h as (partition by file order by line rows between unbounded preceding and 1 preceding)),
  x as (select file, line, event_id, ts, lane, duplicate, case when duplicate then 0 when last is not null then last.i else greatest(ti - hi, 0) end as i, case when duplicate then 0 when last is not null then last.c else greatest(tc - hc, 0) end as c,
     case when duplicate then 0 when last is not null then last.o else greatest(t_o - ho, 0) end as o from d)"""


@query("window_high_water_delta", f"with {_SNAPSHOTS} select file, line, i - least(i, c) as input, least(i, c) as cache_read, o as output from x")
def window_high_water_delta(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.deltas(snapshot_rows(spark, folder)).select("file", "line", "input", "cache_read", "output")


@query("window_duplicate_snapshot", f"with {_SNAPSHOTS} select file, line, lane from x where duplicate")
def window_duplicate_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.deltas(snapshot_rows(spark, folder)).where("duplicate").select("file", "line", "lane")


def lines_b(spark: SparkSession, folder: str) -> DataFrame:
    """The same snapshots as transcript lines, each file opened by its thread and folder."""
    rows = snapshot_rows(spark, folder)
    names = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens"}
    counters = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{k}").alias(n) for k, n in names.items())))
    info = F.struct(counters("total").alias("total_token_usage"), counters("last").alias("last_token_usage"))
    payload = F.struct(F.lit("token_count").alias("type"), info.alias("info"), F.struct(F.col("lane").alias("limit_id")).alias("rate_limits"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    path = F.concat(F.lit("/y/"), F.col("file").cast("string"), F.lit(".jsonl"))
    counts = rows.select(path.alias("path"), (F.col("line") + 2).alias("line"), F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp.alias("timestamp"), payload.alias("payload"))).alias("value"))
    files = rows.select("file").distinct()
    opening = F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("t"), F.col("file").cast("string")).alias("session_id"), F.lit("/meta").alias("cwd")).alias("payload"))
    turn = F.struct(F.lit("turn_context").alias("type"), F.struct(F.lit("Vendor/Model-X-2025-01-02").alias("model"), F.when(F.col("file") % 2 == 0, "/turn/").alias("cwd")).alias("payload"))
    heads = files.select(path.alias("path"), F.lit(1).cast("long").alias("line"), F.to_json(opening).alias("value")).unionByName(files.select(path.alias("path"), F.lit(2).cast("long").alias("line"), F.to_json(turn).alias("value")))
    return counts.unionByName(heads)


@query("parse_b", f"with {_SNAPSHOTS} select line + 2 as line, cast(epoch(date_trunc('second', ts)) as bigint) as ts, 'model-x' as model, 't' || file as session, case when file % 2 = 0 then '/turn' else '/meta' end as project, i - least(i, c) as input_tokens, o as output_tokens, least(i, c) as cache_read from x where i + o > 0")
def parse_b_usage(spark: SparkSession, folder: str) -> DataFrame:
    return parse_b.usage(lines_b(spark, folder)).select("line", "ts", "model", "session", "project", "input_tokens", "output_tokens", "cache_read")


# Which files to read again


def _manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, folder, "raw_record").groupBy("file_no", F.col("file_name").alias("path")).agg((F.count("*") * 100).alias("n"))
    n = F.col("file_no")
    flag = lambda m: F.when(n % m == 0, 1).otherwise(0)
    old = files.where("file_no % 7 <> 0").select("path", n.alias("identity"), F.col("n").alias("offset"), n.alias("modified"))
    new = files.where("file_no % 11 <> 0").select("path", (n + flag(17)).alias("identity"), (F.col("n") + (n % 3) * 10 - flag(13) * 500).alias("size"), (n + flag(5)).alias("modified"))
    return old, new


_FILES = """f as (select file_no, file_name as path, count(*) * 100 as n from raw_record group by all), old as (select path, file_no as identity, n as o, file_no as modified from f where file_no % 7 <> 0),
  new as (select path, file_no + case when file_no % 17 = 0 then 1 else 0 end as identity, n + file_no % 3 * 10 - case when file_no % 13 = 0 then 500 else 0 end as size, file_no + case when file_no % 5 = 0 then 1 else 0 end as modified from f where file_no % 11 <> 0),
  plan as (select path, o, case when size is null then 'Forgotten' when o is null then 'Full' when old.identity <> new.identity or size < o then 'Full' when size > o then 'Append' when old.modified = new.modified then 'Unchanged' else 'Full' end as action from old full join new using (path))"""


@query("manifest_plan", f"with {_FILES} select path, action, case when action = 'Append' then o else 0 end as begin from plan")
def manifest_plan(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.plan(*_manifest(spark, folder))


@query("manifest_changed", f"with {_FILES} select bool_or(action <> 'Unchanged') as changed, count(*) as files from plan")
def manifest_changed(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.plan(*_manifest(spark, folder)).agg(manifest.changed().alias("changed"), F.count("*").alias("files"))


@query("scan_resumed", """with n as (select *, row_number() over (partition by file_no order by line_no) as nth, count(*) over (partition by file_no) as lines from raw_record),
  f as (select file_no, any_value(lines) as lines, case when file_no % 4 = 0 then 'Full' when file_no % 4 = 1 then 'Append' else 'Unchanged' end as action from n group by file_no)
  select f.action, count(distinct file_no) as files, cast(count(*) filter (f.action = 'Full' or f.action = 'Append' and nth > n.lines // 2) as bigint) as lines_read, count(*) as lines_known from n join f using (file_no) group by f.action""")
def scan_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Two scans of raw_record as real files: the first writes the manifest of what it has read; then files have
    come, grown or stayed, and the second reads only what is new. Together they know every line once."""
    base = scratch(spark)
    path = F.format_string("%d.jsonl", "file_no")
    lines = _raw_lines(spark, folder).withColumns({"path": path, "torn": F.lit(False)})
    half = Window.partitionBy("path")
    early = (F.col("file_no") % 4 != 0) & ((F.col("file_no") % 4 != 1) | (F.row_number().over(half.orderBy("line")) <= F.floor(F.count("*").over(half) / 2)))
    files.write_files(lines.withColumn("early", early).where("early"), f"{base}/files")
    first = _scan(files.listing(spark, f"{base}/files"), None, f"{base}/manifest/0", f"{base}/lines/0")
    files.write_files(lines.where("file_no % 4 < 2"), f"{base}/files")
    second = _scan(files.listing(spark, f"{base}/files"), first, f"{base}/manifest/1", f"{base}/lines/1")
    known = spark.read.parquet(f"{base}/lines/0").unionByName(spark.read.parquet(f"{base}/lines/1")).groupBy("path").agg(F.count_distinct("offset").alias("lines_known"))
    read = spark.read.parquet(f"{base}/lines/1").groupBy("path").agg(F.count("*").alias("lines_read"))
    done = second.join(known, "path", "left").join(read, "path", "left").fillna(0, ["lines_known", "lines_read"])
    return done.groupBy("action").agg(F.count("*").alias("files"), F.sum("lines_read").cast("long").alias("lines_read"), F.sum("lines_known").cast("long").alias("lines_known"))


def _scan(listing: DataFrame, before: DataFrame | None, to: str, lines_to: str) -> DataFrame:
    """Reads what `manifest.plan` calls for, writes the lines and then the new manifest, which it returns."""
    spark = listing.sparkSession
    now = listing.withColumn("identity", F.lit(0))
    old = before if before is not None else spark.createDataFrame([], "path string, identity int, offset long, modified long")
    plan = manifest.plan(old.select("path", "identity", "offset", "modified"), now).join(now, "path")
    files.read_from(plan.where("action in ('Full', 'Append')").select("path", "begin", "size")).write.parquet(lines_to)
    plan.select("path", "identity", F.col("size").alias("offset"), "modified", "action").write.parquet(to)
    return spark.read.parquet(to)
