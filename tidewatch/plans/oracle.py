"""DuckDB SQL for each registered query (the correctness oracle).

The SQL is written independently of the Spark code: plain SQL over the pre-registered views,
with recursive CTEs where the Spark side uses the parallel scan. ``FEED`` is the derived
feed of FIXTURES.md §5 in DuckDB spelling.
"""

from __future__ import annotations

FEED = """
gaz(i, place, glat, glng) as (values
  (0,'New York',cast(40.7128 as double),cast(-74.0060 as double)),(1,'US',cast(37.0902 as double),cast(-95.7129 as double)),(2,'USA',cast(37.0902 as double),cast(-95.7129 as double)),
  (3,'London',cast(51.5074 as double),cast(-0.1278 as double)),(4,'UK',cast(55.3781 as double),cast(-3.4360 as double)),(5,'Tokyo',cast(35.6762 as double),cast(139.6503 as double)),
  (6,'Japan',cast(36.2048 as double),cast(138.2529 as double)),(7,'Paris',cast(48.8566 as double),cast(2.3522 as double)),(8,'France',cast(46.2276 as double),cast(2.2137 as double)),
  (9,'Sydney',cast(-33.8688 as double),cast(151.2093 as double)),(10,'Australia',cast(-25.2744 as double),cast(133.7751 as double)),(11,'Dubai',cast(25.2048 as double),cast(55.2708 as double)),
  (12,'UAE',cast(23.4241 as double),cast(53.8478 as double)),(13,'Singapore',cast(1.3521 as double),cast(103.8198 as double)),(14,'Mumbai',cast(19.0760 as double),cast(72.8777 as double)),
  (15,'India',cast(20.5937 as double),cast(78.9629 as double)),(16,'São Paulo',cast(-23.5505 as double),cast(-46.6333 as double)),(17,'Brazil',cast(-14.2350 as double),cast(-51.9253 as double)),
  (18,'Moscow',cast(55.7558 as double),cast(37.6173 as double)),(19,'Russia',cast(61.5240 as double),cast(105.3188 as double)),(20,'China',cast(35.8617 as double),cast(104.1954 as double)),
  (21,'Beijing',cast(39.9042 as double),cast(116.4074 as double)),(22,'Germany',cast(51.1657 as double),cast(10.4515 as double)),(23,'Berlin',cast(52.5200 as double),cast(13.4050 as double))),
kw(j, phrase) as (values (0,'Earthquake tremor'),(1,'Flood warning'),(2,'Wildfire blaze'),
  (3,'Election vote'),(4,'Military attack'),(5,'Vaccine outbreak'),(6,'Stocks market'),
  (7,'Machine learning'),(8,'Protest march'),(9,'Carbon climate')),
e0 as (select event_id, ts, user_id, value, cast((props->>'$.k') as int) as k,
  case event_type when 'click' then 'news' when 'error' then 'gdacs'
    when 'purchase' then 'financial' when 'view' then 'wikipedia' end as source_type
  from events),
feed as (select e0.event_id, e0.ts as event_time, e0.source_type, e0.value,
  coalesce(g.place, concat('Zone', cast(k as string))) as place,
  concat(kw.phrase, ' near ', coalesce(g.place, concat('Zone', cast(k as string)))) as title,
  case when source_type = 'financial' then null
    else concat('Report ', cast(k as string), ' on ', lower(kw.phrase), '.') end as description,
  case when k % 3 = 0 then g.glat end as lat,
  case when k % 3 = 0 then g.glng end as lng,
  case k % 5 when 0 then 'POSITIVE' when 1 then 'NEGATIVE' else 'NEUTRAL' end as sentiment,
  concat('{"GPE": ["', coalesce(g.place, concat('Zone', cast(k as string))),
    '"], "ORG": ["Org', cast(user_id % 20 as string), '"]}') as entities,
  e0.user_id
  from e0 left join gaz g on g.i = k % 30 join kw on kw.j = k % 10)
"""

# Per (batch, entity) aggregate: entity once per event, missing source -> 'unknown'.
ENTITY_BATCH = """
ev_ent as (select distinct event_id // 10 as batch, event_id, event_time,
    coalesce(source_type, 'unknown') as source,
    unnest(json_extract_string(entities, '$.*[*]')) as entity
  from feed),
agg as (select batch, entity, count(*) as n_events, list_sort(list_distinct(list(source))) as sources,
    max(event_time) as last_time, cast(count(distinct source) as bigint) as n_sources
  from ev_ent where entity is not null group by batch, entity)
"""

# Counter with reset, folded row by row by a recursive CTE (independent of the Spark scan).
BURST_FOLD = """
steps as (select *, row_number() over (partition by entity order by batch) as rn from agg),
fold(entity, rn, batch, run_after, fired, score) as (
  select entity, rn, batch,
    case when n_sources > 1 or n_events > {T} then 0 else n_events end,
    (n_sources > 1 or n_events > {T}), n_events
  from steps where rn = 1
  union all
  select s.entity, s.rn, s.batch,
    case when s.n_sources > 1 or f.run_after + s.n_events > {T} then 0 else f.run_after + s.n_events end,
    (s.n_sources > 1 or f.run_after + s.n_events > {T}), f.run_after + s.n_events
  from fold f join steps s on s.entity = f.entity and s.rn = f.rn + 1),
alerts as (select f.entity, f.batch, cast(f.score as bigint) as score, s.n_sources, s.sources, s.last_time
  from fold f join steps s on s.entity = f.entity and s.rn = f.rn where f.fired)
"""


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        return str(v)
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _dims():
    from .. import dims
    return dims


def with_feed(*ctes: str, recursive: bool = False) -> str:
    body = ",\n".join([FEED.strip(), *[c.strip() for c in ctes]])
    return ("with recursive " if recursive else "with ") + body + "\n"


def _sql() -> dict[str, str]:
    from .params import PARAMS
    d = _dims()
    q: dict[str, str] = {}
    burst = BURST_FOLD.replace("{T}", str(d.BURST_THRESHOLD))
    stop = _list([w for w in d.STOPWORDS if len(w) > 2])
    kwl = f"kwl(pos, kw, cluster) as (values {_values(d.cluster_keywords())})"
    lex = f"lex(word, v) as (values {_values(d.SENTIMENT_LEXICON)})"
    ent_dict = f"entdict(surface, label) as (values {_values(d.ENTITY_DICTIONARY)})"
    gaz_list = _list([p for p, _, _ in d.GAZETTEER])
    forms = sorted({s_ for s_, _ in d.ENTITY_DICTIONARY}, key=lambda s_: (-len(s_), s_))
    ent_pat = r"\b(" + "|".join(forms) + r")\b"

    def toks(expr):
        return (f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+'), "
                f"lambda t: length(t) > 2 and not list_contains({stop}, t))")

    feed_text = "concat_ws(' ', nullif(title, ''), nullif(description, ''))"

    meta = """
meta as (select a.batch, a.entity, a.score, a.n_sources,
  'META-EVENT DETECTED: ''' || a.entity || '''' as title,
  'Entity ''' || a.entity || ''' exhibited anomalous behavior. Sources involved: '
    || array_to_string(a.sources, ', ') || '. Burst score: ' || cast(a.score as varchar) as description,
  'system_alert' as source_type,
  case when list_contains(a.sources, 'gdacs') then 'NEGATIVE' else 'NEUTRAL' end as sentiment,
  'META_ALERT' as event_cluster, a.last_time as detected_at, true as is_anomaly,
  g.glat as lat, g.glng as lng
from alerts a left join gaz g on g.place = a.entity)
"""
    # cluster per feed event: +1 per matching keyword, best score, tie -> earliest keyword
    cluster = f"""
{kwl},
hits as (select f.event_id, k.pos, k.cluster from feed f join kwl k
  on contains(lower({feed_text}), k.kw)),
cl_scores as (select event_id, cluster, count(*) as n, min(pos) as first_pos from hits group by event_id, cluster),
cl as (select event_id, arg_max(cluster, n * 1000 - first_pos) as event_cluster from cl_scores group by event_id),
processed as (select f.event_id * 2 as seq, f.event_id, f.event_time, f.source_type, f.title, f.description,
  f.sentiment, coalesce(cl.event_cluster, 'general') as event_cluster, f.entities, f.lat, f.lng,
  cast(null as boolean) as is_anomaly, f.event_time + interval 5 second as ingested_at
  from feed f left join cl on cl.event_id = f.event_id)
"""
    live = """
alerts_v as (select (batch * 10 + 9) * 2 + 1 as seq, cast(null as bigint) as event_id, detected_at as event_time,
  source_type, title, description, sentiment, event_cluster, cast(null as varchar) as entities, lat, lng, is_anomaly,
  detected_at + interval 5 second as ingested_at
  from meta),
live as (select * from processed union all by name select * from alerts_v)
"""

    def L(final: str) -> str:
        return with_feed(ENTITY_BATCH, burst, meta, cluster, live, recursive=True) + final

    def P(final: str) -> str:
        return with_feed(cluster) + final

    # ---- flagship and correlation ----
    q["meta_events"] = with_feed(ENTITY_BATCH, burst, meta, recursive=True) + "select * from meta"
    q["entity_sources"] = with_feed(ENTITY_BATCH) + \
        "select batch, entity, n_events, sources, n_sources from agg"
    q["cross_stream"] = q["entity_sources"] + " where n_sources > 1"
    q["burst_counter"] = with_feed(ENTITY_BATCH, burst, recursive=True) + \
        f"select entity, batch, score, n_sources > 1 as is_cross, score > {d.BURST_THRESHOLD} as is_burst from alerts"
    q["burst_state"] = with_feed(ENTITY_BATCH, burst, recursive=True) + \
        "select entity, arg_max(run_after, rn) as run from fold group by entity"
    q["cross_stream_window"] = with_feed("""
ev_ent as (select distinct epoch_us(event_time) // 600000000 as w, event_id,
    coalesce(source_type, 'unknown') as source, unnest(json_extract_string(entities, '$.*[*]')) as entity
  from feed)""") + """
select make_timestamp(w * 600000000) as window_start, entity, count(*) as n_events,
  list_sort(list_distinct(list(source))) as sources, cast(count(distinct source) as bigint) as n_sources
from ev_ent where entity is not null group by w, entity having count(distinct source) > 1
"""
    q["event_entities"] = with_feed() + \
        "select distinct event_id, unnest(json_extract_string(entities, '$.*[*]')) as entity from feed"

    # ---- sources / sinks ----
    q["src_json_events"] = with_feed() + "select * from feed"
    q["sink_fanout"] = q["src_json_events"]
    q["sink_fanout_alerts"] = q["meta_events"]
    q["tail_inserts"] = q["src_json_events"]
    q["backfill_live"] = q["src_json_events"]
    q["alerts_stream"] = q["meta_events"]
    q["cross_stream_live"] = q["cross_stream_window"]
    rows = "(select greatest(10, (max(event_id) + 4) // 4) // 10 * 10 + 3 as r from events)"
    q["bounded_epochs"] = with_feed() + f"""
select event_id // r * r as from_id, min(event_id) as first_id, max(event_id) as last_id, count(*) as n_rows, count(*) as n_sink,
  true as within, true as has_offsets
from feed, {rows} group by event_id // r, r"""
    q["late_rows"] = with_feed(f"""
placed as (select feed.*, event_id // r + case when event_id % 97 = 0 then 2 else 0 end as file from feed, {rows}),
newest as (select file, max(event_time) as t from placed group by file),
marks as (select file, max(t) over (order by file rows between unbounded preceding and 2 preceding) as mark from newest)""") + """
select event_id, event_time, source_type from placed join marks using (file)
where make_timestamp((epoch_us(event_time) // 600000000 + 1) * 600000000) <= mark - interval 10 minute"""
    q["velocity_stream"] = with_feed(f"""
sl as (select cast(floor(epoch_us(event_time) / {int(PARAMS['slot_seconds']) * 1_000_000}.0) as bigint) as slot from feed),
cnt as (select slot, count(*) as n from sl group by slot),
ends as (select min(slot) as lo, max(slot) as hi from sl),
every as (select unnest(generate_series(lo, hi)) as slot from ends)""") + f"""
select make_timestamp(slot * {int(PARAMS['slot_seconds']) * 1_000_000}) as slot_start, coalesce(n, 0) as n
from every left join cnt using (slot)"""
    shapes = """
shapes as (
  select event_id, title, description, 'news' as source_type,
    'category ' || cast(user_id % 5 as varchar) as category,
    place as location, lat, lng, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f+00:00') as "timestamp",
    coalesce(title, '') || ' ' || coalesce(description, '') as _raw_text
  from feed where source_type = 'news'
  union all by name
  select event_id, title, description, 'gdacs' as source_type,
    'type ' || cast(user_id % 3 as varchar) as disaster_type,
    'level ' || cast(user_id % 4 as varchar) as severity,
    place as location, lat, lng, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') as "timestamp",
    coalesce(title, '') || ' ' || coalesce(description, '') as _raw_text
  from feed where source_type = 'gdacs'
  union all by name
  select event_id, title, 'S' || cast(user_id % 5 as varchar) as symbol,
    value - 50.0 as price_change, 'financial' as source_type, place as location, lat, lng,
    strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') as "timestamp", coalesce(title, '') || ' ' as _raw_text
  from feed where source_type = 'financial'
  union all by name
  select event_id, title, 'User' || cast(user_id as varchar) as "user", 'enwiki' as wiki,
    'en.wikipedia.org' as server_name, 'Edit ' || cast(event_id as varchar) as comment,
    strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') as "timestamp",
    cast(floor(value) as bigint) as length_old, cast(floor(value) + 10 as bigint) as length_new,
    'edit' as type, 0 as namespace, 'wikipedia' as source_type,
    coalesce(title, '') || ' ' || 'Edit ' || cast(event_id as varchar) as _raw_text
  from feed where source_type = 'wikipedia')
"""
    q["sink_json_roundtrip"] = with_feed(shapes) + "select * from shapes"
    q["union_feeds"] = with_feed(shapes) + \
        "select *, timezone('UTC', try_cast(\"timestamp\" as timestamptz)) as event_time from shapes"
    q["raw_text"] = with_feed(shapes) + "select event_id, _raw_text from shapes"
    q["enrich_text"] = with_feed(shapes) + \
        "select event_id, concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(comment, '')) as text from shapes"
    q["confidence_const"] = with_feed() + \
        "select event_id, event_time + interval 5 second as ingested_at, cast(0.85 as double) as confidence_score from feed"
    q["poll_since"] = with_feed() + f"""
select event_id, event_time, title from feed
where event_id > (select max(event_id) from feed) - {int(PARAMS['poll_back'])}"""
    q["table_counts"] = with_feed(ENTITY_BATCH, burst, meta, recursive=True) + """
select 'processed_events' as table_name, count(*) as n from feed
union all select 'events', count(*) from events
union all select 'documents', count(*) from documents
union all select 'meta_events', count(*) from meta"""

    sse = """
ek as (select event_id, ts, user_id, event_type, value, cast((props->>'$.k') as int) as k from events),
lines0 as (select event_id,
  ['event: message', 'id: ' || cast(event_id as varchar),
   'data: {"title": "' || (case event_id % 8
        when 0 then 'Talk:Page ' || cast(k as varchar)
        when 1 then 'talk:page ' || cast(k as varchar)
        when 2 then '   '
        when 3 then 'User:Someone' || cast(user_id as varchar)
        else 'Article ' || cast(k as varchar) end)
     || '", "wiki": "' || (case when event_id % 7 = 3 then 'dewiki' else 'enwiki' end) || '"'
     || (case when event_type = 'error' then ', "bot": true' when event_type = 'signup' then '' else ', "bot": false' end)
     || (case when event_type = 'view' then '' else ', "comment": "Edit ' || cast(event_id as varchar) || '"' end)
     || ', "user": "User' || cast(user_id as varchar) || '"'
     || ', "server_name": "en.wikipedia.org", "type": "edit", "namespace": ' || cast(k % 4 as varchar)
     || ', "meta": {"dt": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'
     || ', "length": {"old": ' || cast(cast(floor(value) as bigint) as varchar)
     || ', "new": ' || cast(cast(floor(value) as bigint) + k as varchar) || '}}',
   ''] || (case when event_id % 13 = 0 then ['data: {not json'] else [] end) as arr
  from ek),
lines as (select event_id * 8 + generate_subscripts(arr, 1) - 1 as line_no, unnest(arr) as value from lines0),
payloads as (select line_no, regexp_replace(substr(value, 6), '^\\s+|\\s+$', '', 'g') as j
  from lines where value <> '' and starts_with(value, 'data:')),
edits as (select line_no, j->>'$.title' as title, j->>'$.wiki' as wiki, cast(j->>'$.bot' as boolean) as bot,
  j->>'$.user' as "user", j->>'$.comment' as comment, cast(j->>'$.namespace' as int) as namespace,
  j->>'$.meta.dt' as dt, cast(j->>'$.length.old' as bigint) as length_old,
  cast(j->>'$.length.new' as bigint) as length_new, j->>'$.server_name' as server_name, j->>'$.type' as type
  from payloads where json_valid(j))
"""
    blocked = " or ".join(f"starts_with(title, '{p_}')" for p_ in d.BLOCKED_PREFIXES)
    edit_keep = (f"wiki = 'enwiki' and not coalesce(bot, false) and title is not null "
                 f"and not regexp_full_match(title, '\\s*') and not ({blocked})")
    q["sse_decode"] = "with " + sse.strip() + "\nselect line_no, title, wiki, bot, \"user\", comment, namespace, dt, length_old, length_new from edits"
    q["edit_filter"] = "with " + sse.strip() + f"\nselect line_no, title, wiki, bot from edits where {edit_keep}"
    q["edit_projection"] = "with " + sse.strip() + f"""
select line_no, title, "user", wiki, server_name, coalesce(comment, '') as comment, dt as "timestamp",
  length_old, length_new, type, namespace, 'wikipedia' as source_type,
  coalesce(title, '') || ' ' || coalesce(comment, '') as _raw_text
from edits where {edit_keep}"""

    # ---- live-feed filters and views ----
    q["live_feed"] = L("select seq, event_id, event_time, source_type, title, is_anomaly from live")
    def gap(name, n):
        return f"case when seq % {n} = 0 then '' when seq % {n} = 2 then null else {name} end as {name}"
    q["event_defaults"] = L(f"""
select seq, coalesce(nullif(title, ''), 'Untitled Event') as title, coalesce(nullif(description, ''), '') as body,
  coalesce(nullif(source_type, ''), 'wikipedia') as chart_source, coalesce(source_type, 'unknown') as corr_source,
  coalesce(nullif(event_cluster, ''), 'general') as cluster,
  lower(coalesce(nullif(sentiment, ''), 'neutral')) as sentiment, coalesce(ingested_at, event_time) as shown_time
from (select seq, {gap('title', 22)}, {gap('description', 26)}, {gap('source_type', 14)}, {gap('event_cluster', 10)},
  {gap('sentiment', 34)}, event_time, case when seq % 6 <> 0 then ingested_at end as ingested_at from live)""")
    fsrc = PARAMS["feed_source"]
    term = PARAMS["search_term"].lower()
    feed_f = f"(source_type = '{fsrc}' or source_type = 'system_alert')"
    search = (f"instr(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(entities, '')),"
              f" '{term}') > 0")
    alert = "(coalesce(is_anomaly, false) or coalesce(source_type, '') = 'system_alert')"
    ticker = "(coalesce(is_anomaly, false) or coalesce(sentiment, '') = 'NEGATIVE')"
    level = "case when coalesce(is_anomaly, false) then 'critical' else 'normal' end as level"
    q["feed_filter"] = L(f"select seq, source_type, title from live where {feed_f}")
    q["feed_search"] = L(f"select seq, title from live where {search}")
    q["alert_filter"] = L(f"select seq, title, sentiment from live where {alert}")
    q["ticker_filter"] = L(f"select seq, title, {level} from live where {ticker}")
    q["map_points"] = L("""
select seq, lat, lng, title, source_type,
  case when coalesce(is_anomaly, false) then '#ef4444' when source_type = 'news' then '#3b82f6' else '#8b5cf6' end as color,
  case when coalesce(is_anomaly, false) then 8 else 4 end as radius
from live where lat is not null and lng is not null""")
    q["recent_events"] = P("select event_id, ingested_at, title from processed order by ingested_at desc, event_id desc limit 50")
    q["feed_page"] = L(f"select seq, title, source_type from live where {feed_f} and {search} "
                       "order by seq desc, title desc limit 50")
    q["history_buffer"] = L("select seq, title from live order by seq desc, title desc limit 1000")
    q["alerts_recent"] = L(f"select seq, title from live where {alert} order by seq desc, title desc limit 51")
    q["ticker"] = L(f"select seq, title, {level} from live where {ticker} order by seq desc, title desc limit 20")
    q["active_markers"] = L(f"""
select seq, lat, lng, title from live
where lat is not null and lng is not null
  and event_time > (select max(event_time) from live) - interval {int(PARAMS['marker_seconds'])} second""")
    q["embedding_xy"] = """
select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings
where embedding is not null and len(embedding) >= 2 order by vec_id desc limit 50"""

    # ---- access paths on the processed table ----
    q["by_source_recent"] = P(f"select event_id, event_time, title from processed where source_type = '{PARAMS['source']}'")
    q["by_cluster_confidence"] = P(f"select event_id, event_cluster, cast(0.85 as double) as confidence_score "
                                   f"from processed where event_cluster = '{PARAMS['cluster']}'")
    q["by_sentiment_recent"] = P(f"select event_id, event_time from processed where sentiment = '{PARAMS['sentiment']}'")
    q["time_range"] = with_feed() + (f"select event_id, event_time, source_type from feed where "
                                     f"event_time >= timestamp '{PARAMS['range_lo']}' and event_time < timestamp '{PARAMS['range_hi']}'")
    q["retention"] = with_feed() + (f"select event_id, event_time from feed where event_time >= "
                                    f"(select max(event_time) from feed) - interval {PARAMS['retention'].lower()}")
    q["event_lookup"] = P("select event_id, event_time, title, event_cluster from processed where event_id in ("
                          + ", ".join(map(str, PARAMS["lookup_ids"])) + ")")
    q["index_search_any"] = f"select doc_id from documents where list_has_any({toks('text')}, {_list(PARAMS['token_terms'])})"
    q["index_search_all"] = f"select doc_id from documents where list_has_all({toks('text')}, {_list(PARAMS['common_terms'])})"
    q["token_search"] = f"select doc_id from documents where list_has_any({toks('text')}, {_list(PARAMS['token_terms'])})"
    q["geocode"] = with_feed() + f"""
select f.event_id,
  case when (f.lat is null or f.lng is null) and g.place is not null then g.glat else f.lat end as lat,
  case when (f.lat is null or f.lng is null) and g.place is not null then g.glng else f.lng end as lng
from (select *, list_filter(coalesce(json_extract_string(entities, '$.GPE[*]'), [])
                            || coalesce(json_extract_string(entities, '$.LOC[*]'), []),
                            lambda p: list_contains({gaz_list}, p))[1] as hit from feed) f
left join gaz g on g.place = f.hit"""

    # ---- text ----
    q["tokens"] = f"select doc_id, {toks('text')} as tokens from documents"
    q["word_count"] = f"select doc_id, cast(len({toks('text')}) as bigint) as word_count from documents"

    def topn(src: str, id_col: str) -> str:
        return f"""
tk as (select {id_col}, toks from ({src})),
ex as (select {id_col}, unnest(toks) as keyword, generate_subscripts(toks, 1) as pos from tk),
cnt as (select {id_col}, keyword, count(*) as n, min(pos) as first_pos from ex group by {id_col}, keyword),
ranked as (select {id_col}, cast(row_number() over (partition by {id_col} order by n desc, first_pos) as bigint) as rank,
  keyword, n from cnt)
"""
    q["keywords_topn"] = "with " + topn(f"select doc_id, {toks('text')} as toks from documents", "doc_id").strip() + \
        "\nselect doc_id, rank, keyword, n from ranked where rank <= 5"
    q["keywords_conversations"] = "with " + topn(
        f"select conv_id, turn, {toks('text')} as toks from conversations", "conv_id, turn").strip() + \
        "\nselect conv_id, turn, rank, keyword, n from ranked where rank <= 5"
    q["keyword_counts"] = "with " + topn(f"select doc_id, {toks('text')} as toks from documents", "doc_id").strip() + """
select r.keyword, d.source, count(*) as n from ranked r join documents d on d.doc_id = r.doc_id
where r.rank <= 5 group by rollup (r.keyword, d.source)"""
    q["classify"] = P("select event_id, event_cluster from processed")
    q["classify_docs"] = f"""
with {kwl},
hits as (select d.doc_id, k.pos, k.cluster from documents d join kwl k on contains(lower(d.text), k.kw)),
sc as (select doc_id, cluster, count(*) as n, min(pos) as first_pos from hits group by doc_id, cluster),
cl as (select doc_id, arg_max(cluster, n * 1000 - first_pos) as c from sc group by doc_id)
select d.doc_id, coalesce(cl.c, 'general') as event_cluster from documents d left join cl on cl.doc_id = d.doc_id"""

    def compound_cte(src: str, id_col: str, text: str) -> str:
        return f"""
{lex},
src as ({src}),
w as (select {id_col}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')) as word from src),
sums as (select w.{id_col}, sum(lex.v) as s from w join lex on lex.word = w.word group by w.{id_col}),
comp as (select src.{id_col}, src.{text} as text, coalesce(sums.s, 0) / sqrt(coalesce(sums.s, 0) * coalesce(sums.s, 0) + {d.VADER_ALPHA})
  as compound from src left join sums on sums.{id_col} = src.{id_col})
"""
    cut = d.SENTIMENT_CUTOFF
    label = (f"case when text is null or text = '' then 'neutral' when compound >= {cut} then 'positive' "
             f"when compound <= -{cut} then 'negative' else 'neutral' end")
    q["sentiment_lexicon"] = "with " + compound_cte("select doc_id, text from documents", "doc_id", "text").strip() + \
        f"\nselect doc_id, round(compound, 6) as compound, {label} as sentiment from comp"
    blank = "(text is null or regexp_full_match(text, '[\\s\\x{85}\\p{Z}]*'))"
    q["sentiment_model"] = "with " + compound_cte(
        "select doc_id, text as t, text as full_text from documents",
        "doc_id", "t").strip() + f"""
select c.doc_id, case when {blank.replace('text', 'src.full_text')} then 'NEUTRAL' else upper({label}) end as sentiment
from comp c join src on src.doc_id = c.doc_id"""
    oc = d.OLD_BUCKET_CUTOFF
    marks = f"""
marked as (select e.event_id, true as is_anomaly, bool_or(a.score > {d.BURST_THRESHOLD}) as is_burst
  from ev_ent e join alerts a on a.batch = e.batch and a.entity = e.entity group by e.event_id)"""
    q["sentiment_bucket_old"] = with_feed(ENTITY_BATCH, burst, marks, compound_cte(
        f"select event_id, {feed_text} || ' ' || {_list([w for w, _ in d.SENTIMENT_LEXICON])}[event_id % {len(d.SENTIMENT_LEXICON)} + 1] as t "
        "from feed", "event_id", "t"), recursive=True) + \
        f"""select event_id, case when is_burst then 'burst' when compound > {oc} then 'positive' when compound < -{oc} then 'negative'
  else 'neutral' end as bucket from comp left join marked using (event_id)"""
    q["blank_guard"] = "with " + sse.strip() + f""",
every as (select 'document' as kind, doc_id as id, text from documents
  union all select 'edit', line_no, title from edits)
select kind, id, {blank} as is_blank,
  cast(length(substr(text, 1, {d.MODEL_TEXT_CHARS})) as bigint) as n512,
  cast(length(substr(text, 1, {d.NER_TEXT_CHARS})) as bigint) as n1000
from every"""
    q["embed_hash"] = f"""
with tk as (select doc_id, unnest({toks('text')}) as t from documents),
ids as (select doc_id, cast('0x' || substr(md5(t), 1, 4) as bigint) % 64 as i, count(*) as n from tk group by all),
norms as (select doc_id, sqrt(sum(n * n)) as norm from ids group by doc_id),
cells as (select doc_id, i, norm, unnest(generate_series(0, 63)) as j, n from ids join norms using (doc_id)),
v as (select doc_id, list(x order by j) as embedding from
  (select doc_id, j, cast(sum(case when i = j then n else 0 end) / any_value(norm) as float) as x from cells group by doc_id, j) group by doc_id)
select d.doc_id, case when {blank.replace('text', 'd.text')} then cast([] as float[]) else coalesce(v.embedding, cast([] as float[])) end as embedding
from documents d left join v on v.doc_id = d.doc_id"""
    q["keywords_distinct"] = f"""
select doc_id, case when {blank} then cast([] as varchar[])
  else list_sort(list_distinct({toks('text')})) end as keywords
from documents"""

    def mentions_of(src: str) -> str:
        """Dictionary mentions of (event_id, t) rows, and each label's list."""
        return f"""
{ent_dict},
mx as (select event_id, regexp_extract_all(coalesce(t, ''), '{ent_pat}', 1) as found, t from ({src})),
mm as (select event_id, unnest(found) as surface, generate_subscripts(found, 1) as pos from mx
  where not (t is null or regexp_full_match(t, '[\\s\\x{{85}}\\p{{Z}}]*'))),
ml as (select mm.event_id, mm.pos, mm.surface, e.label from mm join entdict e on e.surface = mm.surface),
lab as (select event_id, label, min(pos) as first_pos, list(surface order by pos) as mentions from ml group by event_id, label)
"""
    mentions = mentions_of(f"select event_id, {feed_text} as t from feed")
    names, n_names = _list([s_ for s_, _ in d.ENTITY_DICTIONARY]), len(d.ENTITY_DICTIONARY)
    q["entities_dict"] = with_feed(mentions_of(
        f"select event_id, concat_ws(' ', nullif(title, ''), nullif(description, ''), {names}[event_id % {n_names} + 1], "
        f"{names}[event_id * 7 % {n_names} + 1]) as t from feed")) + """
select event_id, label, cast(row_number() over (partition by event_id order by first_pos) - 1 as bigint) as label_order,
  mentions from lab"""
    q["entities_encode"] = with_feed() + """
select event_id, replace(replace(entities, '": [', '":['), '], "', '],"') as entities_json from feed"""
    timed = "timezone('UTC', try_cast(\"timestamp\" as timestamptz))"
    enriched = f"""
first_place as (select event_id, arg_min(surface, (label <> 'GPE')::int * 100000 + pos) as place
  from ml where label in ('GPE', 'LOC') and list_contains({gaz_list}, surface) group by event_id),
{compound_cte('select event_id, _raw_text as t from shapes', 'event_id', 't').strip().replace('src as', 'srcx as').replace('from src', 'from srcx').replace('src.', 'srcx.')},
hv as (select event_id, cast('0x' || substr(md5(w), 1, 4) as bigint) % 64 as i, count(*) as n from
  (select event_id, unnest({toks('_raw_text')}) as w from shapes) group by all),
hn as (select event_id, sqrt(sum(n * n)) as norm from hv group by event_id),
hc as (select event_id, i, norm, unnest(generate_series(0, 63)) as j, n from hv join hn using (event_id)),
hx as (select event_id, list(x order by j) as embedding from
  (select event_id, j, cast(sum(case when i = j then n else 0 end) / any_value(norm) as float) as x from hc group by event_id, j) group by event_id),
enriched as (select s.event_id, s.source_type, upper({label.replace('text', 'c.text').replace('compound', 'c.compound')}) as sentiment,
  coalesce(hx.embedding, cast([] as float[])) as embedding,
  '[' || array_to_string(list_transform(list_sort(list_distinct({toks('s._raw_text')})), lambda x: '"' || x || '"'), ',') || ']' as keywords,
  case when (s.lat is null or s.lng is null) and g.place is not null then g.glat else s.lat end as lat,
  case when (s.lat is null or s.lng is null) and g.place is not null then g.glng else s.lng end as lng,
  {timed.replace('"timestamp"', 's."timestamp"')} as event_time
  from shapes s left join comp c on c.event_id = s.event_id left join hx on hx.event_id = s.event_id
  left join first_place f on f.event_id = s.event_id left join gaz g on g.place = f.place)
"""
    raw_mentions = mentions_of("select event_id, _raw_text as t from shapes")
    q["consumer_processed"] = with_feed(shapes, raw_mentions, enriched) + """
select event_id, source_type, sentiment, embedding as embeddings, keywords, lat, lng, event_time from enriched"""
    q["enrich_batch"] = with_feed(shapes, raw_mentions, enriched) + """
select event_id, source_type, sentiment, embedding as embeddings, keywords, lat, lng, event_time + interval 5 second as ingested_at,
  false as has_raw_text from enriched"""
    q["consumer_alerts"] = with_feed(shapes, raw_mentions, f"""
ev_ent as (select distinct s.event_id // 10 as batch, s.event_id, {timed.replace('"timestamp"', 's."timestamp"')} as event_time,
    coalesce(s.source_type, 'unknown') as source, ml.surface as entity from shapes s join ml on ml.event_id = s.event_id),
agg as (select batch, entity, count(*) as n_events, list_sort(list_distinct(list(source))) as sources,
    max(event_time) as last_time, cast(count(distinct source) as bigint) as n_sources
  from ev_ent group by batch, entity)""", burst, meta, recursive=True) + "select * from meta"
    q["entities_struct"] = with_feed() + """
select event_id, loc as locations, list_sort(list_distinct(list_transform(coalesce(json_extract_string(entities, '$.PERSON[*]'), []), lambda x: trim(x)))) as people,
  list_sort(list_distinct(list_transform(coalesce(json_extract_string(entities, '$.ORG[*]'), []), lambda x: trim(x)))) as orgs,
  loc as countries
from (select *, list_sort(list_distinct(list_transform(coalesce(json_extract_string(entities, '$.GPE[*]'), [])
      || coalesce(json_extract_string(entities, '$.LOC[*]'), []), lambda x: trim(x)))) as loc from feed)"""
    q["entities_decode"] = with_feed() + """
select event_id, json_valid(e) as valid,
  case when json_valid(e) then json_extract_string(e, '$.GPE[*]') end as gpe,
  case when json_valid(e) then json_extract_string(e, '$.ORG[*]') end as org
from (select event_id, case when event_id % 17 = 0 then substr(entities, 1, 12) else entities end as e from feed)"""
    q["enrich_event"] = with_feed(cluster.strip(), mentions.strip(), compound_cte(
        f"select event_id, {feed_text} as t from feed", "event_id", "t").strip().replace("src as", "srcx as").replace(
        "from src", "from srcx").replace("src.", "srcx."), f"""
ct as (select event_id, {toks(feed_text)} as clean_text from feed),
kex as (select event_id, unnest(clean_text) as keyword, generate_subscripts(clean_text, 1) as pos from ct),
kcnt as (select event_id, keyword, count(*) as n, min(pos) as first_pos from kex group by event_id, keyword),
kr as (select event_id, keyword, row_number() over (partition by event_id order by n desc, first_pos) as rk from kcnt),
kwtop as (select event_id, list(keyword order by rk) as keywords from kr where rk <= 5 group by event_id),
locs as (select event_id, list_sort(list_distinct(list_transform(flatten(list(mentions)), lambda x: trim(x)))) as locations
  from lab where label in ('GPE', 'LOC') group by event_id)""") + f"""
select p.event_id, ct.clean_text, cast(len(ct.clean_text) as bigint) as word_count, p.event_cluster,
  coalesce(kwtop.keywords, cast([] as varchar[])) as keywords,
  case when c.text is null or c.text = '' then 'neutral' when c.compound >= {cut} then 'positive'
       when c.compound <= -{cut} then 'negative' else 'neutral' end as nlp_sentiment,
  cast(0.85 as double) as confidence_score, coalesce(locs.locations, cast([] as varchar[])) as locations
from processed p join ct on ct.event_id = p.event_id left join kwtop on kwtop.event_id = p.event_id
left join comp c on c.event_id = p.event_id left join locs on locs.event_id = p.event_id"""

    # ---- dashboard ----
    q["total_events"] = L("select count(*) as total_events from live")
    q["events_per_min"] = L("""
select count(*) as total_events,
  cast(floor(count(*) / greatest((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 60000000.0, 1.0) + 0.5) as bigint)
    as events_per_min
from live""")
    ss, ns = int(PARAMS["slot_seconds"]), int(PARAMS["n_slots"])
    vel = f"""
sl as (select cast(floor(epoch_us(event_time) / {ss * 1_000_000}.0) as bigint) as slot from live),
hi as (select max(slot) as hi from sl),
slots as (select i as slot_index, hi.hi - {ns - 1} + i as slot from hi, range(0, {ns}) t(i)),
cnt as (select slot, count(*) as n from sl group by slot),
vel as (select s.slot_index, make_timestamp(s.slot * {ss * 1_000_000}) as slot_start, coalesce(c.n, 0) as n
  from slots s left join cnt c on c.slot = s.slot)
"""
    q["velocity"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, vel, recursive=True) + "select * from vel"
    q["throughput_now"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, vel, recursive=True) + f"""
select slot_start, cast(prev as bigint) as throughput from
  (select slot_index, slot_start, coalesce(lag(n) over (order by slot_index), 0) as prev from vel)
where slot_index = {ns - 1}"""
    q["top_clusters"] = L("""
select cluster, upper(substr(cluster, 1, 1)) || substr(cluster, 2) as label, n from
  (select coalesce(nullif(event_cluster, ''), 'general') as cluster, count(*) as n, min(seq) as first_seq
   from live group by 1) order by n desc, first_seq limit 5""")
    q["sentiment_counts"] = L("""
select l.sentiment, coalesce(c.n, 0) as n from (values ('positive'), ('neutral'), ('negative')) l(sentiment)
left join (select lower(coalesce(nullif(sentiment, ''), 'neutral')) as s, count(*) as n from live group by 1) c
  on c.s = l.sentiment""")
    q["source_counts"] = L("""
select l.source_type, coalesce(c.n, 0) as n from (values ('news'), ('gdacs'), ('financial'), ('wikipedia')) l(source_type)
left join (select coalesce(nullif(source_type, ''), 'wikipedia') as s, count(*) as n from live group by 1) c
  on c.s = l.source_type""")

    def ment(labels):
        parts = " || ".join(f"coalesce(json_extract_string(entities, '$.{x}[*]'), [])" for x in labels)
        return f"""
mlist as (select seq, is_anomaly, {parts} as ents from live where entities is not null and json_valid(entities)),
men as (select seq, is_anomaly, unnest(ents) as entity, generate_subscripts(ents, 1) - 1 as pos from mlist)
"""
    q["top_entities"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, ment(["GPE", "LOC", "ORG", "PERSON"]),
                                  recursive=True) + """
select entity, count(*) as n from men group by entity order by n desc, min(seq * 100000 + pos) limit 20"""
    q["hotspots"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, ment(["GPE", "LOC"]), recursive=True) + """
select place, n, anomalies,
  case when anomalies > 5 then 'EXTREME' when anomalies > 1 then 'ELEVATED' else 'NORMAL' end as threat
from (select entity as place, count(*) as n, count(*) filter (where coalesce(is_anomaly, false)) as anomalies,
        min(seq * 100000 + pos) as first from men group by entity)
order by n desc, first limit 5"""
    flagged = """
live as (select p.* exclude (is_anomaly), k.is_anomaly from processed p left join marked k on k.event_id = p.event_id)
"""
    recent = flagged.replace("p.event_id)", "p.event_id where p.event_time >= "
                             f"(select max(event_time) from processed) - interval {PARAMS['hotspot_span'].lower()})")
    q["hotspots_marked"] = with_feed(ENTITY_BATCH, burst, marks, cluster, recent, ment(["GPE", "LOC"]), recursive=True) + f"""
select place, n, anomalies,
  case when anomalies > 5 then 'EXTREME' when anomalies > 1 then 'ELEVATED' else 'NORMAL' end as threat
from (select entity as place, count(*) as n, count(*) filter (where coalesce(is_anomaly, false)) as anomalies,
        min(seq * 100000 + pos) as first from men group by entity)
order by n desc, first limit {int(PARAMS['hotspot_places'])}"""
    lim = d.MOOD_CLAMP
    mood = f"""
ev as (select cast(floor(epoch_us(event_time) / {ss * 1_000_000}.0) as bigint) as slot, seq,
  lower(coalesce(nullif(sentiment, ''), 'neutral')) as s from live),
per as (select slot, list(s order by seq) as ss from ev group by slot),
bounds as (select min(slot) as lo, max(slot) as hi from ev),
allslots as (select unnest(generate_series(0, hi - lo)) as idx, lo from bounds),
items as (select a.idx, a.lo + a.idx as slot, p.ss from allslots a left join per p on p.slot = a.lo + a.idx),
r(idx, slot, mood) as (
  select idx, slot, coalesce(list_reduce(ss, lambda acc, x: case
      when x = 'positive' then least({lim}, greatest(-{lim}, acc + 1))
      when x = 'negative' then least({lim}, greatest(-{lim}, acc - 1))
      when x = 'neutral' then least({lim}, greatest(-{lim}, acc)) else acc end, cast(0 as bigint)), 0)
  from items where idx = 0
  union all
  select i.idx, i.slot, coalesce(list_reduce(i.ss, lambda acc, x: case
      when x = 'positive' then least({lim}, greatest(-{lim}, acc + 1))
      when x = 'negative' then least({lim}, greatest(-{lim}, acc - 1))
      when x = 'neutral' then least({lim}, greatest(-{lim}, acc)) else acc end, r.mood), r.mood)
  from r join items i on i.idx = r.idx + 1)"""
    line = f"select make_timestamp(slot * {ss * 1_000_000}) as slot_start, cast(mood as bigint) as mood from r"
    q["mood_index"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, mood, recursive=True) + line
    q["mood_stream"] = with_feed("live as (select *, event_id as seq from feed)", mood, recursive=True) + line
    q["batch_stats"] = with_feed() + """
select batch, n_events, first_time, last_time, span_sec,
  case when span_sec > 0 then n_events / span_sec end as events_per_sec
from (select event_id // 10 as batch, count(*) as n_events, min(event_time) as first_time, max(event_time) as last_time,
        (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6 as span_sec from feed group by 1)"""
    q["unread_alerts"] = L(f"select count(*) as unread from live where {alert} "
                           f"and event_time > timestamp '{PARAMS['cleared_at']}'")

    # ---- graph ----
    edges = """
el as (select seq, is_anomaly, json_extract_string(entities, '$.*[*]')[1:3] as f from live
  where entities is not null and json_valid(entities)),
edges as (select 'ev_' || cast(seq as varchar) as src, 'ent_' || entity as dst, pos, entity, is_anomaly from
  (select seq, is_anomaly, unnest(f) as entity, generate_subscripts(f, 1) - 1 as pos from el))
"""
    q["entity_edges"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, edges, recursive=True) + \
        "select src, dst, cast(pos as bigint) as pos from edges"
    q["entity_nodes"] = with_feed(ENTITY_BATCH, burst, meta, cluster, live, edges, recursive=True) + """
select src as node_id, '' as label, case when coalesce(is_anomaly, false) then 10 else 5 end as size,
  case when coalesce(is_anomaly, false) then '#ef4444' else '#10b981' end as color, 'event' as kind
from edges where pos = 0
union all
select distinct dst, entity, 15, cast(null as varchar), 'entity' from edges"""
    q["entity_nodes_marked"] = with_feed(ENTITY_BATCH, burst, marks, cluster, flagged, edges, recursive=True) + """
select src as node_id, '' as label, case when coalesce(is_anomaly, false) then 10 else 5 end as size,
  case when coalesce(is_anomaly, false) then '#ef4444' else '#10b981' end as color, 'event' as kind
from edges where pos = 0
union all
select distinct dst, entity, 15, cast(null as varchar), 'entity' from edges"""
    return q


ORACLE_SQL = _sql()
