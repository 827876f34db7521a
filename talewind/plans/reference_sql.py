"""DuckDB statements that must give the same rows as the queries of the same name."""

from __future__ import annotations

from talewind.operators.features import BINARIES, EVENT_IDS, EXTENSIONS, FEATURES, PORTS, REGISTRY
from talewind.operators.parse import SUPPORTED
from talewind.operators.retrieval import STOP_WORDS
from talewind.operators.twin import COSTS

EV = rf"""
raw as (select seq, raw_event r, raw_event['EventID'] e, timestamp ts, coalesce(nullif(host, ''), 'Unknown') host, coalesce(event_source_id, '') sid, provider, channel from canonical_events),
num as (select *, case when regexp_full_match(trim(e), '[+-]?\d+(\.\d+)?') then cast(trunc(cast(trim(e) as double)) as int) end eid from raw),
parsed as (select *, case when eid is null then 'malformed' when eid not in {SUPPORTED} then 'no_parser' when e <> cast(eid as varchar) then 'silent_mismatch' when ts is null then 'no_timestamp' end reason from num),
ev as (select seq, eid event_id, ts, host, r, sid, provider, channel from parsed where reason is null)"""


def _r(k: str) -> str:
    return f"r['{k}']"


_SGUID = "coalesce(nullif(r['SourceProcessGUID'], ''), nullif(r['SourceProcessGuid'], ''))"
_TREE = rf"""{EV},
nodes0 as (select host, trim({_r('ProcessGuid')}) guid, seq, ts, case when trim({_r('ParentProcessGuid')}) not in ('', '{{00000000-0000-0000-0000-000000000000}}') then trim({_r('ParentProcessGuid')}) end parent,
  row_number() over (partition by host, trim({_r('ProcessGuid')}) order by ts desc, seq desc) rn from ev where event_id = 1 and trim({_r('ProcessGuid')}) <> ''),
nodes as (select * from nodes0 where rn = 1),
link as (select n.*, p.seq p from nodes n left join nodes p on p.host = n.host and p.guid = n.parent),
walk as (select seq, seq root from link where p is null union all select l.seq, w.root from walk w join link l on l.p = w.seq)"""
_LID = ", ".join(f"case when lower({_r(k)}) not in ('', '0x0', '0x3e7', '0x3e4', '0x3e5') then {_r(k)} end" for k in ("TargetLogonId", "LogonId", "SubjectLogonId"))
_MEMBERS = rf"""{_TREE},
owned as (select seq, root from walk union all select e.seq, w.root from ev e join nodes n on n.host = e.host
  and n.guid = case when e.event_id in (3, 7, 11, 12, 13) then trim({_r('ProcessGuid')}) when e.event_id = 10 then trim({_SGUID}) end join walk w on w.seq = n.seq),
rest as (select seq, host, ts, coalesce({_LID}) lid from ev where seq not in (select seq from owned)),
cut as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by host order by ts, seq) > 300000000 then 1 else 0 end c from rest where lid is null),
part as (select *, sum(c) over (partition by host order by ts, seq rows unbounded preceding) s from cut),
members as (select seq, 'tree' kind, root as session from owned
  union all select seq, 'logon', min(seq) over (partition by host, lid) from rest where lid is not null
  union all select seq, 'gap', min(seq) over (partition by host, s) from part)"""
_TABLE = f"""{_MEMBERS}, tab as (select kind, session, min(host) host, min(epoch_us(ts)) start_us, max(epoch_us(ts)) end_us, count(*) n_events,
  min(case kind when 'tree' then 0 when 'logon' then 1 else 2 end) kind_rank from members join ev using (seq) group by kind, session)"""


def _ext(p: str) -> str:
    return f"case when contains({p}, '.') then split_part({p}, '.', -1) else '' end"


def _c(k: str) -> str:
    return f"coalesce({_r(k)}, '')"


_TG = "coalesce(nullif(r['TargetProcessGUID'], ''), nullif(r['TargetProcessGuid'], ''))"
_EPOCH = "(case when epoch_us(ts) % 1000000 = 0 then (epoch_us(ts) // 1000000) || '.0' else rtrim(cast(cast(epoch_us(ts) as decimal(20,0)) / 1000000 as varchar), '0') end)"
_USER = lambda k: f"coalesce(nullif(r['Target{k}'], ''), nullif(r['Subject{k}'], ''), '')"
_EID = f"""case when event_id = 1 then case when nullif({_r('ProcessGuid')}, '') is not null then 'proc_' || {_r('ProcessGuid')} else 'proc_' || lower(host) || '_' || coalesce({_r('ProcessId')}, 'None') || '_' || printf('%d.%06d', epoch_us(ts) // 1000000, epoch_us(ts) % 1000000) end
 when event_id = 3 then 'net_' || {_c('SourceIp')} || '_' || {_c('DestinationIp')} || '_' || coalesce({_r('SourcePort')}, '0') || '_' || coalesce({_r('DestinationPort')}, '0') || '_' || {_c('Protocol')} || '_' || strftime(ts at time zone 'UTC', '%Y%m%d%H%M')
 when event_id = 7 then 'file_' || lower(host) || '_' || {_c('ImageLoaded')}
 when event_id = 10 then case when {_TG} is not null then 'proc_' || {_TG} else 'proc_' || lower(host) || '_' || coalesce({_r('TargetProcessId')}, 'None') || '_access' end
 when event_id = 11 then 'file_' || lower(host) || '_' || {_c('TargetFilename')}
 when event_id in (12, 13) then 'reg_' || lower(host) || '_' || {_c('TargetObject')}
 when event_id = 4624 then case when {_USER('UserSid')} <> '' then 'user_' || {_USER('UserSid')} else lower('user_' || {_USER('DomainName')} || '\\' || {_USER('UserName')}) end end""".replace("'\\\\'", "'\\'")
_KIND = "case when event_id in (1, 10) then 'process' when event_id = 3 then 'network' when event_id in (7, 11) then 'file' when event_id in (12, 13) then 'registry' when event_id = 4624 then 'user' end"
_PARTS = f"string_split({_c('TargetObject')}, '\\')"
_PATH = f"case when event_id = 7 then {_c('ImageLoaded')} when event_id = 11 then {_c('TargetFilename')} end"
_PAIRS = f"list_filter(string_split({_r('Hashes')}, ','), lambda x: contains(x, '='))"
_HASHES = f"""(select '{{' || string_agg(to_json(k)::varchar || ':' || to_json(v)::varchar, ',' order by i) || '}}' from (select k, v, i, row_number() over (partition by k order by i desc) n
 from (select trim(split_part(p, '=', 1)) k, trim(substr(p, instr(p, '=') + 1)) v, i from (select unnest({_PAIRS}) p, generate_subscripts({_PAIRS}, 1) i))) where n = 1)"""
_ENT = f"""ent as (select seq, ts, host, {_KIND} kind, {_EID} entity_id,
 case when event_id = 1 then {_r('ProcessGuid')} when event_id = 10 then {_TG} end guid,
 case when event_id = 1 then coalesce(try_cast(trim({_r('ProcessId')}) as int), 0) when event_id = 10 then coalesce(try_cast(trim({_r('TargetProcessId')}) as int), 0) end::varchar pid,
 case when event_id = 1 then {_c('Image')} when event_id = 10 then {_c('TargetImage')} end image, case when event_id = 1 then {_r('ParentProcessGuid')} end parent_guid,
 case when event_id = 1 then {_r('CommandLine')} end command_line, case when event_id = 1 then {_r('ParentImage')} when event_id = 10 then {_r('SourceImage')} end parent_image, case when event_id = 1 then {_r('User')} end as "user",
 case when event_id = 1 then {_r('IntegrityLevel')} end integrity, case when event_id = 1 then {_r('Company')} end company, case when event_id = 1 then {_r('OriginalFileName')} end original_filename,
 case when event_id in (1, 7) then {_HASHES} end hashes, case when event_id = 3 then {_c('DestinationIp')} end dest_ip, case when event_id = 3 then case when regexp_full_match({_r('SourcePort')}, '[0-9]+') then cast({_r('SourcePort')} as int) else 0 end end::varchar source_port,
 case when event_id = 3 then {_c('Protocol')} end protocol, case when event_id = 4624 then {_USER('DomainName')} end as "domain", case when event_id = 4624 then {_r('TargetLogonId')} end logon_id, case when event_id = 4624 then {_r('AuthenticationPackageName')} end authentication_package,
 case when event_id = 3 then {_c('SourceIp')} end source_ip, case when event_id = 3 then case when regexp_full_match({_r('DestinationPort')}, '[0-9]+') then cast({_r('DestinationPort')} as int) else 0 end end::varchar dest_port,
 {_PATH} path, case when event_id = 7 then case when lower({_ext(_PATH)}) in ('dll', 'sys') then 'Module' else 'File' end when event_id = 11 then case when lower({_ext(_PATH)}) in ('exe', 'dll', 'sys') then 'Executable' else 'Document' end end as "type",
 case when event_id in (7, 11) then {_ext(_PATH)} end extension, case when event_id in (12, 13) then {_PARTS}[1] end hive,
 case when event_id in (12, 13) then case when event_id = 13 and len({_PARTS}) > 2 then array_to_string({_PARTS}[2:-2], '\\') else array_to_string({_PARTS}[2:], '\\') end end key_path,
 case when event_id = 13 then {_PARTS}[-1] end value_name, case when event_id in (12, 13) then case when {_r('EventType')} in ('DeleteKey', 'DeleteValue') then 'Delete' when event_id = 12 then 'Create' else 'Set' end end operation,
 case when event_id = 4624 then {_USER('UserSid')} end sid, case when event_id = 4624 then {_USER('UserName')} end account,
 case when event_id = 4624 and regexp_full_match({_r('LogonType')}, '[0-9]+') then cast({_r('LogonType')} as int)::varchar end logon_type, case when event_id = 4624 then case when {_r('ElevatedToken')} = '%%1842' then 'true' else 'false' end end elevated
 from ev where event_id not in (4103, 4104))""".replace("'\\\\'", "'\\'")
_PG = f"trim({_c('ParentProcessGuid')})"
_OWN = f"case when nullif({_r('ProcessGuid')}, '') is not null then 'proc_' || {_r('ProcessGuid')} when nullif({_r('ProcessId')}, '') is not null then 'proc_' || lower(host) || '_' || {_r('ProcessId')} || '_' || {_EPOCH} end"
_EDGES = f"""edg0 as (select seq, ts, host, case when event_id = 1 then case when {_PG} not in ('', '{{00000000-0000-0000-0000-000000000000}}') then 'proc_' || {_PG} end
 when event_id = 10 then case when {_SGUID} is not null then 'proc_' || {_SGUID} when nullif({_r('SourceProcessId')}, '') is not null then 'proc_' || lower(host) || '_' || {_r('SourceProcessId')} end
 when event_id in (3, 7, 11, 12, 13) then {_OWN} end src,
 case event_id when 1 then 'spawned' when 3 then 'connected_to' when 7 then 'loaded' when 10 then 'accessed_process' when 11 then 'created_file' else 'modified_registry' end rel from ev where event_id not in (4103, 4104, 4624)),
edg as (select e.seq, e.ts, e.src, e.rel, n.entity_id dst from edg0 e join ent n using (seq) where e.src is not null)"""
_SE = f"""{_MEMBERS}, {_ENT}, {_EDGES},
sent as (select session, kind, entity_id, seq from (select m.session, e.kind, e.entity_id, e.seq, row_number() over (partition by m.session, e.kind, e.entity_id order by e.ts desc, e.seq desc) rn from ent e join members m using (seq)) where rn = 1),
sedg as (select session, src, rel, dst, first_seq from (select m.session, e.src, e.rel, e.dst, e.seq first_seq, row_number() over (partition by m.session, e.src, e.rel, e.dst order by e.ts, e.seq) rn from edg e join members m using (seq)) x
  where rn = 1 and exists (select 1 from sent s where s.session = x.session and s.entity_id = x.src) and exists (select 1 from sent s where s.session = x.session and s.entity_id = x.dst)),
nod as (select session, entity_id, kind, row_number() over (partition by session order by k, entity_id) - 1 node from
 (select session, entity_id, kind, k, row_number() over (partition by session, entity_id order by k) rn from (select *, list_position(['process', 'file', 'registry', 'network', 'user', 'service'], kind) k from sent)) where rn = 1)"""

_BASE = lambda c: rf"case when {c} <> '' then split_part(split_part(lower({c}), '\', -1), '/', -1) end"
_SRC = f"case when event_id = 10 then {_c('SourceImage')} when event_id in (1, 4688) then coalesce({_r('Image')}, {_r('NewProcessName')}, '') end"
_TGT = f"case when event_id = 10 then {_c('TargetImage')} when event_id in (1, 4688) then coalesce({_r('ParentImage')}, {_r('ParentProcessName')}, '') end"
_INPUT = f"""inp as (select kind, session, event_id, ts, {_BASE(_SRC)} si, {_BASE(_TGT)} ti, case when event_id = 7 then {_BASE(_c('ImageLoaded'))} end dll, case when event_id in (1, 4688) then length({_c('CommandLine')}) end cl,
 case when event_id in (3, 5156) then nullif({_r('DestinationIp')}, '') end ip, case when event_id in (3, 5156) then try_cast(trim({_r('DestinationPort')}) as int) end port,
 case when event_id in (12, 13, 14) then lower({_c('TargetObject')}) end reg, case when event_id = 11 and contains({_r('TargetFilename')}, '.') then lower(split_part({_r('TargetFilename')}, '.', -1)) end ext from ev join members using (seq))"""


def _feature_sql() -> dict[str, str]:
    n = lambda cond: f"count(*) filter (where {cond})"
    d = lambda c: f"count(distinct {c})"
    dur = "((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::double)"
    out = {f"proc_{b.removesuffix('.exe')}": f"{n(f"si = '{b}'")} + {n(f"ti = '{b}'")}" for b in BINARIES}
    out |= {f"net_port_{p}": n(f"port = {p}") for p in PORTS} | {f"eid_{i}_count": n(f"event_id = {i}") for i in EVENT_IDS} | {f"file_ext_{x}": n(f"ext = '{x}'") for x in EXTENSIONS}
    out |= {k: n(" or ".join(f"contains(reg, '{p}')" for p in pats)) for k, pats in REGISTRY.items()}
    out |= {
        "process_access_count": n("event_id = 10"), "process_create_count": n("event_id in (1, 4688)"), "image_load_count": n("event_id = 7"), "lsass_targeted_count": n("ti = 'lsass.exe'"), "unique_source_images": d("si"), "unique_target_images": d("ti"),
        "unique_dlls_loaded": d("dll"), "max_command_line_length": "coalesce(max(cl), 0)", "network_fanout": d("ip"), "network_flow_count": n("event_id in (3, 5156)"), "unique_port_count": d("port"), "registry_mod_count": n("event_id in (12, 13, 14)"),
        "file_creation_count": n("event_id = 11"), "unique_event_types": d("event_id"), "failed_login_count": n("event_id = 4625"), "successful_login_count": n("event_id = 4624"),
        "login_frequency": f"{n('event_id in (4624, 4625)')} / (greatest(1.0, {dur}) / 60.0)", "is_off_hours": "case when extract(hour from min(ts) at time zone 'UTC') < 9 or extract(hour from min(ts) at time zone 'UTC') >= 17 then 1 else 0 end", "window_duration": dur}
    return {k: f"cast({out[k]} as double)" for k in FEATURES}


FEAT = f"{_MEMBERS}, {_INPUT}, feat as (select kind, session, {', '.join(f'{s} {k}' for k, s in _feature_sql().items())} from inp group by kind, session)"
PROC = " or ".join(f"proc_{b.removesuffix('.exe')} > 0" for b in BINARIES)

_LAB = """d as (select source || '|' || author scenario_id, lang, unnest(technique_ids) t, case when doc_id % 3 = 0 then lpad((doc_id % 5)::varchar, 3, '0') end sub from documents where author is not null and source is not null),
lab as (select distinct scenario_id, split_part(t, '.', 1) t, case when sub is not null then split_part(t, '.', 1) || '.' || sub end sub from d where t <> ''),
space as (select t technique, count(distinct scenario_id) n_scenarios from lab group by t)"""


def welford(features: dict[str, str], rows: str, entity: str, order: str) -> str:
    w = f"partition by {entity} order by {order} rows between unbounded preceding and 1 preceding"
    z = ", ".join(f"case when count(*) over ({w}) < 2 or coalesce(stddev_samp({c}) over ({w}), 0) < 1e-9 then 0 else ({c} - avg({c}) over ({w})) / stddev_samp({c}) over ({w}) end z_{n}" for n, c in features.items())
    return f"z as (select *, {z} from ({rows}))"


_UV = "select user_id, event_id, epoch_us(ts) us, value, cast(json_extract_string(props, '$.k') as int) k from events"
_UEBA = {"event_count": "n_events", "process_access_count": "process_access_count", "registry_mod_count": "registry_mod_count", "failed_login_count": "failed_login_count", "network_flow_count": "network_flow_count"}
UEBA_SCORED = f"""{FEAT}, tab as (select kind, session, min(host) host, min(ts) st, count(*)::double n_events, min(case kind when 'tree' then 0 when 'logon' then 1 else 2 end) kr from members join ev using (seq) group by kind, session),
{welford(_UEBA, "select f.*, host, st, n_events, kr from feat f join tab using (kind, session)", "host", "st, kr, session")},
sc as (select kind, session, n_events, least(1.0, ({' + '.join(f'least(abs(z_{u}), 10.0)' for u in _UEBA)}) / 5 / 6) s from z)"""

CLS = ["click", "error", "purchase", "signup", "view"]
PRED = f"""w as (select event_id, event_type y, [{', '.join(f'(event_id * {i + 3}) % 97 + 1' for i in range(5))}] w from events),
p as (select event_id, y, list_transform(w, lambda x: x / list_sum(w)::double) pr, w from w),
q as (select *, {CLS}[list_position(w, list_max(w))] pred, list_max(w) / list_sum(w)::double conf from p)"""
_STEP = """s0 as (select user_id u, event_id pos, case when cast(json_extract_string(props, '$.k') as int) % 10 = 0 then '' else event_type end t from events),
s1 as (select *, lag(t) over (partition by u order by pos) b from s0 where t <> ''), s2 as (select u, pos, t from s1 where b is null or b <> t),
s3 as (select * from s2 where u in (select u from s2 group by u having count(*) >= 3)),
pr as (select u, pos, t src, lead(t) over (partition by u order by pos) dst from s3),
m as (select src, dst, count(*) support, min(u * 1000000000 + pos) f from pr where dst is not null group by src, dst),
mx as (select *, support / sum(support) over (partition by src)::double prob from m)"""
_NAMES, _COST = list(COSTS), [round(v * 10) for v in COSTS.values()]
_TWIN = f"""n as (select n_nationkey a from nation), e as (select distinct a src, b dst from (select a, (2 * a + 1) % 25 b from n union all select a, (3 * a + 2) % 25 from n) where a <> b),
g as (select src, dst, {_COST}[(src + dst) % 8 + 1] w from e),
r as (select a st, a node, 0 c from n union select r.st, g.dst, r.c + g.w from r join g on g.src = r.node where r.c + g.w <= 100),
best as (select st as start, node asset, min(c) c from r where st <> node group by st, node)"""

_HYG = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax", "scaled": "l_quantity * 3", "fixed": "7.0", "vmware_tools_flag": "l_tax"}
_MARKS = ("vmware", "virtualbox", "vbox", "theshire", "mordordc", "capture", "harness", "vagrant", "packer")
_HYG_ART = f"regexp_matches(c, '{'|'.join(_MARKS)}')"
# columns in order; one is correlated if an earlier kept one is near it, which the recursion decides one column after the other
_HYGIENE = f"""with recursive t as (select {', '.join(f'({e})::double {c}' for c, e in _HYG.items())} from lineitem),
col as (select i, c from (values {', '.join(f"({i}, '{c}')" for i, c in enumerate(_HYG))}) v(i, c)),
flat as ({' union all '.join(f"select '{c}' c, min({c}) = max({c}) f from t" for c in _HYG)}),
rho as ({' union all '.join(f"select '{a}' a, '{b}' b, coalesce(abs(corr({a}, {b})), 0) r from t" for x, a in enumerate(_HYG) for y, b in enumerate(_HYG) if x < y and 'fixed' not in (a, b))}),
lef as (select row_number() over (order by i) n, c from col join flat using (c) where not f and not {_HYG_ART}),
w as (select 0::bigint n, []::varchar[] kept, []::varchar[] dropped union all
  select w.n + 1, case when near then kept else list_append(kept, c) end, case when near then list_append(dropped, c) else dropped end from
   (select w.*, lef.c, exists (select 1 from rho where b = lef.c and r >= 0.98 and list_contains(w.kept, a)) near from w join lef on lef.n = w.n + 1) w),
fin as (select * from w order by n desc limit 1)
select c as "column", case when {_HYG_ART} then 'artefact' when f then 'constant' when list_contains(kept, c) then 'kept' else 'correlated' end status from col join flat using (c), fin"""
_CHANGED = _TWIN.replace("g as (select src, dst, ", "g0 as (select src, dst, ").replace("from e),\nr as", "from e),\ng as (select src, dst, case when dst = 5 then w * 2.5 else w end w from (select * from g0 where not (src = 1 and dst = 3) and not (src = 24 and dst = 7) union all select 24, 7, 15)),\nr as").replace("0 c from n", "0::double c from n")
_NF = f"""with recursive {_SE}, ea as (select s.session, s.entity_id, s.kind, e.* exclude (seq, ts, host, kind, entity_id) from sent s join ent e using (seq)),
nd as (select nod.session, nod.node, nod.kind, ea.* exclude (session, entity_id, kind) from nod join ea on ea.session = nod.session and ea.entity_id = nod.entity_id and ea.kind = nod.kind),
el as (select e.session, a.node a, b.node b from sedg e join nod a on a.session = e.session and a.entity_id = e.src join nod b on b.session = e.session and b.entity_id = e.dst),
i as (select session, b node, count(*) n from el group by all), o as (select session, a node, count(*) n from el group by all)"""

_TFIDF = rf"""with d as (select doc_id id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}')) t from documents where text is not null),
q as (select item_id id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}')) t from eval_items where text is not null),
dt as (select id, t, count(*) tf from d where t not in {STOP_WORDS} group by all), qt as (select id, t, count(*) tf from q group by all),
v as (select t, ln((1 + (select count(text) from documents))::double / (1 + df)) + 1 idf from (select t, sum(tf) total, count(*) df from dt group by t order by total desc, t limit 4096)),
dw as (select id, t, tf * idf w from dt join v using (t)), qw as (select id, t, tf * idf w from qt join v using (t)),
dn as (select id, sqrt(sum(w * w)) n from dw group by id), qn as (select id, sqrt(sum(w * w)) n from qw group by id),
s as (select qw.id query_id, dw.id doc_id, round(sum(qw.w * dw.w) / (any_value(qn.n) * any_value(dn.n)), 6) s from qw join dw using (t) join dn on dn.id = dw.id join qn on qn.id = qw.id group by all)
select query_id, rk as "rank", doc_id, s score from (select *, row_number() over (partition by query_id order by s desc, doc_id) rk from s) where rk <= 5"""

_EVIDENCE = f"""with ex as (select distinct unnest(technique_ids) technique, doc_id from documents), asked as (select distinct technique from ex where technique is not null),
{_TFIDF.split('with ', 1)[1].split(chr(10) + 'select query_id', 1)[0].replace("select item_id id, unnest(regexp_extract_all(lower(text)", "select technique id, unnest(regexp_extract_all(lower('technique ' || technique)").replace('from eval_items where text is not null', 'from asked')},
top as (select * from (select *, row_number() over (partition by query_id order by s desc, doc_id) rk from s where s > 0) where rk <= 5)
select technique, doc_id, 'exact' how, 1.0::double score from ex where technique is not null
union all select query_id, doc_id, 'similar', s from top where not exists (select 1 from ex where technique = query_id and ex.doc_id = top.doc_id)"""


def _is(cond: str) -> str:
    return f"case when {cond} then 1.0 else 0.0 end::double"


def _node_features() -> dict[str, str]:
    low = lambda c: f"lower(coalesce({c}, ''))"
    hive, hklm = "upper(coalesce(hive, ''))", "(contains(upper(coalesce(hive, '')), 'HKLM') or contains(upper(coalesce(hive, '')), 'LOCAL_MACHINE'))"
    has = lambda c, *ps: "(" + " or ".join(f"contains({low(c)}, '{p}')" for p in ps) + ")"
    sysm, high, tcp = has("integrity", "system"), has("integrity", "high"), has("protocol", "tcp")
    hsh = lambda h: _is(f"contains(coalesce(hashes, ''), '\"{h}\"')")
    return {f"is_{k}": _is(f"kind = '{k}'") for k in ("process", "file", "registry", "network", "user", "service")} | {
        "integ_system": _is(f"kind = 'process' and {sysm}"), "integ_high": _is(f"kind = 'process' and not {sysm} and {high}"), "integ_medium_low": _is(f"kind = 'process' and not {sysm} and not {high}"),
        "is_executable": _is(f"kind = 'file' and ({low('extension')} in ('exe', 'dll', 'sys') or coalesce(\"type\", '') in ('Executable', 'Module'))"),
        "cmd_len_log1p": "round(case when kind = 'process' then ln(1 + length(coalesce(command_line, ''))) else 0 end::double, 6)",
        "process_depth_log1p": "round(case when kind = 'process' and exists (select 1 from nod p where p.session = nd.session and p.kind = 'process' and p.entity_id = 'proc_' || nd.parent_guid) then ln(2) else 0 end::double, 6)",
        "has_sha1": hsh("SHA1"), "has_md5": hsh("MD5"), "has_sha256": hsh("SHA256"), "net_tcp": _is(f"kind = 'network' and {tcp}"), "net_udp": _is(f"kind = 'network' and not {tcp} and {has('protocol', 'udp')}"),
        "reg_hive_hklm": _is(f"kind = 'registry' and {hklm}"), "reg_hive_hkcu": _is(f"kind = 'registry' and not {hklm} and (contains({hive}, 'HKCU') or contains({hive}, 'CURRENT_USER'))"),
        "reg_is_run_key": _is(f"kind = 'registry' and {has('key_path', 'run', 'startup')}"), "reg_is_service_key": _is(f"kind = 'registry' and {has('key_path', 'services')}"),
        "reg_is_defender_exclusion": _is(f"kind = 'registry' and {has('key_path', 'exclusions', 'windows defender')}"), "reg_op_write": _is(f"kind = 'registry' and {has('operation', 'setvalue', 'createkey', 'write', 'modify')}"),
        "reg_path_depth_log1p": "round(case when kind = 'registry' then ln(1 + length(regexp_replace(coalesce(key_path, ''), '[^/\\\\]', '', 'g'))) else 0 end::double, 6)",
        "user_is_elevated": _is("kind = 'user' and elevated = 'true'"), "user_logon_interactive": _is("kind = 'user' and logon_type in ('2', '10')"), "user_logon_network": _is("kind = 'user' and logon_type = '3'"),
        "node_in_degree_log1p": "round(ln(1 + coalesce(i.n, 0)), 6)", "node_out_degree_log1p": "round(ln(1 + coalesce(o.n, 0)), 6)"}


ORACLE = {
    "parse_events": f"with {EV} select seq, event_id, epoch_us(ts) ts_us, host, sid event_source_id, provider, channel from ev",
    "parse_drop_reasons": f"with {EV} select reason, case when reason <> 'malformed' then eid end event_id, count(*) n from parsed where reason is not null group by 1, 2",
    "parse_entities": f"with {EV}, {_ENT} select * exclude (ts, host) from ent",
    "parse_edges": f"with {EV}, {_ENT}, {_EDGES} select seq, src, rel, dst from edg",
    "session_members": f"with recursive {_MEMBERS} select seq, kind, session from members",
    "session_process_tree": f"with recursive {_TREE} select host, guid, l.seq, w.root root_seq, w.root = l.seq is_root, parent is not null and p is null is_orphan from link l left join walk w on w.seq = l.seq",
    "session_table": f"with recursive {_TABLE} select * from tab",
    "session_stats": f"""with recursive {_TABLE} select kind, count(*) sessions, sum(n_events)::bigint as events, avg(n_events) mean_size, quantile_cont(n_events::double, 0.5) median_size, quantile_cont(n_events::double, 0.95) p95_size, max(n_events) max_size, min(n_events) min_size from tab group by kind""",
    "session_ownership": f"with recursive {_MEMBERS} select seq, count(*) n from members group by seq having count(*) > 1",
    "session_top10": f"with recursive {_TABLE} select kind, session, n_events from (select * from tab order by n_events desc, kind, session limit 10) where kind <> 'logon'",
    "session_event_histogram": f"with recursive {_MEMBERS} select kind, session, event_id, count(*) n from members join ev using (seq) group by all",
    "session_entities": f"with recursive {_SE} select session, kind, entity_id, seq from sent",
    "session_edges": f"with recursive {_SE} select session, src, rel, dst, first_seq from sedg",
    "features_all": f"with recursive {FEAT} select * from feat",
    "evidence_filter": f"with recursive {FEAT} select kind, session, (lsass_targeted_count > 0 or process_access_count > 0 or network_flow_count > 0 or registry_mod_count > 0 or failed_login_count > 0 or {PROC}) has_evidence, (registry_mod_count > 0 or failed_login_count > 0 or {PROC}) has_narrow from feat",
    "feature_basename_ext": rf"select lower(split_part(split_part(image, '\', -1), '/', -1)) base, case when image is null then '' else lower({_ext('image')}) end ext, count(*) n from activity_events group by all",
    "dataset_audit": f"with recursive {FEAT}, m as (unpivot (select {', '.join(f'max(abs({c})) {c}' for c in FEATURES)} from feat) on columns(*) into name feature value max_abs) select feature, max_abs, max_abs > 0 active from m",
    "hash_fields": "select proc_key, hashes['SHA1'] sha1, hashes['MD5'] md5, cardinality(hashes)::int n from process_entities where hashes is not null",
    "label_sets": f"with {_LAB} select scenario_id, string_agg(distinct t, ',' order by t) techniques, coalesce(string_agg(distinct sub, ',' order by sub), '') sub_techniques, any_value(tactics) tactics from lab join (select scenario_id, coalesce(string_agg(distinct lang, ',' order by lang), '') tactics from d where t <> '' group by scenario_id) using (scenario_id) group by scenario_id",
    "label_space": f"with {_LAB} select technique, n_scenarios, n_scenarios >= 3 supported from space",
    "label_project": f"""with {_LAB}, x as (select distinct doc_id, case when n_scenarios >= 40 then split_part(t, '.', 1) else 'unsupported_class' end k from (select doc_id, unnest(technique_ids) t from documents) left join space on technique = split_part(t, '.', 1))
select doc_id, coalesce(string_agg(k, ',' order by k), '') projected from documents left join x using (doc_id) group by doc_id""",
    "label_targets": "select doc_id, case when len(list_distinct(technique_ids)) = 1 then technique_ids[1] end train_target, list_min(technique_ids) y_primary from documents",
    "benign_auth": "select 'lanl_auth::' || host activity_id, count(*)::double auth_count, nullif(count(*) filter (where user_key % 3 = 0), 0)::double auth_fail, nullif(count(*) filter (where user_key % 2 = 1 and host <> 'dc'), 0)::double remote_auth from user_entities where host is not null group by host",
    "benign_flows": "select 'cicids::' || (l_orderkey * 10 + l_linenumber) activity_id, l_quantity::double flow_duration, case when l_linenumber = 2 then 0 else l_extendedprice end::double total_fwd_packets, 0::double total_backward_packets, 0::double flow_bytes_s, 0::double flow_packets_s from lineitem where l_returnflag = 'N'",
    "benign_network": "select 'toniot::' || p_partkey activity_id, p_size::double size, case when p_size > 25 then p_retailprice end::double price, null::double p_brand from part where p_partkey % 2 = 0",
    "ueba_welford": f"with {welford({'value': 'value', 'k': 'k'}, _UV, 'user_id', 'us, event_id')} select event_id, round(z_value, 5) z_value, round(z_k, 5) z_k from z",
    "ueba_untrained": f"with {welford({'value': 'value'}, _UV, 'user_id', 'us, event_id')} select user_id, count(*) filter (where 0.6 * least(1.0, least(abs(z_value), 10.0) / 6) + 0.2 >= 0.5) n_anomalous, round(sum(abs(z_value)), 4) sum_z, count(*) filter (where least(abs(z_value), 10.0) > 1) n_contributing from z group by user_id",
    "ueba_sessions": f"with recursive {UEBA_SCORED} select kind, session, round(s, 5) stat_score, 0.6 * s + 0.2 >= 0.5 is_anomalous from sc",
    "hygiene_columns": _HYGIENE,
    "hygiene_corr": " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 5) rho from lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for j, b in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) if i < j),
    "metrics_macro": f"""with {PRED}, k as (select distinct unnest([y, pred]) k from q), c as (select k, (select count(*) from q where y = k and pred = k) tp, (select count(*) from q where y = k) t, (select count(*) from q where pred = k) p from k)
select avg(case when p > 0 then tp / p::double else 0 end) macro_precision, avg(case when t > 0 then tp / t::double else 0 end) macro_recall, avg(case when t + p > 0 then 2 * tp / (t + p)::double else 0 end) macro_f1 from c""",
    "metrics_topk": f"with {PRED}, x as (select event_id, y, unnest(range(1, 6)) i, w from q), o as (select *, row_number() over (partition by event_id order by w[i] desc, i) rk from x) select avg(case when h then 1.0 else 0.0 end)::double top_k_accuracy from (select event_id, bool_or({CLS}[i] = y and rk <= 3) h from o group by event_id)",
    "metrics_ece": f"with {PRED}, b as (select ceil(conf * 10) bin, count(*) n, avg(case when y = pred then 1.0 else 0.0 end) acc, avg(conf) c from q group by 1) select sum(n * abs(acc - c)) / sum(n) ece from b",
    "metrics_brier": f"with {PRED} select avg(list_sum(list_transform(range(1, 6), lambda i: power(pr[i] - case when {CLS}[i] = y then 1 else 0 end, 2)))) brier from p",
    "metrics_confusion": f"with {PRED} select y, {', '.join(f"count(*) filter (where pred = '{c}') as \"{c}\"" for c in CLS)} from q group by y",
    "metrics_majority": "select event_type as label, count(*) n from events group by 1 order by 2 desc, 1 limit 1",
    "dup_vector_audit": "select count(*) n, count(distinct case when lower(trim(scenario_id, chr(9) || ' ')) not in ('', 'unknown', 'n/a') then lower(trim(scenario_id, chr(9) || ' ')) end) n_groups, count(distinct y_primary) n_labels from built_dataset group by event_count, has_evidence having count(*) >= 2",
    "evidence_retention": "select y_primary as label, count(*) n, count(*) filter (where has_evidence) n_evidence from built_dataset group by 1",
    "session_gap_300": "", "session_gap_12h": "",
    "session_gap_audit": """with g as (select user_id, epoch_us(ts) t, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000000.0::double gap from events)
select user_id host, (max(t) - min(t)) / 1000000.0::double duration_s, max(gap) max_gap, avg(gap) mean_gap, quantile_cont(gap, 0.5) median_gap, count(*) filter (where gap > 43200) n_over from g group by user_id""",
    "transition_matrix": f"with {_STEP} select src, dst, support, round(prob, 6) prob from mx",
    "next_step_topk": f"with {_STEP} select src, dst, rk as \"rank\", support from (select *, row_number() over (partition by src order by prob desc, f) rk from mx) where rk <= 3",
    "predict_next": f"""with {_STEP}, k as (select * from (select *, row_number() over (partition by src order by prob desc, f) rk from mx) where rk <= 3)
select src || '.001' technique, string_agg(dst || ':' || support, ',' order by rk) steps from k group by src union all select 'none', ''""",
    "evidence_packages": _EVIDENCE,
    "graph_invalid": "select null::bigint as session, null::varchar problem where false",
    "ueba_contributing": f"with {welford({'value': 'value', 'k': 'k'}, _UV, 'user_id', 'us, event_id')} select event_id, concat_ws(',', case when abs(z_value) > 1 then 'value' end, case when abs(z_k) > 1 then 'k' end) contributing from z",
    "twin_reach": f"with recursive {_TWIN} select start, asset, c / 10.0::double as cost from best",
    "twin_critical": f"with recursive {_TWIN} select start, asset, c / 10.0::double total_cost, rk as \"rank\" from (select *, row_number() over (partition by start order by c, asset) rk from best where asset % 4 <= 1) where rk <= 5",
    "twin_blast_radius": f"with recursive {_TWIN} select n.a as start, count(asset) reachable_count, count(asset) filter (where asset % 4 <= 1) critical_reachable from n left join best on best.start = n.a group by n.a",
    "retrieval_cosine": """with s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) s from embeddings q join embeddings v on true where q.vec_id % 50 = 0)
select query_id, vec_id, s score, rk as "rank" from (select *, row_number() over (partition by query_id order by s desc, vec_id) rk from s) where rk <= 5""",
    "retrieval_tfidf": _TFIDF,
    "retrieval_by_technique": "select distinct unnest(technique_ids) technique, doc_id from documents",
    "graph_node_index": f"with recursive {_SE} select session, entity_id, kind, node from nod",
    "graph_degrees": f"""with recursive {_SE}, el as (select e.session, a.node a, b.node b from sedg e join nod a on a.session = e.session and a.entity_id = e.src join nod b on b.session = e.session and b.entity_id = e.dst)
select session, node, round(ln(1 + (select count(*) from el where el.session = nod.session and el.b = nod.node)), 6) in_log, round(ln(1 + (select count(*) from el where el.session = nod.session and el.a = nod.node)), 6) out_log from nod""",
    "graph_node_features": f"{_NF} select nd.session, nd.node, {', '.join(f'{e} {c}' for c, e in _node_features().items())} from nd left join i on i.session = nd.session and i.node = nd.node left join o on o.session = nd.session and o.node = nd.node",
    "graph_label_map": "select label, row_number() over (order by label) - 1 class_id from (select distinct coalesce(case when k not in ('', 'unknown', 'n/a') then k end, 'unknown') as label from (select lower(trim(scenario_id, chr(9) || chr(10) || chr(13) || ' ')) k from built_dataset))",
    "graph_conflicts": "select count(*) n, count(distinct y_primary) n_labels from built_dataset group by coalesce(event_count, -1), has_evidence having count(distinct y_primary) > 1",
    "parse_times": "select seq, case when seq % 10 = 9 then 'bad_timestamp' end reason, case when seq % 10 < 9 then epoch_us(date_trunc('second', timestamp)) end ts_us from canonical_events where timestamp is not null",
    "session_position": f"with recursive {_TABLE} select kind, session, row_number() over (order by kind_rank, session) - 1 as position from tab",
    "session_tree_stats": f"with recursive {_TREE} select count(*) nodes, count(*) filter (where w.root = l.seq) roots, count(*) filter (where parent is not null and p is null) orphans from link l left join walk w on w.seq = l.seq",
    "twin_request": f"with {_TWIN.split(chr(10) + 'r as')[0].rstrip(',')} select src, dst, {_NAMES}[(src + dst) % 8 + 1] technique, round(w / 10.0, 3)::double weight from g",
    "twin_whatif": f"with recursive {_CHANGED} select start, asset, round(c / 10.0, 3)::double as cost from best",
    "graph_class_weights": "with c as (select y_primary as label, count(*) n from built_dataset group by 1 having count(*) >= 8) select label, n, row_number() over (order by label nulls first) - 1 class_id, round(sum(n) over () / (count(*) over () * n)::double, 6) weight from c",
}
for _n, _g in (("session_gap_300", 300), ("session_gap_12h", 43_200)):
    ORACLE[_n] = f"""with c as (select user_id, epoch_us(ts) t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) > {_g}000000 then 1 else 0 end c from events),
s as (select *, sum(c) over (partition by user_id order by t rows unbounded preceding) s from c) select user_id, min(t) start_us, max(t) end_us, count(*) n_events from s group by user_id, s"""
