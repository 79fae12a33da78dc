"""The same answers in plain SQL, written for a single-node engine without regard to scale."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..operators.bloat import AO_MIN_BLOAT
from ..operators.scope import ANALYZE_DENY_LIST
from .fixtures import DATABASES, database_rows, with_fixtures

CLOCK = "timestamp '2024-01-31 00:00:00'"


def _pretty(size: str) -> str:
    steps = " ".join(
        f"when ({size} >> {bits}) < 20479 then concat(cast((({size} >> {bits}) + 1) >> 1 as varchar), ' {unit}')"
        for bits, unit in ((9, "kB"), (19, "MB"), (29, "GB"))
    )
    return (
        f"case when {size} < 10240 then concat(cast({size} as varchar), ' bytes') {steps} "
        f"when {size} is not null then concat(cast((({size} >> 39) + 1) >> 1 as varchar), ' TB') end"
    )


def _root(name: str) -> str:
    return f"case when instr({name}, '_1_prt_') > 0 then substr({name}, 1, instr({name}, '_1_prt_') - 1) else {name} end"


def _ident(name: str) -> str:
    return f"""concat('"', replace({name}, '"', '""'), '"')"""


def _quoted(schema: str = "schemaname", name: str = "relname") -> str:
    return f"concat({_ident(schema)}, '.', {_ident(name)})"


USER_SCHEMA = "not starts_with(schemaname, 'pg') and not starts_with(schemaname, 'gp')"
LABEL = (
    "case relstorage when 'a' then 'AO row' when 'c' then 'AO column' when 'h' then 'Heap' "
    "when 'x' then 'External' else 'Others' end"
)

SQL: dict[str, str] = {}

# ---- sources and sinks

_LISTED = """
    select line, string_split_regex(line, ' +') as f from {lines}
    where not contains(line, '?') and not starts_with(line, 'total') and not starts_with(line, '/') and trim(line) <> ''
"""
SQL["parse_file_listing"] = f"""
    select f[1] as acl, cast(f[2] as int) as num, f[3] as sysuser, f[4] as sysgroup, cast(f[5] as double) as size,
      strptime(f[6], '%Y-%m-%d_%H:%M:%S') as modtime, f[7] as filename
    from ({_LISTED.format(lines='fx_listing')}) x where len(f) = 7 and try_cast(f[5] as double) is not null
"""
_ENTRY = "not contains(line, '?') and not starts_with(line, 'total') and not starts_with(line, '/') and trim(line) <> ''"
_REJECTED = f"""{_ENTRY} and not (len(f) = 7 and try_cast(f[2] as int) is not null and try_cast(f[5] as double) is not null
      and try_strptime(f[6], '%Y-%m-%d_%H:%M:%S') is not null)"""
_SPLIT = "regexp_split_to_array(line, ' +') as f"
SQL["listing_rejects"] = f"select line from (select line, {_SPLIT} from fx_listing) x where {_REJECTED}"
SQL["rejects_over_limit"] = f"""
    select segid, count(*) as rejects from (select segid, line, {_SPLIT} from fx_seg_listing) x where {_REJECTED}
    group by 1 having count(*) >= 2
"""
SQL["partitioned_log_lines"] = """
    select log_msg, substr(split_part(log_msg, '.csv:', 2), 1, 10) as dt, split_part(log_msg, ':', 1) as host from fx_log
"""
SQL["log_lines"] = "select log_msg from fx_log where substr(split_part(log_msg, '.csv:', 2), 1, 7) = '2024-01'"
SQL["log_lines_between"] = f"select * from ({SQL['partitioned_log_lines']}) p where dt between '2024-01-12' and '2024-01-31'"
SQL["process_list"] = """
    select f[1] as hostname, f[2] as port, f[3] as username, f[4] as dbname, f[5] as masterip, f[6] as sessionid,
      f[7] as segid, f[8] as slicex from (select string_split(proc_line, ' ') as f from fx_proc_lines) x
"""
SQL["segment_union"] = "select reloid, segid, age_int from fx_rel_age"
SQL["append_history"] = """
    select ctime, metric_name, monitor_result, status, cast(cast(ctime as date) as varchar) as dt from fx_history
"""
_LATEST = """
    select metric_name, ctime, monitor_result, status from (
      select *, row_number() over (partition by metric_name order by ctime desc, monitor_result desc, status desc) as rn
      from fx_history) x where rn = 1
"""
SQL["export_metric_text"] = f"select metric_name, monitor_result from ({_LATEST}) l"

# ---- scoping and projections

SQL["schema_scope_all"] = f"select reloid, schemaname from fx_rel where {USER_SCHEMA}"
SQL["schema_scope_include"] = "select reloid, schemaname from fx_rel where schemaname in ('s1', 'pg_catalog')"
SQL["schema_scope_exclude"] = f"select reloid, schemaname from fx_rel where {USER_SCHEMA} and schemaname not in ('s1', 's2')"
_DENIED = ", ".join(f"'{s}'" for s in (*ANALYZE_DENY_LIST, "s3"))
SQL["analyze_scope"] = f"select reloid, schemaname from fx_rel where {USER_SCHEMA} and schemaname not in ({_DENIED})"
_USER_REL = """
    select * from fx_rel_user where reloid > 16384 and (schemaoid > 16384 or schemaname = 'public')
      and not starts_with(schemaname, 'pg_temp_') and relstorage <> 'x' and relkind <> 'f'
"""
SQL["user_relations"] = f"select reloid, schemaname, relname from ({_USER_REL}) u"
SQL["partition_root"] = f"select reloid, {_root('relname')} as root from fx_rel"
SQL["storage_label"] = f"select reloid, {LABEL} as tabletype from fx_rel"
SQL["pretty_size"] = f"""
    select schemaname, relname, segid, {_pretty('b')} as size from (
      select schemaname, relname, segid, cast(sum(size_bytes) as bigint) as b from fx_rel_size group by 1, 2, 3) x
"""
SQL["query_snippet"] = "select doc_id, substr(text, 1, 100) as snippet from documents"

# ---- size

SQL["relation_files"] = """
    select r.reloid, r.relname, r.schemaname, r.relfilenode, f.size_bytes, f.relfilecount, f.max_modtime
    from fx_relfilenode r join (
      select split_part(filename, '.', 1) as node, cast(sum(size_bytes) as bigint) as size_bytes, count(*) as relfilecount,
        cast(max(modtime) as timestamp) as max_modtime from fx_files group by 1) f on r.relfilenode = f.node
"""


SQL["relation_files_by_segment"] = """
    select r.segid, r.datname, r.reloid, r.schemaname, r.relname, r.relfilenode, r.relstorage,
      cast(sum(f.size_bytes) as bigint) as size_bytes, count(*) as relfilecount, cast(max(f.modtime) as timestamp) as max_modtime
    from fx_seg_rels r join fx_seg_files f
      on split_part(f.filename, '.', 1) = r.relfilenode and f.segid = r.segid and f.datname = r.datname
    group by 1, 2, 3, 4, 5, 6, 7
"""


def _schema_size(fixture: str) -> str:
    return f"""
    select schemaname, b as size_bytes, {_pretty('b')} as size from (
      select schemaname, cast(sum(size_bytes) as bigint) as b from {fixture}
      where not starts_with(schemaname, 'pg_temp') group by 1) x
"""


SQL["schema_size"] = _schema_size("fx_temp_size")
SQL["save_report"] = _schema_size("fx_rel_size")
SQL["tablespace_size"] = f"""
    select tsname, b as size_bytes, {_pretty('b')} as size from (
      select coalesce(spcname, 'pg_default') as tsname, cast(sum(size_bytes) as bigint) as b from fx_rel_size group by 1) x
"""
SQL["tablespace_max_files"] = """
    select tsname, cast(max(n) as bigint) as max_segfilenum from (
      select coalesce(spcname, 'pg_default') as tsname, segid, sum(relfilecount) as n from fx_rel_size group by 1, 2) x group by 1
"""


def _top(key: str, expression: str, fixture: str, condition: str, n: int) -> str:
    return f"""
    select {key}, relstorage, b as size_bytes, {_pretty('b')} as size from (
      select {expression} as {key}, relstorage, cast(sum(size_bytes) as bigint) as b from {fixture}
      where {condition} group by 1, 2 order by b desc, 1, 2 limit {n}) x
"""


TABLE = "concat(schemaname, '.', relname)"
SQL["top_append_only"] = _top("tablename", TABLE, "fx_rel_size", "relstorage in ('a', 'c')", 100)
SQL["top_heap"] = _top("tablename", TABLE, "fx_rel_size", "relstorage = 'h'", 50)
SQL["top_partitioned"] = _top(
    "root_partition", _root(TABLE), "fx_rel_size",
    "relstorage in ('a', 'c', 'h') and instr(relname, '_1_prt_') > 0", 100,
)
_BY_CATALOG = """(select l.segid, l.size_bytes, l.relstorage, p.reloid is not null as is_leaf,
        coalesce(p.root_schema, l.schemaname) as schemaname, coalesce(p.root_name, l.relname) as relname
      from fx_leaf_size l left join fx_leaf_parent p on p.reloid = l.reloid) z"""
SQL["top_partitioned_by_catalog"] = _top("root_partition", TABLE, _BY_CATALOG, "is_leaf", 100)
SQL["top_by_access_method"] = f"""
    select tablename, amname, b as size_bytes, {_pretty('b')} as size from (
      select {TABLE} as tablename, 'ao_column' as amname, cast(sum(size_bytes) as bigint) as b from fx_rel_size
      where relstorage = 'c' group by 1 order by b desc, 1 limit 50) x
"""
SQL["top_temp_relations"] = _top(
    "tablename", TABLE, "fx_temp_size", "relstorage in ('a', 'c', 'h') and starts_with(schemaname, 'pg_temp')", 50
)
SQL["top_indexes"] = f"""
    select i.schemaname, i.tablename, i.indexname, i.index_bytes, t.b as table_bytes,
      {_pretty('i.index_bytes')} as index_size, {_pretty('t.b')} as table_size
    from (select * from fx_index order by index_bytes desc, schemaname, tablename, indexname limit 50) i
    left join (select schemaname, relname, cast(sum(size_bytes) as bigint) as b from fx_rel_size group by 1, 2) t
      on t.schemaname = i.schemaname and t.relname = i.tablename
"""
SQL["partition_table_size"] = f"""
    select schemaname, {_root('relname')} as relname,
      cast(sum(case when instr(relname, '_1_prt_') > 0 then size_bytes end) as bigint) as size_bytes
    from fx_rel_size group by 1, 2
"""
SQL["database_size"] = f"""
    select datname, b as size_bytes, {_pretty('b')} as size from (
      select schemaname as datname, cast(sum(size_bytes) as bigint) as b from fx_rel_size
      where schemaname not in ('postgres', 'template0', 'template1') group by 1) x
"""
SQL["retention_plan"] = f"""
    select filename, size_bytes, cast(modtime as timestamp) as modtime, age_days,
      case when (contains(filename, '.log') or contains(filename, '.csv')) and age_days > 30 then 'delete'
           when (ends_with(filename, '.log') or ends_with(filename, '.csv')) and age_days > 5 then 'compress'
           else 'keep' end as action
    from (select *, cast(floor((epoch({CLOCK}) - epoch(modtime)) / 86400) as bigint) as age_days from fx_log_files) x
"""

# ---- skew

_DK = """
    select p.reloid, p.tablename, string_agg(a.attname, ',' order by p.pos) as dk
    from (select reloid, tablename, unnest(distkey) as attnum, generate_subscripts(distkey, 1) as pos from fx_dk) p
    join fx_attr a on a.reloid = p.reloid and a.attnum = cast(p.attnum as int) group by 1, 2
"""
SQL["distribution_key"] = f"""
    select k.reloid, k.tablename, d.dk from fx_dk k left join ({_DK}) d on d.reloid = k.reloid
"""


def _skew(source: str, min_total: int, threshold: float, keys: bool = False) -> str:
    # (max - avg) / avg rounded half up in whole numbers: a double average could fall either side of a half.
    dk = "d.dk" if keys else "cast(null as varchar)"
    join = f"left join ({_DK}) d on d.tablename = t.tablename" if keys else ""
    return f"""
    with per_seg as (
      select {_root(TABLE)} as tablename, segid, cast(sum(size_bytes) as bigint) as b
      from {source} where relstorage <> 'x' group by 1, 2 having sum(size_bytes) > 0),
    per_table as (
      select tablename, count(*) as n, cast(sum(b) as bigint) as total, max(b) as top, avg(b) as mean from per_seg group by 1),
    heaviest as (
      select tablename, segid, row_number() over (partition by tablename order by b desc, segid) as rn from per_seg)
    select t.tablename, 8 as sys_segcount, cast(t.n as int) as data_segcount, h.segid as maxsize_segid, t.top as maxsize_bytes,
      {_pretty('t.top')} as maxsize, (((cast(t.top as hugeint) * t.n - t.total) * 200 + t.total) // (2 * t.total)) / 100.0 as skew, {dk} as dk
    from per_table t join heaviest h on h.tablename = t.tablename and h.rn = 1 {join}
    where t.total > {min_total} and (t.n < 8 or (t.top - t.mean) / t.mean > {threshold})
"""


SQL["skew_check"] = _skew("fx_rel_size", 1 << 30, 0.5, keys=True)
SQL["skew_check_by_catalog"] = _skew(_BY_CATALOG, 1 << 20, 0.1)
SQL["skew_report"] = _skew("fx_rel_size", 1 << 20, 0.02)
SQL["skew_from_files"] = _skew(
    """(select r.schemaname, r.relname, r.relstorage, f.segid, f.size_bytes from fx_seg_rels r
        join fx_seg_files f on split_part(f.filename, '.', 1) = r.relfilenode and f.segid = r.segid and f.datname = r.datname
        where r.relstorage = 'h') s""",
    1 << 20, 0.5,
)
_PROC = """
    select sessionid, max(n) as sess_proc_count from (
      select segid, sessionid, count(*) as n from fx_proc group by 1, 2) x group by 1
"""
SQL["session_process_skew"] = _PROC
SQL["session_process_skew_top"] = f"{_PROC} order by 2 desc, 1 limit 1"
SQL["data_key_skew"] = """
    select 8 as n_shards, count(*) as data_shards, max(n) as max_rows, (max(n) * count(*) - sum(n)) / cast(sum(n) as double) as skew
    from (select l_suppkey % 8 as shard, count(*) as n from lineitem group by 1) x
"""

# ---- bloat

_AO = """
    select reloid, schemaname, tablename, cast(pct as double) as percent_hidden, 100.0 / cast(100.1 - pct as double) as bloat
    from (select reloid, schemaname, tablename,
            cast(case when sum(total) > 0 then round(100 * sum(hidden) / sum(total), 2) else 0 end as decimal(5, 2)) as pct
          from fx_visimap group by 1, 2, 3) x
"""
SQL["ao_bloat"] = _AO


def _heap(min_wasted: int, min_bloat: float) -> str:
    # 27-byte header padded to 4 gives 28; a width already aligned gains nothing.
    def pad(w: str) -> str:
        return f"({w} + 4 - case when {w} % 4 = 0 then 4 else {w} % 4 end)"

    return f"""
    select schemaname, tablename, relpages, live_pages, bloat, wasted_bytes from (
      select schemaname, tablename, relpages, live_pages,
        case when live_pages = 0 then 1000 else round(relpages / live_pages, 1) end as bloat,
        cast(greatest(0, 32768 * (relpages - live_pages)) as bigint) as wasted_bytes
      from (
        select c.schemaname, c.relname as tablename, c.relpages,
          cast(ceil(c.reltuples * ({pad('(s.datawidth + 28)')} + s.maxnull * {pad('s.nullhdr')} + 4) / (32768 - 20.0e0)) as bigint) as live_pages
        from fx_relpages c join (
          select schemaname, tablename,
            cast(sum((1 - cast(null_frac as decimal(10, 6))) * avg_width) as double) as datawidth,
            max(null_frac) as maxnull,
            28 + count(*) filter (where null_frac <> 0) // 8 as nullhdr
          from fx_colstats group by 1, 2) s on s.schemaname = c.schemaname and s.tablename = c.relname) x
      where relpages - live_pages > 2) y
    where wasted_bytes > {min_wasted} and bloat > {min_bloat}
"""


SQL["heap_bloat"] = _heap(1 << 20, 1.0)


def _bloat_report(heap: str) -> str:
    return f"""
    select concat(schemaname, '.', tablename) as tablename, 'h' as relstorage, cast(bloat as double) as bloat from ({heap}) h
    union all
    select concat(schemaname, '.', tablename), 'ao', round(bloat, 2) from ({_AO}) a where bloat > {AO_MIN_BLOAT}
"""


SQL["bloat_report"] = _bloat_report(SQL["heap_bloat"])
SQL["catalog_bloat"] = """
    select a.catalog, cast(coalesce(a.row_count, 0) as bigint) as row_count, a.size_total, a.size_coordinator, a.size_seg0,
      c.compact_bytes, round(a.size_coordinator / cast(nullif(c.compact_bytes, 0) as double), 4) as bloat
    from (select catalog, sum(row_count) filter (where segid = -1) as row_count, cast(sum(size_bytes) as bigint) as size_total,
            cast(sum(size_bytes) filter (where segid = -1) as bigint) as size_coordinator,
            cast(sum(size_bytes) filter (where segid = 0) as bigint) as size_seg0 from fx_cat_seg group by 1) a
    left join fx_catsize c on c.catalog = a.catalog
"""

# ---- catalog inventory

SQL["object_counts"] = """
    select 'tables' as object, count(*) as n from fx_rel where relkind = 'r'
    union all select 'views', count(*) from fx_rel where relkind = 'v'
    union all select 'partitions', count(*) from fx_rel where relispartition
    union all select 'namespaces', count(distinct schemaname) from fx_rel
    union all select 'relations', count(*) from fx_rel
    union all select 'attributes', count(*) from fx_attr
"""
SQL["storage_by_schema"] = f"""
    select schemaname, {LABEL} as tabletype, count(*) as n from fx_rel where relkind = 'r' and {USER_SCHEMA} group by 1, 2
"""
SQL["storage_totals"] = f"""
    select {LABEL} as tabletype, count(*) as n from fx_rel where relkind = 'r' and {USER_SCHEMA} group by 1
"""
SQL["storage_by_access_method"] = f"""
    select schemaname, case relstorage when 'h' then 'heap' else 'ao_column' end as tabletype, count(*) as n
    from fx_rel where relkind in ('r', 'p') and relstorage in ('h', 'c') and {USER_SCHEMA} group by 1, 2
    union all
    select schemaname, 'foreign table', count(*) from fx_rel where relkind = 'f' and {USER_SCHEMA} group by 1, 2
"""
SQL["subpartition_counts"] = """
    select concat(schemaname, '.', tablename) as tablename, count(*) as sub_count from (
      select distinct schemaname, tablename, partitionschemaname, partitiontablename from fx_parts) x
    group by 1 order by 2 desc, 1 limit 100
"""
SQL["partition_schema_mismatch"] = """
    select distinct concat(schemaname, '.', tablename) as tablename,
      concat(partitionschemaname, '.', partitiontablename) as partitiontablename
    from fx_parts where schemaname <> partitionschemaname
"""
SQL["default_partition_rows"] = """
    select concat(partitionschemaname, '.', partitiontablename) as tablename, count(*) as row_count
    from fx_parts where partitionisdefault group by 1
"""
SQL["operation_history"] = """
    select o.objid, o.actionname, o.statime, r.relname as objname
    from fx_ops o join fx_rel r on r.reloid = o.objid where r.schemaname = 'pg_catalog'
"""
SQL["settings_report"] = """
    select name, array_to_string(setconfig, ',') as setting from fx_settings where setconfig is not null
"""
SQL["owner_settings"] = """
    select 'database' as kind, s_name as name, array_to_string(setconfig, ',') as setting
    from fx_owner_settings f join supplier s on s.s_suppkey = f.setdatabase where f.setrole = 0
    union all
    select 'role', s_name, array_to_string(setconfig, ',')
    from fx_owner_settings f join supplier s on s.s_suppkey = f.setrole where f.setdatabase = 0
"""
SQL["maintenance_targets"] = f"""
    select schemaname, relname, concat('VACUUM ANALYZE ', {_quoted()}, ';') as statement
    from fx_rel where schemaname = 'pg_catalog' and relkind = 'r' and relstorage <> 'x'
"""

# ---- change detection

SQL["data_tables"] = f"""
    with deepest as (select schemaname, tablename, max(partitionlevel) as maxlevel from fx_partlevel group by 1, 2),
    hidden as (
      select p.schemaname, p.partitiontablename as relname from fx_partlevel p join deepest d
        on d.schemaname = p.schemaname and d.tablename = p.tablename and d.maxlevel <> p.partitionlevel
      union select schemaname, tablename from deepest)
    select u.reloid, u.schemaname, u.relname from ({_USER_REL}) u
    left join hidden h on h.schemaname = u.schemaname and h.relname = u.relname
    where u.relkind = 'r' and h.relname is null
"""
SQL["data_tables_by_catalog"] = f"""
    select reloid, schemaname, relname from ({_USER_REL}) u
    where relkind = 'r' and not relhassubclass and relstorage in ('a', 'c')
"""
SQL["leaf_partitions"] = """
    select distinct p.schemaname, p.tablename, p.partitionlevel, p.partitiontablename from fx_partlevel p join (
      select schemaname, tablename, max(partitionlevel) as maxlevel from fx_partlevel group by 1, 2) d
      on d.schemaname = p.schemaname and d.tablename = p.tablename and d.maxlevel = p.partitionlevel
"""
SQL["mod_counts"] = """
    select r.reloid, cast(coalesce(sum(a.modcount), 0) as bigint) as modcount
    from fx_rel r left join fx_aoseg a on a.reloid = r.reloid group by 1
"""
_MOVED = """
    select n.reloid, n.modcount, case when o.reloid is null then 'new' else 'changed' end as reason
    from fx_modcount_new n left join fx_modcount_old o on o.reloid = n.reloid
    where (o.reloid is null or o.modcount <> n.modcount)
"""
SQL["changed_tables_before_analyze"] = _MOVED
_CHANGED = f"""{_MOVED} and not (o.reloid is not null and exists (
      select 1 from fx_ops p where p.objid = n.reloid and p.actionname = 'ANALYZE' and p.statime >= timestamp '2000-01-01 00:00:00'))
"""
SQL["changed_tables"] = _CHANGED
_STALE = """
    select r.reloid, r.schemaname, r.relname, o.last_analyze from fx_rel r left join (
      select objid, max(statime) as last_analyze from fx_ops where actionname = 'ANALYZE' group by 1) o on o.objid = r.reloid
    where r.relkind = 'r' and r.relstorage = 'h' and not r.relhassubclass
      and (o.last_analyze is null or timestamp '2001-08-01 00:00:00' - o.last_analyze > interval '3' day)
"""
SQL["stale_stats"] = _STALE
SQL["analyze_worklist"] = f"""
    select *, concat('ANALYZE ', {_quoted()}, ';') as statement from (
      select reloid, schemaname, relname, 'stale' as reason from ({_STALE}) s
      union all
      select c.reloid, r.schemaname, r.relname, c.reason from ({_CHANGED}) c
      join fx_rel r on r.reloid = c.reloid where r.relstorage in ('a', 'c')) x
"""
SQL["refresh_state"] = f"""
    select reloid, modcount, timestamp '2000-01-01 00:00:00' as last_checktime from fx_modcount_old o
    where o.reloid not in (select reloid from ({_CHANGED}) c)
      and o.reloid in (select reloid from fx_rel where relkind = 'r')
    union all select reloid, modcount, timestamp '2001-08-01 00:00:00' from ({_CHANGED}) c
"""
SQL["state_snapshot"] = SQL["refresh_state"]
SQL["root_partitions"] = f"""
    select reloid, schemaname, relname, concat('ANALYZE ROOTPARTITION ', {_quoted()}, ';') as statement
    from fx_rel where relkind = 'r' and relstorage <> 'x' and relhassubclass
"""

# ---- wraparound age

SQL["database_age"] = "select datname, age_int from fx_db_age where segid = -1"
SQL["database_age_top"] = "select datname, age_int from fx_db_age where segid = -1 order by age_int desc, datname limit 1"
SQL["segment_age"] = """
    select segid, datname, age_int from fx_db_age where segid >= 0 order by age_int desc, segid, datname limit 50
"""


def _high_age(wanted: str) -> str:
    return f"""
    select r.reloid, r.schemaname, r.relname, max(a.age_int) as age_int from fx_rel_age a join fx_rel r on r.reloid = a.reloid
    where a.age_int > 300000000 and a.age_int <> 2147483647 and r.relkind = 'r' and r.relstorage <> 'x' and {wanted}
    group by 1, 2, 3 order by 4 desc, 1 limit 8000
"""


SQL["high_age_relations"] = _high_age("(r.relhassubclass or instr(r.relname, '_1_prt_') = 0)")
SQL["high_age_partitions"] = _high_age("not r.relhassubclass and instr(r.relname, '_1_prt_') > 0")
SQL["high_age_auxiliary"] = """
    select r.reloid, r.schemaname, r.relname, max(x.age_int) as age_int from (
      select l.relid, a.age_int from fx_aux_age a join fx_aux_link l on l.segrelid = a.auxoid and a.relkind = 'o'
        where a.age_int > 300000000 and a.age_int <> 2147483647
      union all select l.relid, a.age_int from fx_aux_age a join fx_aux_link l on l.visimaprelid = a.auxoid and a.relkind = 'm'
        where a.age_int > 300000000 and a.age_int <> 2147483647
      union all select l.relid, a.age_int from fx_aux_age a join fx_aux_link l on l.blkdirrelid = a.auxoid and a.relkind = 'b'
        where a.age_int > 300000000 and a.age_int <> 2147483647) x
    join fx_rel r on r.reloid = x.relid group by 1, 2, 3 order by 4 desc, 1 limit 3000
"""
SQL["freeze_worklist"] = f"""
    select *, concat('VACUUM FREEZE ', {_quoted()}, ';') as statement from (
      select *, 'tables' as list from ({SQL['high_age_relations']}) a
      union all select *, 'partitions' from ({SQL['high_age_partitions']}) b
      union all select *, 'auxiliary' from ({SQL['high_age_auxiliary']}) c) x
"""
SQL["high_age_databases"] = """
    select distinct datname from fx_db_age where age_int > 300000000 and datname in ('db0', 'db1', 'db2')
"""

# ---- sessions and locks

_ACTIVE = "count(*) filter (where state = 'active')"
_WAITING = "count(*) filter (where state = 'active' and waiting)"
_IDLE_TX = "count(*) filter (where state = 'idle in transaction')"
_LONGEST = (
    f"coalesce(cast(round_even((epoch_us({CLOCK}) - epoch_us(min(query_start) filter (where state = 'active'))) / 1e6 / 60.0, 0) "
    "as bigint), 0)"
)
SQL["active_sql"] = f"select {_ACTIVE} as active_sql from fx_activity"
SQL["waiting_sql"] = f"select {_WAITING} as waiting_sql from fx_activity"
SQL["connections"] = "select count(*) as connections from fx_activity"
SQL["idle_in_transaction"] = f"select {_IDLE_TX} as idle_in_transaction from fx_activity"
SQL["longest_sql_minutes"] = f"select {_LONGEST} as longest_sql_minutes from fx_activity"
SQL["session_metrics"] = f"""
    select 'active_sql' as metric_name, {_ACTIVE} as result from fx_activity
    union all select 'waiting_sql', {_WAITING} from fx_activity
    union all select 'connections', count(*) from fx_activity
    union all select 'idle_in_transaction', {_IDLE_TX} from fx_activity
    union all select 'longest_sql_minutes', {_LONGEST} from fx_activity
"""
SQL["long_idle_transactions"] = f"""
    select * from fx_activity where state = 'idle in transaction'
      and ({CLOCK} - xact_start > interval '1' day or {CLOCK} - coalesce(state_change, query_start) > interval '1' day)
"""
SQL["long_queries"] = f"""
    select pid, sess_id, usename, state, waiting, query_start, xact_start, state_change, substr(query, 1, 100) as query
    from fx_activity where state = 'active' and {CLOCK} - query_start > interval '1' day
"""
_IDLE = f"""
    select *, state as reason from fx_activity
    where (state = 'idle in transaction' and {CLOCK} - state_change > interval '3' hour)
       or (state = 'idle' and {CLOCK} - state_change > interval '12' hour)
"""
SQL["idle_session_candidates"] = _IDLE
SQL["idle_session_candidates_by_start"] = f"""
    select *, state as reason from fx_activity
    where (state = 'idle in transaction' and {CLOCK} - xact_start > interval '1' hour)
       or (state = 'idle' and {CLOCK} - query_start > interval '24' hour)
"""
_BLOCKED = f"""
    select w.relation as lock_table, w.lockmode as wait_lockmode, w.usename as wait_user, w.pid as wait_procpid,
      w.xact_start as wait_start, (epoch_us({CLOCK}) - epoch_us(w.xact_start)) / 1e6 as wait_seconds,
      count(*) over (partition by w.relation, w.pid) as n_holders,
      h.lockmode as run_lockmode, h.usename as run_user, h.pid as run_procpid, h.xact_start as xact_start,
      (epoch_us({CLOCK}) - epoch_us(h.xact_start)) / 1e6 as xact_seconds,
      row_number() over (partition by w.relation, w.pid order by h.xact_start, h.pid) as rn
    from fx_locks w join fx_locks h on h.relation = w.relation and w.xact_start > h.xact_start
    where not w.granted and h.granted and w.lockmode <> 'ShareLock' and h.lockmode <> 'ShareLock'
"""
SQL["lock_sessions"] = """
    select l.relation, l.pid, l.lockmode, l.granted, a.usename, a.state, a.waiting, a.xact_start, a.query
    from fx_lock_rows l join fx_lock_activity a on a.pid = l.pid
    where l.locktype = 'relation' and l.segid = -1 and l.relation > 16384
"""
SQL["lock_wait_pairs"] = f"""
    with s as ({SQL['lock_sessions']})
    select w.relation as lock_table, w.lockmode as wait_lockmode, w.usename as wait_user, w.pid as wait_procpid, w.xact_start as wait_start,
      epoch_us(timestamp '2001-08-01 00:00:00' - w.xact_start) / 1e6 as wait_seconds, w.query as wait_sql,
      h.lockmode as run_lockmode, h.usename as run_user, h.pid as run_procpid, h.xact_start as xact_start,
      epoch_us(timestamp '2001-08-01 00:00:00' - h.xact_start) / 1e6 as xact_seconds, h.query as run_sql, h.state as run_state
    from s w join s h on h.relation = w.relation and h.xact_start < w.xact_start and h.granted and h.lockmode <> 'ShareLock'
    where not w.granted and w.waiting and w.pid in (select pid from fx_lock_activity where waiting order by pid limit 5)
"""
SQL["lock_waits"] = f"select * exclude (rn) from ({_BLOCKED}) b where rn = 1"
SQL["longest_lock_wait"] = f"""
    select lock_table, run_user, run_procpid, wait_user, wait_procpid,
      cast(round_even(wait_seconds / 60.0, 0) as bigint) as wait_minutes
    from ({_BLOCKED}) b where rn = 1 order by wait_start, wait_procpid limit 1
"""
SQL["top_workfile"] = """
    select pid, sess_id, usename, segid, round(size_bytes / 1073741824.0, 2) as workfile_gb
    from fx_workfile order by size_bytes desc, pid limit 1
"""
SQL["resource_group_totals"] = """
    select cast(coalesce(sum(num_running), 0) as bigint) as running, cast(coalesce(sum(num_queueing), 0) as bigint) as queueing
    from fx_resgroup
"""
SQL["resource_queue_counts"] = """
    select count(*) filter (where resqstatus = 'running') as running, count(*) filter (where resqstatus = 'waiting') as waiting
    from fx_resq
"""
_ORPHANS = """
    select nspname, sess_id from (
      select distinct nspname, try_cast(regexp_extract(nspname, '^pg_(?:toast_)?temp_([0-9]+)$', 1) as bigint) as sess_id
      from fx_namespace) n
    where sess_id is not null and not exists (select 1 from fx_activity a where a.sess_id = n.sess_id)
"""
SQL["orphan_temp_schemas"] = _ORPHANS

# ---- statements

SQL["remediation_reorganize"] = f"""
    select tablename, concat('ALTER TABLE ', q, ' SET WITH (reorganize=true); ANALYZE ', q, ';') as statement from (
      select tablename, {_quoted("split_part(tablename, '.', 1)", "substr(tablename, instr(tablename, '.') + 1)")} as q
      from ({SQL['bloat_report']}) r) x
"""
SQL["remediation_freeze"] = f"""
    select reloid, concat('VACUUM FREEZE ', {_quoted()}, ';') as statement from ({SQL['high_age_relations']}) r
"""
SQL["remediation_analyze"] = f"select reloid, concat('ANALYZE ', {_quoted()}, ';') as statement from ({_STALE}) r"
SQL["remediation_drop_schema"] = f"""
    select nspname, concat('DROP SCHEMA IF EXISTS ', {_ident('nspname')}, ' CASCADE;') as statement from ({_ORPHANS}) r
"""
SQL["remediation_terminate"] = f"""
    select pid, concat('SELECT pg_terminate_backend(', pid, ');') as statement from ({_IDLE}) r
"""

# ---- cluster

SQL["segments_down"] = """
    select count(*) as n, cast(count(*) > 0 as int) as result from fx_segconf where status = 'd'
"""
SQL["segments_out_of_sync"] = """
    select count(*) as n, cast(count(*) > 0 as int) as result from fx_segconf where mode <> 's' and content >= 0
"""
SQL["role_switched"] = """
    select count(*) as n, cast(count(*) > 0 as int) as result from fx_segconf where preferred_role <> role
"""
SQL["cluster_shape"] = """
    select count(distinct hostname) as segment_hosts, count(*) filter (where preferred_role = 'p') as primary_segments
    from fx_segconf where content > -1
"""
SQL["host_lists"] = """
    select distinct 'all' as list, hostname from fx_segconf
    union all select distinct 'coordinator', hostname from fx_segconf where content = -1
    union all select distinct 'segment', hostname from fx_segconf where content > -1
"""
SQL["recent_config_changes"] = """
    select * from fx_history order by ctime desc, metric_name, monitor_result, status limit 50
"""

# ---- logs

def _match(pattern: str) -> str:
    return f"regexp_extract(log_msg, '{pattern}', 1)"


_HOST = _match("^([^:]*):")
_FILE = _match("^[^:]*:([^:]*):")
_TIME = _match("[.]csv:([^,]*),")
_SESSION = _match("^(?:[^,]*,){9}([^,]*)")
_PID = f"try_cast({_match('^(?:[^,]*,){3}p([0-9]+),')} as int)"
_MESSAGE = _match("[.]csv:(.*)$")
_SOURCE = f"{_HOST} as hostname, {_FILE} as logfilename, {_TIME} as logtime"


def _ts(text: str) -> str:
    """Logged time without its zone."""
    return f"try_cast(regexp_replace({text}, ' [A-Z]+$', '') as timestamp)"


_PANIC = f"""
    select {_SOURCE}, {_PID} as pid, {_SESSION} as sess_id, {_MESSAGE} as logmsg
    from fx_log where contains(log_msg, '"PANIC"') and not contains(log_msg, 'EXECUTE E')
"""
_TERM = f"""
    select {_SOURCE}, try_cast(regexp_extract(log_msg, '\\(PID (\\d+)\\)', 1) as int) as pid, {_MESSAGE} as logmsg
    from fx_log where contains(log_msg, 'was terminated by signal') and not contains(log_msg, 'EXECUTE E')
"""
_UNEXPLAINED = f"""
    select t.* from ({_TERM}) t where not exists (
      select 1 from ({_PANIC}) p where p.hostname = t.hostname and p.logfilename = t.logfilename and p.pid = t.pid)
"""
SQL["panic_events"] = _PANIC
SQL["terminated_events"] = _TERM
SQL["terminated_without_panic"] = _UNEXPLAINED


def _session_tail(n: int) -> str:
    return f"""
    select sess_id, ts, log_msg, cast(rn as int) as line_no from (
      select sess_id, ts, log_msg, row_number() over (partition by sess_id order by ts desc, log_msg desc) as rn from (
        select {_SESSION} as sess_id, {_ts(_TIME)} as ts, log_msg from fx_log) l
      where sess_id in (select sess_id from ({_PANIC}) p)) x where rn <= {n}
"""


SQL["session_log_tail"] = _session_tail(100)
SQL["session_log_tail_short"] = _session_tail(10)


def _process_tail(n: int) -> str:
    return f"""
    select hostname, logfilename, pid, logtime, cast(rn as int) as line_no, log_msg from (
      select t.hostname, t.logfilename, t.pid, t.logtime, l.log_msg,
        row_number() over (partition by t.hostname, t.logfilename, t.pid, t.logtime order by l.ts desc, md5(l.log_msg) desc) as rn
      from (select distinct hostname, logfilename, pid, logtime, {_ts('logtime')} as ts from ({_UNEXPLAINED}) u) t
      join (select {_SOURCE}, {_PID} as pid, {_ts(_TIME)} as ts, log_msg from fx_log) l
        on l.hostname = t.hostname and l.logfilename = t.logfilename and l.pid = t.pid and l.ts <= t.ts) x
    where rn <= {n}
"""


SQL["process_log_tail"] = _process_tail(50)
SQL["process_log_tail_short"] = _process_tail(2)
_MATCHES = f"""
    select hostname, pattern, ts from (
      select {_HOST} as hostname, log_msg, {_ts(_TIME)} as ts from fx_log) l
    join (values ('master_panic', '"PANIC"'), ('segment_panic', '"PANIC"'),
      ('internal_error', 'internal error'), ('out_of_memory', 'Out of memory')) p(pattern, mark)
      on contains(l.log_msg, p.mark)
    where (pattern <> 'master_panic' or hostname = 'host0') and (pattern <> 'segment_panic' or hostname <> 'host0')
"""
_BY_HOST = f"""
    select hostname, pattern, count(*) as matches from ({_MATCHES}) m
    where ts >= timestamp '2024-01-01 00:00:00' group by 1, 2
"""
SQL["pattern_counts_by_host"] = _BY_HOST
SQL["log_metrics_since_last_check"] = f"""
    select {CLOCK} as ctime, c.metric_name, cast(count(m.ts) as varchar) as monitor_result, 2 as status
    from (
      select p.pattern, p.metric_name, coalesce(max(h.ctime), {CLOCK}) as since
      from (values ('master_panic', 'gpdb_check_master_panic'), ('segment_panic', 'gpdb_check_segment_panic'),
        ('internal_error', 'gpdb_check_internal_error'), ('out_of_memory', 'gpdb_check_oom')) p(pattern, metric_name)
      left join fx_log_checks h on h.metric_name = p.metric_name and h.ctime < {CLOCK} group by 1, 2) c
    left join ({_MATCHES}) m on m.pattern = c.pattern and m.ts >= c.since group by c.metric_name
"""
SQL["pattern_counts"] = f"""
    select p.pattern, cast(coalesce(sum(h.matches), 0) as bigint) as matches, cast(count(h.hostname) > 0 as int) as result,
      coalesce(string_agg(h.hostname, ',' order by h.hostname), '') as hosts
    from (values ('master_panic'), ('segment_panic'), ('internal_error'), ('out_of_memory')) p(pattern)
    left join ({_BY_HOST}) h on h.pattern = p.pattern group by 1
"""

# ---- monitoring and privileges

SQL["latest_metrics"] = _LATEST
_WAITED = f"{CLOCK} - last_finishtime > check_interval * interval '1' minute"
SQL["due_metrics"] = f"""
    select monitor_id, metric_name,
      case when status = 0 then true when status in (2, 3) then coalesce({_WAITED}, true) else false end as due,
      case when status not in (0, 1, 2, 3) then 'invalid status' end as error,
      status = 1 and coalesce({_WAITED}, false) as stuck
    from fx_setup
"""
SQL["start_checks"] = f"""
    select s.monitor_id, case when d.due then 1 else s.status end as status,
      case when d.due then {CLOCK} else cast(s.last_finishtime as timestamp) end as last_finishtime
    from fx_setup s join ({SQL['due_metrics']}) d on d.monitor_id = s.monitor_id
"""
SQL["record_results"] = f"""
    select s.metric_name, coalesce(l.status, s.status) as status,
      case when l.metric_name is not null then {CLOCK} else cast(s.last_finishtime as timestamp) end as last_finishtime
    from fx_metric_setup s left join ({_LATEST}) l on l.metric_name = s.metric_name
"""
SQL["reset_checks"] = "select monitor_id, 0 as status, cast(null as timestamp) as last_finishtime from fx_setup"
SQL["drop_expired"] = f"select * from fx_history where ctime >= {CLOCK} - interval '14' day"
SQL["file_inventory"] = f"""
    select concat(metric_name, '.txt') as filename, cast(strlen(monitor_result) as bigint) as size_bytes, p.hostname, p.segid
    from ({_LATEST}) l, (values ('h1', 0), ('h1', 1), ('h2', null)) p(hostname, segid)
"""
SQL["apply_retention"] = f"select * from fx_history where ctime >= {CLOCK} - interval '14' day"
SQL["evaluate_alerts"] = f"""
    select l.metric_name, l.monitor_result, s.warning_value,
      coalesce(try_cast(l.monitor_result as double) >= try_cast(s.warning_value as double), false) as alert
    from ({_LATEST}) l join fx_alert_setup s on s.metric_name = l.metric_name where s.if_warning
"""


def _metric(name: str, sql: str, value: str) -> str:
    return f"select '{name}' as metric_name, cast({value} as varchar) as monitor_result from ({sql}) m"


_METRICS = [
    ("gpdb_segment_down", SQL["segments_down"], "result"),
    ("gpdb_primary_mirror_sync_state", SQL["segments_out_of_sync"], "result"),
    ("gpdb_segment_role_switch", SQL["role_switched"], "result"),
    ("gpdb_workfile_usage_per_query", SQL["top_workfile"], "cast(workfile_gb as decimal(18, 2))"),
    ("gpdb_check_lock_tables", SQL["longest_lock_wait"], "wait_minutes"),
    ("gpdb_total_sql", SQL["active_sql"], "active_sql"),
    ("gpdb_total_waiting_sql", SQL["waiting_sql"], "waiting_sql"),
    ("gpdb_total_connections", SQL["connections"], "connections"),
    ("gpdb_total_idle_in_transaction", SQL["idle_in_transaction"], "idle_in_transaction"),
    ("gpdb_long_sql_running_time", SQL["longest_sql_minutes"], "longest_sql_minutes"),
    ("gpdb_resource_group_running_sql", SQL["resource_group_totals"], "running"),
    ("gpdb_resource_group_waiting_sql", SQL["resource_group_totals"], "queueing"),
    ("gpdb_resource_queue_running_sql", SQL["resource_queue_counts"], "running"),
    ("gpdb_resource_queue_waiting_sql", SQL["resource_queue_counts"], "waiting"),
    ("gpdb_check_session_processes", SQL["session_process_skew_top"], "sess_proc_count"),
    ("gpdb_check_master_panic", f"select * from ({SQL['pattern_counts']}) p where pattern = 'master_panic'", "matches"),
    ("gpdb_check_segment_panic", f"select * from ({SQL['pattern_counts']}) p where pattern = 'segment_panic'", "matches"),
    ("gpdb_check_internal_error", f"select * from ({SQL['pattern_counts']}) p where pattern = 'internal_error'", "matches"),
    ("gpdb_check_oom", f"select * from ({SQL['pattern_counts']}) p where pattern = 'out_of_memory'", "matches"),
    ("gpdb_check_master_age", SQL["database_age_top"], "age_int"),
    ("gpdb_check_segment_age", SQL["segment_age"].replace("limit 50", "limit 1"), "age_int"),
]
SQL["metric_results"] = (
    f"select {CLOCK} as ctime, metric_name, monitor_result, 2 as status from ("
    + " union all ".join(_metric(*m) for m in _METRICS) + ") r"
)


def _decoded(item: str, flags: dict[str, str]) -> str:
    held = f"split_part(split_part({item}, '=', 2), '/', 1)"
    return "concat(" + ", ".join(f"case when contains({held}, '{f}') then '{w}' else '' end" for f, w in flags.items()) + ")"


_ON_TABLE = {"r": "Select;", "a": "Insert;", "w": "Update;", "d": "Delete;", "D": "Truncate;"}
_ON_SCHEMA = {"U": "Usage;", "C": "Create;"}
_ROLE = "case when split_part(item, '=', 1) = '' then 'public' else split_part(item, '=', 1) end"
SQL["table_privileges"] = f"""
    select schemaname, tablename, case when relkind = 'r' then 'Table' else 'View' end as tabletype, 'pg_default' as reltablespace,
      rolname, 'TRUE' as isowner, 'Select;Insert;Update;Delete;Truncate;' as privelege
    from fx_acl where relacl is null
    union all
    select schemaname, tablename, case when relkind = 'r' then 'Table' else 'View' end, 'pg_default', {_ROLE},
      case when {_ROLE} = rolname then 'TRUE' else 'FALSE' end, {_decoded('item', _ON_TABLE)}
    from (select *, unnest(relacl) as item from fx_acl where relacl is not null) x
"""
SQL["schema_privileges"] = f"""
    select nspname as schemaname, rolname as usename, '' as schema_privillege from fx_nsp_acl where nspacl is null
    union all
    select nspname, {_ROLE}, {_decoded('item', _ON_SCHEMA)}
    from (select *, unnest(nspacl) as item from fx_nsp_acl where nspacl is not null) x
"""
SQL["exact_privilege_roles"] = f"""
    select nspname, '' as roles from fx_nsp_acl where nspacl is null
    union all
    select nspname, string_agg(case when contains(item, '=r/') then {_ROLE} end, ';' order by pos) as roles
    from (select nspname, unnest(nspacl) as item, generate_subscripts(nspacl, 1) as pos from fx_nsp_acl where nspacl is not null) x
    group by 1
"""
SQL["acl_decoding"] = f"""
    select reloid, cast(pos - 1 as int) as pos, {_ROLE} as role, {_decoded('item', _ON_TABLE)} as on_table,
      {_decoded('item', _ON_SCHEMA)} as on_schema
    from (select reloid, unnest(relacl) as item, generate_subscripts(relacl, 1) as pos from fx_acl where relacl is not null) x
"""

# ---- the whole report


def _as_section(at: int, section: str, sql: str, key: str, value: str) -> str:
    return f"select '{section}' as section, {at} as ordinal, {key} as key, cast({value} as varchar) as value from ({sql}) s{at}"


def _health_sections() -> list[tuple]:
    per_table = "concat(tablename, '/', relstorage)"
    heap = _heap(104857600, 2.0)
    return [
        ("segments down", SQL["segments_down"], "'instances'", "n"),
        ("segments out of sync", SQL["segments_out_of_sync"], "'instances'", "n"),
        ("roles switched", SQL["role_switched"], "'instances'", "n"),
        ("cluster", f"""
            select 'segment_hosts' as k, segment_hosts as v from ({SQL['cluster_shape']}) c
            union all select 'primary_segments', primary_segments from ({SQL['cluster_shape']}) c""", "k", "v"),
        ("configuration changes",
         "select ctime, monitor_result from fx_history order by ctime desc, monitor_result limit 50",
         "cast(ctime as varchar)", "monitor_result"),
        ("database size", SQL["database_size"], "datname", "size_bytes"),
        ("database age", SQL["database_age"], "datname", "age_int"),
        ("segment age", SQL["segment_age"], "concat(segid, '/', datname)", "age_int"),
        ("idle transactions", SQL["long_idle_transactions"], "cast(pid as varchar)", "usename"),
        ("long queries", SQL["long_queries"], "cast(pid as varchar)", "query"),
        ("objects", SQL["object_counts"], "object", "n"),
        ("catalog bloat", SQL["catalog_bloat"], "catalog", "bloat"),
        ("storage by schema", SQL["storage_by_schema"], "concat(schemaname, '/', tabletype)", "n"),
        ("storage", SQL["storage_totals"], "tabletype", "n"),
        ("catalog operations", SQL["operation_history"], "concat(objname, '/', actionname)", "statime"),
        ("schema size", SQL["save_report"], "schemaname", "size_bytes"),
        ("tablespace size", SQL["tablespace_size"], "tsname", "size_bytes"),
        ("tablespace files", SQL["tablespace_max_files"], "tsname", "max_segfilenum"),
        ("append-only tables", _top("tablename", TABLE, "fx_rel_size", "relstorage in ('a', 'c')", 50), per_table, "size_bytes"),
        ("heap tables", SQL["top_heap"], per_table, "size_bytes"),
        ("partitioned tables", SQL["top_partitioned"], "concat(root_partition, '/', relstorage)", "size_bytes"),
        ("temporary tables",
         _top("tablename", TABLE, "fx_rel_size", "relstorage <> 'x' and starts_with(schemaname, 'pg_temp')", 50),
         per_table, "size_bytes"),
        ("indexes", SQL["top_indexes"], "concat(schemaname, '/', indexname)", "index_bytes"),
        ("skew", _skew("fx_rel_size", 1 << 30, 0.5), "tablename", "cast(skew as decimal(18, 2))"),
        ("subpartitions", SQL["subpartition_counts"], "tablename", "sub_count"),
        ("partitions in another schema", SQL["partition_schema_mismatch"], "partitiontablename", "tablename"),
        ("default partitions", SQL["default_partition_rows"], "tablename", "row_count"),
        ("bloat", _bloat_report(heap), per_table, "cast(bloat as decimal(18, 2))"),
        ("settings", SQL["settings_report"], "name", "setting"),
    ]


def _by_database(sql: str, fixtures: Sequence[str]) -> str:
    """The rows of a statement for each of three databases, over the rows that its fixtures have there."""

    def of(database: str) -> str:
        named = re.compile(rf"\b(from|join)\s+({'|'.join(fixtures)})\b")
        return named.sub(lambda m: f"{m[1]} (select * from {m[2]} where {database_rows(database, m[2])})", sql)

    return " union all ".join(f"select '{d}' as datname, * from ({of(d)}) {d}" for d in DATABASES)


_DATABASE_FIXTURES = (
    "fx_rel_size", "fx_rel_age", "fx_relpages", "fx_rel", "fx_attr", "fx_dk", "fx_cat_seg", "fx_catsize", "fx_ops", "fx_index", "fx_parts",
    "fx_visimap", "fx_colstats", "fx_modcount_new", "fx_modcount_old",
)
_CLUSTER_SECTIONS = (
    "segments down", "segments out of sync", "roles switched", "cluster", "configuration changes", "database size", "database age",
    "segment age", "idle transactions", "long queries", "settings",
)
SQL["health"] = " union all ".join(_as_section(at, *s) for at, s in enumerate(_health_sections(), start=1))
SQL["health_by_database"] = " union all ".join(
    f"select cast(null as varchar) as datname, * from ({_as_section(at, *s)}) h{at}" if s[0] in _CLUSTER_SECTIONS
    else f"select * from ({_by_database(_as_section(at, *s), _DATABASE_FIXTURES)}) h{at}"
    for at, s in enumerate(_health_sections(), start=1)
)
SQL["skew_check_by_database"] = _by_database(SQL["skew_check"], _DATABASE_FIXTURES)
SQL["high_age_relations_by_database"] = _by_database(
    SQL["high_age_relations"].replace("limit 8000", "limit 500"), _DATABASE_FIXTURES
)
SQL["changed_tables_by_database"] = _by_database(SQL["changed_tables"], _DATABASE_FIXTURES)
SQL["top_append_only_by_database"] = _by_database(
    _top("tablename", TABLE, "fx_rel_size", "relstorage in ('a', 'c')", 20), _DATABASE_FIXTURES
)

# ---- streaming: the same figures from the whole table

SQL["stream_log_alerts"] = f"""
    select time_bucket(interval '5 minutes', ts) as window_start,
      time_bucket(interval '5 minutes', ts) + interval '5' minute as window_end, hostname, pattern, count(*) as matches
    from ({_MATCHES}) m group by 1, 2, 3, 4
"""
_BACKFILL = f"""
    select batch, hostname, log_msg, ts, newest, case when ts is null then 'unparsable'
      when time_bucket(interval '5 minutes', ts) + interval '5' minute <= newest - interval '10' minute then 'late' else 'on time' end as kind
    from (select batch, {_HOST} as hostname, log_msg, {_ts(_TIME)} as ts from fx_log_backfill) l
    left join (
      select b.n as batch, (select max({_ts(_TIME)}) from fx_log_backfill e where e.batch < b.n) as newest
      from (values (0), (1), (2), (3)) b(n)) w using (batch)
"""
SQL["stream_log_account"] = f"""
    select batch, count(*) as lines, count(*) filter (where kind = 'on time') as on_time,
      count(*) filter (where kind = 'late') as late, count(*) filter (where kind = 'unparsable') as unparsable
    from ({_BACKFILL}) l group by 1
"""


def _backfill_matches(kinds: str) -> str:
    return f"""
    select time_bucket(interval '5 minutes', ts) as window_start,
      time_bucket(interval '5 minutes', ts) + interval '5' minute as window_end, hostname, pattern, count(*) as matches
    from ({_BACKFILL}) l
    join (values ('master_panic', '"PANIC"'), ('segment_panic', '"PANIC"'),
      ('internal_error', 'internal error'), ('out_of_memory', 'Out of memory')) p(pattern, mark) on contains(l.log_msg, p.mark)
    where kind in ({kinds}) and (pattern <> 'master_panic' or hostname = 'host0') and (pattern <> 'segment_panic' or hostname <> 'host0')
    group by 1, 2, 3, 4
"""


SQL["stream_log_backfill"] = _backfill_matches("'on time'")
SQL["stream_log_backfill_with_late"] = _backfill_matches("'on time', 'late'")
SQL["stream_latest_metrics"] = _LATEST
_LONGEST = """coalesce(cast(round_even(max(epoch_us(snapshot_ts) - epoch_us(query_start)) filter (where state = 'active') / 1e6 / 60, 0) as bigint), 0)"""
SQL["stream_metric_results"] = " union all ".join(
    f"select snapshot_ts as ctime, '{name}' as metric_name, cast({value} as varchar) as monitor_result, 2 as status "
    "from fx_activity_feed group by snapshot_ts"
    for name, value in (
        ("gpdb_total_sql", _ACTIVE), ("gpdb_total_waiting_sql", _WAITING), ("gpdb_total_connections", "count(*)"),
        ("gpdb_total_idle_in_transaction", _IDLE_TX), ("gpdb_long_sql_running_time", _LONGEST),
    )
)
SQL["stream_changed_tables"] = """
    select reloid, modcount, snapshot_ts, case when n = 1 then 'new' else 'changed' end as reason
    from (
      select reloid, snapshot_ts, modcount, lag(modcount) over (partition by reloid order by snapshot_ts) as earlier,
        row_number() over (partition by reloid order by snapshot_ts) as n
      from fx_modcount_feed
    ) c where n = 1 or modcount <> earlier
"""
SQL["stream_session_alerts"] = f"""
    select time_bucket(interval '5 minutes', snapshot_ts) as window_start, {_ACTIVE} as active_sql, {_WAITING} as waiting_sql,
      count(*) as connections, {_IDLE_TX} as idle_in_transaction,
      coalesce(cast(round_even(max(epoch_us(snapshot_ts) - epoch_us(query_start)) filter (where state = 'active') / 1e6 / 60, 0) as bigint), 0)
        as longest_sql_minutes
    from fx_activity_snap group by 1
"""

ORACLES = {name: with_fixtures(sql) for name, sql in SQL.items()}
