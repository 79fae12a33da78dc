"""Telemetry fixtures, as plain SQL over the driver's tables.

Every definition runs unchanged on Spark and on DuckDB, so a query and its
oracle start from the same rows.  A definition may read a base table or an
earlier fixture; both are named by bare identifier after FROM / JOIN.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DEFINITIONS = {
    # schemaname string, relname string, reloid bigint, segid int, size_bytes bigint, relfilecount bigint, relstorage string, spcname string
    "fx_rel_size": """
        select concat('s', l_partkey % 5) as schemaname,
          concat('t', l_partkey % 40, case when l_partkey % 3 = 0 then concat('_1_prt_', l_linenumber) else '' end) as relname,
          cast(l_partkey % 40 as bigint) as reloid, cast(l_suppkey % 8 as int) as segid,
          cast(l_quantity * 1048576 as bigint) * case when l_partkey % 40 = 11 and l_suppkey % 8 = 2 then 20 else 1 end as size_bytes,
          cast(l_linenumber as bigint) as relfilecount,
          case l_partkey % 4 when 0 then 'h' when 1 then 'a' when 2 then 'x' else 'c' end as relstorage,
          case when l_partkey % 3 = 0 then null else concat('ts', l_partkey % 3) end as spcname
        from lineitem where not (l_partkey % 40 = 7 and l_suppkey % 8 > 3)
    """,
    # reloid bigint, schemaname string, relname string, relkind string, relstorage string, relhassubclass boolean, relispartition boolean, rolname string, spcname string
    "fx_rel": """
        select p_partkey as reloid, case when p_partkey % 11 = 0 then 'pg_catalog' else concat('s', p_partkey % 5) end as schemaname,
          concat('t', p_partkey, case when p_partkey % 3 = 0 then '_1_prt_1' else '' end) as relname,
          case when p_partkey % 13 = 0 then 'v' when p_partkey % 17 = 0 then 'f' else 'r' end as relkind,
          case p_size % 4 when 0 then 'h' when 1 then 'a' when 2 then 'c' else 'x' end as relstorage,
          p_partkey % 10 = 0 as relhassubclass, p_partkey % 7 = 0 as relispartition,
          concat('own', p_size % 6) as rolname,
          case when p_partkey % 2 = 0 then null else concat('ts', p_partkey % 3) end as spcname from part
    """,
    # reloid bigint, segid int, age_int bigint
    "fx_rel_age": """
        select l_partkey as reloid, cast(l_suppkey % 8 as int) - 1 as segid,
          case when l_orderkey % 97 = 0 then 2147483647 else cast(floor(l_extendedprice * 5000) as bigint) end as age_int from lineitem
    """,
    # schemaname string, tablename string, attname string, null_frac double, avg_width int
    "fx_colstats": """
        select concat('s', p_partkey % 5) as schemaname, concat('t', p_partkey % 50) as tablename, concat('c', p_partkey) as attname,
          case when p_size % 3 = 0 then 0.0e0 else p_size / 100.0e0 end as null_frac, p_size as avg_width from part
    """,
    # schemaname string, relname string, reltuples double, relpages bigint
    "fx_relpages": """
        select concat('s', l_partkey % 5) as schemaname, concat('t', l_partkey % 50) as relname,
          cast(count(*) as double) * 1000 as reltuples, cast(sum(l_quantity) * 100 as bigint) as relpages from lineitem group by 1, 2
    """,
    # reloid bigint, schemaname string, tablename string, segid int, hidden bigint, total bigint
    "fx_visimap": """
        select o_custkey as reloid, concat('s', o_custkey % 5) as schemaname, concat('t', o_custkey) as tablename, cast(o_orderkey % 8 as int) as segid,
          sum(case when o_orderstatus = 'F' then 1 else 0 end) as hidden, count(*) as total from orders group by 1, 2, 3, 4
    """,
    # pid bigint, sess_id bigint, usename string, state string, waiting boolean, query_start timestamp_ntz, xact_start timestamp_ntz, state_change timestamp_ntz, query string
    "fx_activity": """
        select event_id as pid, user_id as sess_id, concat('u', user_id % 10) as usename,
          case event_type when 'click' then 'active' when 'purchase' then 'active' when 'view' then 'idle' when 'signup' then 'idle in transaction' else 'disabled' end as state,
          value < 5 as waiting, ts as query_start, ts as xact_start, ts as state_change, props as query from events
    """,
    # relation bigint, pid bigint, xact_start timestamp_ntz, usename string, granted boolean, lockmode string
    "fx_locks": """
        select user_id as relation, event_id as pid, ts as xact_start, concat('u', user_id % 10) as usename,
          event_type <> 'error' as granted, case when value < 5 then 'ShareLock' else 'ExclusiveLock' end as lockmode from events
    """,
    # locktype string, relation bigint, segid int, pid bigint, granted boolean, lockmode string : locks as landed
    "fx_lock_rows": """
        select case when event_id % 11 = 0 then 'transactionid' else 'relation' end as locktype, 16380 + user_id % 40 as relation,
          cast(case when event_id % 7 = 0 then 3 else -1 end as int) as segid, event_id as pid, event_type <> 'error' as granted,
          case when value < 5 then 'ShareLock' else 'ExclusiveLock' end as lockmode from events
    """,
    # pid bigint, usename, state, waiting boolean, xact_start timestamp_ntz, query : the sessions behind fx_lock_rows
    "fx_lock_activity": """
        select event_id as pid, concat('u', user_id % 10) as usename, case when event_id % 5 = 0 then 'idle in transaction' else 'active' end as state,
          event_type = 'error' and event_id % 3 <> 0 as waiting, ts as xact_start, concat('select ', event_id) as query from events
    """,
    # log_msg string
    "fx_log": """
        select concat('host', user_id % 4, ':/d/gpseg', user_id % 8, '/pg_log/gpdb-', cast(cast(ts as date) as string), '_000000.csv:', cast(ts as string),
          ' UTC,"u","db",p', event_id % 31, ',th1,"h","1",t,0,con', user_id, ',seg', user_id % 8, ',"',
          case when event_type = 'error' then 'PANIC","Unexpected internal error' when event_type = 'signup' then concat('LOG","server process (PID ', event_id % 31, ') was terminated by signal 9')
               when event_type = 'view' then 'ERROR","Out of memory' else 'LOG","ok' end, '"') as log_msg from events
    """,
    # log_msg string, batch bigint: fx_log day by day in four batches, each fifth line a batch late, some lines without a time
    "fx_log_backfill": """
        select case when length(log_msg) % 11 = 3 then 'host1:/d/gpseg1/pg_log/broken.csv:no time here' else log_msg end as log_msg,
          least(3, cast(floor((day - 1) / 8) as bigint) + case when length(log_msg) % 5 = 1 then 1 else 0 end) as batch
        from (select log_msg, cast(substr(split_part(split_part(log_msg, '.csv:', 2), ' ', 1), 9, 2) as int) as day from fx_log) l
    """,
    # segid int, sessionid string, pid bigint
    "fx_proc": """
        select cast(user_id % 8 as int) as segid, concat('con', user_id % 50) as sessionid, event_id as pid from events
    """,
    # dbid bigint, content int, role string, preferred_role string, status string, mode string, hostname string
    "fx_segconf": """
        select s_suppkey as dbid, cast(s_suppkey as int) % 17 - 1 as content, case when s_suppkey % 2 = 0 then 'p' else 'm' end as role,
          case when s_suppkey % 10 = 0 then 'm' when s_suppkey % 2 = 0 then 'p' else 'm' end as preferred_role,
          case when s_acctbal < 0 then 'd' else 'u' end as status, case when s_acctbal > 9000 then 'n' else 's' end as mode,
          concat('host', s_nationkey) as hostname from supplier
    """,
    # reloid bigint, modcount bigint
    "fx_modcount_old": """
        select o_custkey as reloid, count(*) as modcount from orders where o_orderdate < timestamp '2000-01-01 00:00:00' group by 1
    """,
    # reloid bigint, modcount bigint
    "fx_modcount_new": """
        select o_custkey as reloid, count(*) as modcount from orders group by 1
    """,
    # objid bigint, actionname string, statime timestamp_ntz
    "fx_ops": """
        select o_custkey as objid, case when o_orderstatus = 'F' then 'ANALYZE' else 'VACUUM' end as actionname, o_orderdate as statime from orders
    """,
    # ctime timestamp_ntz, metric_name string, monitor_result string, status int
    "fx_history": """
        select ts as ctime, event_type as metric_name, cast(value as string) as monitor_result, case when value < 1 then 3 else 2 end as status from events
    """,
    # filename string, size_bytes bigint, modtime timestamp
    "fx_files": """
        select concat(doc_id % 300, case when doc_id % 2 = 0 then '' else concat('.', doc_id % 9) end) as filename, n_chars as size_bytes,
          timestamp '2024-01-31 00:00:00' - interval '1' day * cast(doc_id % 60 as int) as modtime from documents
    """,
    # schemaname string, tablename string, partitionschemaname string, partitiontablename string, partitionisdefault boolean
    "fx_parts": """
        select concat('s', o_custkey % 5) as schemaname, concat('t', o_custkey % 40) as tablename,
          case when o_orderkey % 50 = 0 then 'other' else concat('s', o_custkey % 5) end as partitionschemaname,
          concat('t', o_custkey % 40, '_1_prt_', o_orderkey % 12) as partitiontablename, o_orderkey % 12 = 0 as partitionisdefault from orders
    """,
    # segid int, datname string, age_int bigint
    "fx_db_age": """
        select cast(l_suppkey % 9 as int) - 1 as segid, concat('db', l_partkey % 6) as datname, max(cast(floor(l_extendedprice * 5000) as bigint)) as age_int from lineitem group by 1, 2
    """,
    # auxoid bigint, segid int, relkind string, age_int bigint
    "fx_aux_age": """
        select l_partkey * 10 + l_linenumber % 3 as auxoid, cast(l_suppkey % 8 as int) as segid, case l_linenumber % 3 when 0 then 'o' when 1 then 'm' else 'b' end as relkind,
          cast(floor(l_extendedprice * 5000) as bigint) as age_int from lineitem
    """,
    # relid bigint, segrelid bigint, visimaprelid bigint, blkdirrelid bigint
    "fx_aux_link": """
        select p_partkey as relid, p_partkey * 10 as segrelid, p_partkey * 10 + 1 as visimaprelid, p_partkey * 10 + 2 as blkdirrelid from part
    """,
    # reloid bigint, relname string, schemaname string, relfilenode string
    "fx_relfilenode": """
        select distinct p_partkey % 250 as reloid, concat('t', p_partkey % 250) as relname, concat('s', p_partkey % 5) as schemaname, cast(p_partkey % 250 as string) as relfilenode from part
    """,
    # line string
    "fx_listing": """
        select case when doc_id % 50 = 0 then 'total 1234' when doc_id % 51 = 0 then '/data/base/1:' when doc_id % 52 = 0 then '' when doc_id % 53 = 0 then '-????????? ? ? ? ? ? x'
          when doc_id % 47 = 0 then concat('-rw-------   1 dba dba   ', n_chars, ' 2024-01-01_10:00:00') when doc_id % 43 = 0 then concat('-rw-------   1 dba dba   x', n_chars, ' 2024-01-01_10:00:00 1')
          else concat('-rw-------   1 dba dba   ', n_chars, ' 2024-01-', case when doc_id % 28 < 9 then '0' else '' end, doc_id % 28 + 1, '_10:00:00 ', doc_id % 300, case when doc_id % 2 = 0 then '' else concat('.', doc_id % 9) end) end as line from documents
    """,
    # reloid bigint, segid int, modcount bigint
    "fx_aoseg": """
        select o_custkey as reloid, cast(o_orderkey % 8 as int) as segid, cast(o_orderkey % 13 as bigint) as modcount from orders
    """,
    # schemaname string, tablename string, partitionlevel int, partitiontablename string
    "fx_partlevel": """
        select distinct concat('s', o_custkey % 5) as schemaname, concat('t', o_custkey % 40) as tablename, cast(o_orderkey % 2 as int) as partitionlevel,
          concat('t', o_custkey % 40, '_1_prt_', o_orderkey % 6, case when o_orderkey % 2 = 1 then '_2_prt_a' else '' end) as partitiontablename from orders
    """,
    # schemaname string, tablename string, indexname string, index_bytes bigint
    "fx_index": """
        select concat('s', p_partkey % 5) as schemaname, concat('t', p_partkey % 40) as tablename, concat('ix', p_partkey) as indexname, cast(p_size as bigint) * 1048576 as index_bytes from part
    """,
    # pid bigint, sess_id bigint, usename string, segid int, size_bytes bigint
    "fx_workfile": """
        select event_id as pid, user_id as sess_id, concat('u', user_id % 10) as usename, cast(event_id % 8 as int) as segid, cast(floor(value * 10000000) as bigint) as size_bytes from events
    """,
    # rsgname string, num_running int, num_queueing int
    "fx_resgroup": """
        select concat('g', s_suppkey) as rsgname, cast(s_suppkey % 7 as int) as num_running, cast(s_suppkey % 3 as int) as num_queueing from supplier
    """,
    # pid bigint, resqstatus string
    "fx_resq": """
        select event_id as pid, case event_type when 'click' then 'running' when 'view' then 'waiting' else 'none' end as resqstatus from events
    """,
    # nspname string, segid int
    "fx_namespace": """
        select distinct case when user_id % 3 = 0 then concat('pg_temp_', user_id + event_id % 40) when user_id % 3 = 1 then concat('pg_toast_temp_', user_id + event_id % 40) else concat('s', user_id) end as nspname,
          cast(event_id % 3 as int) - 1 as segid from events
    """,
    # monitor_id int, metric_name string, check_interval int, if_warning boolean, warning_value string, status int, last_finishtime timestamp
    "fx_setup": """
        select cast(p_partkey as int) as monitor_id, concat('m', p_partkey) as metric_name, cast(p_size as int) as check_interval, p_partkey % 2 = 0 as if_warning, cast(p_size * 2 as string) as warning_value,
          cast(p_partkey % 5 as int) as status, case when p_partkey % 7 = 0 then null else timestamp '2024-01-30 23:30:00' end as last_finishtime from part
    """,
    # catalog string, actual_bytes bigint, compact_bytes bigint, row_count bigint
    "fx_catsize": """
        select concat('cat', p_partkey % 5) as catalog, cast(sum(p_size) as bigint) * 8192 as actual_bytes, cast(sum(case when p_partkey % 5 = 4 then 0 else p_size % 7 end) as bigint) * 8192 as compact_bytes, count(*) as row_count from part group by 1
    """,
    # reloid bigint, tablename string, distkey array<string>
    "fx_dk": """
        select p_partkey as reloid, concat('s', p_partkey % 5, '.t', p_partkey) as tablename, case when p_partkey % 4 = 0 then null else split(concat(p_size % 3 + 1, ',', p_size % 3 + 2), ',') end as distkey from part
    """,
    # reloid bigint, attnum int, attname string
    "fx_attr": """
        select p_partkey as reloid, 1 as attnum, 'col1' as attname from part
        union all select p_partkey, 2, 'col2' from part
        union all select p_partkey, 3, 'col3' from part
        union all select p_partkey, 4, 'col4' from part
        union all select p_partkey, 5, 'col5' from part
    """,
    # reloid bigint, schemaname string, tablename string, relkind string, rolname string, relacl array<string>
    "fx_acl": """
        select p_partkey as reloid, concat('s', p_partkey % 5) as schemaname, concat('t', p_partkey) as tablename, case when p_partkey % 3 = 0 then 'v' else 'r' end as relkind, concat('own', p_size % 6) as rolname,
          case when p_partkey % 5 = 0 then null else split(concat('own', p_size % 6, '=arwdD/own', p_size % 6, ';=r/own', p_size % 6, ';role', p_partkey % 7, '=', case p_partkey % 4 when 0 then 'x' when 1 then 'ar' when 2 then 'r' else 'UC' end, '/own', p_size % 6), ';') end as relacl from part
    """,
    # name string, setconfig array<string>
    "fx_settings": """
        select concat('db', s_suppkey) as name, case when s_suppkey % 4 = 0 then null else split(concat('a=', s_suppkey, ';b=', s_nationkey), ';') end as setconfig from supplier
    """,
    # reloid, schemaname, schemaoid, ... : the relation catalog with realistic object ids
    "fx_rel_user": """
        select reloid + 16000 as reloid, schemaname, case when schemaname = 'pg_catalog' then 11 else 16500 end as schemaoid,
          relname, relkind, relstorage, relhassubclass, relispartition, rolname, spcname from fx_rel
    """,
    # segid int, filename string, size_bytes bigint, modtime timestamp_ntz : one row per data file of a segment
    "fx_seg_files": """
        select cast(l_suppkey % 8 as int) as segid, concat('db', l_orderkey % 2) as datname,
          concat(l_partkey % 40, case when l_linenumber % 3 = 0 then '' when l_linenumber % 3 = 1 then concat('.', l_linenumber) else '_fsm' end) as filename,
          cast(l_quantity * 1048576 as bigint) * case when l_partkey % 40 = 12 and l_suppkey % 8 = 2 then 20 else 1 end as size_bytes,
          l_shipdate as modtime
        from lineitem where not (l_partkey % 40 = 8 and l_suppkey % 8 > 3)
    """,
    # reloid bigint, segid int, datname, schemaname, relname, relfilenode, relstorage : catalogs behind fx_seg_files.
    # A node number stands for another relation on every segment and in every database.
    "fx_seg_rels": """
        select distinct l_partkey % 40 as reloid, cast(l_suppkey % 8 as int) as segid, concat('db', l_orderkey % 2) as datname,
          concat('d', l_orderkey % 2, 's', l_partkey % 5) as schemaname, concat('t', l_partkey % 40) as relname,
          cast((l_partkey % 40 + 3 * (l_suppkey % 8) + 7 * (l_orderkey % 2)) % 40 as string) as relfilenode,
          case l_partkey % 4 when 0 then 'h' when 1 then 'a' when 2 then 'c' else 'x' end as relstorage from lineitem
    """,
    # schemaname, relname, reloid, segid, size_bytes, relfilecount, relstorage, spcname : sizes with temporary schemas
    "fx_temp_size": """
        select case when reloid % 4 = 0 then concat('pg_temp_', segid + reloid) else schemaname end as schemaname, relname, reloid, segid,
          size_bytes, relfilecount, relstorage, spcname from fx_rel_size
    """,
    # segid int, line string : listing text by segment
    "fx_seg_listing": """
        select cast(length(line) % 8 as int) as segid, line from fx_listing
    """,
    # filename string, size_bytes bigint, modtime timestamp : server log files of mixed age
    "fx_log_files": """
        select concat('gpdb-', doc_id, case doc_id % 4 when 0 then '.csv' when 1 then '.log' when 2 then '.csv.gz' else '.txt' end) as filename,
          n_chars as size_bytes, timestamp '2024-01-31 00:00:00' - interval '1' day * cast(doc_id % 60 as int) as modtime from documents
    """,
    # catalog string, segid int, size_bytes bigint, row_count bigint : catalog sizes per segment, coordinator = -1
    "fx_cat_seg": """
        select concat('cat', p_partkey % 5) as catalog, cast(floor(p_partkey / 5) as int) % 9 - 1 as segid,
          cast(sum(p_size) as bigint) * 8192 as size_bytes, count(*) as row_count from part group by 1, 2
    """,
    # nspname string, rolname string, nspacl array<string>
    "fx_nsp_acl": """
        select concat('n', reloid) as nspname, rolname, relacl as nspacl from fx_acl
    """,
    # metric_name string, if_warning boolean, warning_value string : thresholds for the metrics of fx_history
    "fx_alert_setup": """
        select distinct event_type as metric_name, event_type <> 'view' as if_warning,
          case when event_type = 'signup' then 'n/a' else '250' end as warning_value from events
    """,
    # metric_name string, status int, last_finishtime timestamp : settings of the metrics of fx_history and of others
    "fx_metric_setup": """
        select distinct event_type as metric_name, 1 as status, timestamp '2024-01-30 00:00:00' as last_finishtime from events
        union all select metric_name, status, last_finishtime from fx_setup
    """,
    # snapshot_ts timestamp_ntz + fx_activity : session snapshots as they arrive
    "fx_activity_snap": """
        select query_start as snapshot_ts, pid, sess_id, state, waiting, query_start from fx_activity
    """,
    # proc_line string : process list as landed text
    "fx_proc_lines": """
        select concat('host', segid, ' 5432 u', pid % 10, ' db', pid % 3, ' 10.0.0.1(', pid % 50000, ') ', sessionid, ' seg', segid, ' slice', pid % 4) as proc_line from fx_proc
    """,
    # setdatabase bigint, setrole bigint, setconfig array<string> : settings of databases and roles in one table
    "fx_owner_settings": """
        select case when s_suppkey % 2 = 0 then s_suppkey else 0 end as setdatabase, case when s_suppkey % 2 = 0 and s_suppkey % 6 <> 0 then 0 else s_suppkey end as setrole,
          split(concat('a=', s_suppkey, ';b=', s_nationkey), ';') as setconfig from supplier
    """,
    # fx_rel_size with leaves named freely and known by the catalog only
    "fx_leaf_size": """
        select schemaname, concat('leaf', l_partkey % 200, 'x', l_linenumber) as relname, l_partkey % 200 * 10 + l_linenumber as reloid, segid, size_bytes, relstorage
        from (select l_partkey, l_linenumber, concat('s', l_partkey % 5) as schemaname, cast(l_suppkey % 8 as int) as segid, cast(l_quantity * 1048576 as bigint) as size_bytes,
          case when l_partkey % 2 = 0 then 'h' else 'a' end as relstorage from lineitem where not (l_partkey % 40 = 9 and l_suppkey % 8 < 2)) x
    """,
    # reloid bigint, root_schema string, root_name string : leaves and their partitioned tables
    "fx_leaf_parent": """
        select distinct l_partkey % 200 * 10 + l_linenumber as reloid, concat('s', l_partkey % 5) as root_schema, concat('t', l_partkey % 40) as root_name
        from lineitem where l_partkey % 200 > 40
    """,
    # metric_name string, ctime timestamp_ntz : when log checks ran; the check of segment panics never did
    "fx_log_checks": """
        select case n_nationkey % 3 when 0 then 'gpdb_check_master_panic' when 1 then 'gpdb_check_internal_error' else 'gpdb_check_oom' end as metric_name,
          timestamp '2024-01-02 00:00:00' + interval '1' day * cast(n_nationkey as int) as ctime from nation
    """,
    # reloid bigint, modcount bigint, snapshot_ts timestamp_ntz : counters of four snapshots
    "fx_modcount_feed": """
        select reloid, modcount, timestamp '2000-01-01 00:00:00' as snapshot_ts from fx_modcount_old
        union all
        select reloid, modcount + reloid % 2, timestamp '2000-06-01 00:00:00' as snapshot_ts from fx_modcount_old
        union all
        select reloid, modcount + reloid % 3, timestamp '2001-01-01 00:00:00' as snapshot_ts from fx_modcount_old
        union all
        select reloid, modcount, timestamp '2001-08-01 00:00:00' as snapshot_ts from fx_modcount_new
    """,
    # snapshot_ts timestamp_ntz, pid, state, waiting, query_start : sessions of four snapshots
    "fx_activity_feed": """
        select timestamp '2024-01-31 00:00:00' as snapshot_ts, pid, state, waiting, query_start from fx_activity
        union all
        select timestamp '2024-01-31 00:05:00' as snapshot_ts, pid, state, waiting, query_start from fx_activity where pid % 3 <> 0
        union all
        select timestamp '2024-01-31 00:10:00' as snapshot_ts, pid, state, waiting, query_start from fx_activity where state <> 'active'
        union all
        select timestamp '2024-01-31 00:15:00' as snapshot_ts, pid, state, waiting, query_start from fx_activity
    """,
}

_SOURCE = re.compile(r"\b(from|join)\s+(\w+)", re.IGNORECASE)


def references(sql: str) -> list[str]:
    """Fixtures and base tables a statement reads, in order of first use."""
    seen: dict[str, None] = {}
    for _, name in _SOURCE.findall(sql):
        if name in DEFINITIONS or name in TABLES:
            seen.setdefault(name)
    return list(seen)


# Rows of each of three databases, by a number of the fixture.
DATABASES = {"db0": "{0} = {0}", "db1": "{0} % 3 <> 0", "db2": "{0} % 2 = 0"}
_NUMBERS = {
    "fx_ops": "objid", "fx_cat_seg": "segid", "fx_catsize": "compact_bytes", "fx_index": "index_bytes", "fx_colstats": "avg_width",
    "fx_relpages": "relpages", "fx_parts": "length(partitiontablename)",
}


def database_rows(database: str, fixture: str) -> str:
    """The condition for a fixture's rows in one of the databases."""
    return DATABASES[database].format(_NUMBERS.get(fixture, "reloid"))


class Fixtures:
    """Lazy fixture DataFrames over one data directory: ``fx.fx_rel_size``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DEFINITIONS:
            sql = DEFINITIONS[name]
            inputs = references(sql)
            bound = _SOURCE.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0], sql)
            frame = self.spark.sql(bound, **{i: getattr(self, i) for i in inputs})
        else:
            raise AttributeError(name)
        return self._frames.setdefault(name, frame)


def with_fixtures(sql: str) -> str:
    """Prefix an oracle statement with the CTEs of the fixtures it reads."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in references(text):
            if name in DEFINITIONS and name not in ordered:
                visit(DEFINITIONS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} as ({DEFINITIONS[name].rstrip()}\n)" for name in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
