"""Facts of catalogs, stores and runs, told by the driver's tables: each row of a table is an object, an entry or a result.

The comparisons of catalogs take rows of names and properties; here these come from whole tables, so their work
grows with them. Each side's select runs in Spark and in DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.fixtures import duck_text, run_text

_KINDS = {"string": "varchar", "long": "bigint", "int": "integer", "double": "double", "boolean": "boolean", "array<string>": "varchar[]", "map<string,long>": "map(varchar, bigint)"}


@dataclass(frozen=True)
class Facts:
    """Rows of a select by place, under the names and types of ``schema``; ``other`` is DuckDB's select where it must differ."""

    schema: str
    text: str
    other: str = ""

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(f.strip().split(" ", 1)) for f in self.schema.replace("<string,", "<string;").split(",")]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run_text(spark, sf_dir, self.text).toDF(*[n for n, _ in self.fields])
        return rows.select(*[F.col(f"`{n}`").cast(kind.replace(";", ",")).alias(n) for n, kind in self.fields])

    def sql(self) -> str:
        names = ", ".join(f"c{i}" for i in range(len(self.fields)))
        columns = ", ".join(f'cast(c{i} as {_KINDS[kind.replace(";", ",")]}) as "{n}"' for i, (n, kind) in enumerate(self.fields))
        return f"(select {columns} from ({duck_text(self.other or self.text)}) t({names}))"


_EVENT_COUNTS = "(select event_type as db, cast(floor(event_id / 500) as bigint) as tick, count(*) as n from {events} group by event_type, cast(floor(event_id / 500) as bigint)) e"
_SAMPLE = f"""select db, tick * 10, src, dst, {{0}} from (select db, tick, sum(case when tick <= 8 or tick % 7 = 0 then n else 0 end) over (partition by db order by tick) as src,
    sum(case when tick <= 8 or tick % 7 = 0 then n else 0 end) over (partition by db order by tick) - case when tick % 3 = 0 then n else 0 end as dst from {_EVENT_COUNTS}) x"""
_TEXTS = "case p_partkey % 6 when 0 then 'varchar' when 1 then 'numeric' when 2 then 'decimal' when 3 then {0} when 4 then 'int' else 'text' end"
_INDEX = "select p_brand, concat('i', p_partkey), {0}, {1}, {2}, case when p_size % 2 = 0 then 'en' end from {{part}}"
_OBJECT = "case p_size % 6 when 0 then 'table' when 1 then 'view' when 2 then 'index' when 3 then 'invalid_index' when 4 then 'sequence' else 'function' end"
_RESULT = "check string, scope string, status string, detail string, report string, fix_hint string"
_RESULTS = "select case o_orderkey % 4 when 0 then 'counts' when 1 then 'data' when 2 then 'deep' else 'schema' end, concat('app', o_custkey % 9, ' t', o_orderkey), case o_orderkey % 7 when 0 then 'diff' when 1 then 'error' when 2 then 'skip' else 'ok' end, o_orderpriority, '', '' from {orders}"
_ENTRY = "key string, type string, str string, items array<string>"
_NAMES = "case p_partkey when 1 then 'TimeZone' when 2 then 'wal_level' when 3 then 'search_path' when 4 then 'DateStyle' else concat('setting_', p_partkey) end"

FACTS = {
    "_SRC_TABLES": Facts("schema string, name string", "select p_brand, concat('t', p_partkey) from {part}"),
    "_DST_TABLES": Facts("schema string, name string", "select p_brand, concat('t', p_partkey) from {part} where p_partkey % 7 <> 0 union all select 'temp', concat('x', p_partkey) from {part} where p_partkey % 50 = 0"),
    "_SRC_META": Facts("column string, type string, char_length long, scale long, precision long, unsigned boolean", f"select concat('t.c', p_partkey), {_TEXTS.format(chr(39) + 'bigint' + chr(39))}, case when p_partkey % 6 = 0 then 100 else 0 end, case p_partkey % 6 when 1 then 4 when 2 then 2 else 0 end, case p_partkey % 6 when 1 then 12 when 2 then 18 when 3 then 64 else 10 end, p_partkey % 6 = 4 from {{part}}"),
    "_DST_META": Facts("column string, type string, char_length long, scale long, precision long, unsigned boolean", f"select concat('t.c', p_partkey), {_TEXTS.format('case when p_partkey % 5 = 0 then ' + chr(39) + 'integer' + chr(39) + ' else ' + chr(39) + 'bigint' + chr(39) + ' end')}, case when p_partkey % 6 = 0 then case when p_partkey % 5 = 0 then 50 else 100 end else 0 end, case p_partkey % 6 when 1 then case when p_partkey % 5 = 1 then 2 else 4 end when 2 then 2 else 0 end, case p_partkey % 6 when 1 then 12 when 2 then case when p_partkey % 5 = 2 then 12 else 18 end when 3 then 32 else 10 end, p_partkey % 6 = 4 and p_partkey % 5 <> 4 from {{part}} where p_partkey % 11 <> 0"),
    "_SRC_SETS": Facts("column string, charset string", "select concat('t.c', p_partkey), case p_size % 4 when 0 then 'utf8mb4' when 1 then 'utf8mb3' when 2 then 'latin1' else 'ascii' end from {part}"),
    "_DST_SETS": Facts("column string, charset string", "select concat('t.c', p_partkey), case (p_size + p_partkey) % 4 when 0 then 'utf8mb4' when 1 then 'utf8' when 2 then 'latin1' else 'ascii' end from {part} where p_partkey % 9 <> 0"),
    "_SRC_GEN": Facts("table string, column string, expression string", "select p_brand, concat('c', p_partkey), concat('(a * ', p_size, ')') from {part}"),
    "_DST_GEN": Facts("table string, column string, expression string", "select p_brand, concat('c', p_partkey), concat('A*', case when p_partkey % 9 = 0 then p_size + 1 else p_size end) from {part} where p_partkey % 13 <> 0"),
    "_SRC_PARTS": Facts("table string, bound string", "select o_orderstatus, cast(o_orderkey % 997 as string) from {orders}"),
    "_DST_PARTS": Facts("table string, bound string", "select o_orderstatus, cast(o_orderkey % 997 as string) from {orders} where o_orderkey % 997 > 100 union all select 'default', cast(o_orderkey % 5 as string) from {orders}"),
    "_SRC_OBJ": Facts("obj_type string, obj_name string", f"select {_OBJECT}, concat(p_name, ' ', p_partkey) from {{part}}"),
    "_DST_OBJ": Facts("obj_type string, obj_name string", f"select {_OBJECT}, concat(p_name, ' ', p_partkey) from {{part}} where p_partkey % 10 <> 0 union all select {_OBJECT}, concat('new ', p_partkey) from {{part}} where p_partkey % 40 = 0"),
    "_SRC_DEF": Facts("obj_type string, obj_name string, definition string", "select case when p_size % 2 = 0 then 'view' else 'trigger' end, concat('d', p_partkey), concat('SELECT ', p_name, ' FROM t') from {part}"),
    "_DST_DEF": Facts("obj_type string, obj_name string, definition string", "select case when p_size % 2 = 0 then 'view' else 'trigger' end, concat('d', p_partkey), case when p_partkey % 7 = 0 then 'select other' when p_partkey % 3 = 0 then concat('select  ', upper(p_name), '  from T') else concat('SELECT ', p_name, ' FROM t') end from {part} where p_partkey % 11 <> 0 union all select 'view', concat('e', p_partkey), p_type from {part} where p_partkey % 40 = 0"),
    "_SRC_COL": Facts("table string, column string, type string, nullable boolean, default string", "select p_brand, concat('c', p_partkey), case when p_size % 2 = 0 then 'int' else 'text' end, p_size % 3 = 0, case when p_size % 5 = 0 then '0' end from {part}"),
    "_DST_COL": Facts("table string, column string, type string, nullable boolean, default string", "select p_brand, concat('c', p_partkey), case when p_partkey % 17 = 0 then 'bigint' when p_size % 2 = 0 then 'int' else 'text' end, case when p_partkey % 19 = 0 then p_size % 3 <> 0 else p_size % 3 = 0 end, case when p_size % 10 = 0 then '0' end from {part} where p_partkey % 23 <> 0"),
    "_SRC_SET": Facts("name string, value string", f"select {_NAMES}, concat(' ', p_size) from {{part}}"),
    "_DST_SET": Facts("name string, value string", f"select {_NAMES}, case when p_partkey % 7 = 3 or p_partkey < 3 then 'other' else cast(p_size as string) end from {{part}} where p_partkey % 9 <> 0"),
    "_SRC_GRANT": Facts("grantee string, object string, privilege string", "select concat('r', p_size), concat('t', p_partkey % 40), p_type from {part}"),
    "_DST_GRANT": Facts("grantee string, object string, privilege string", "select concat('r', p_size), concat('t', p_partkey % 40), p_type from {part} where p_partkey % 3 <> 0 union all select concat('r', p_size), 'extra', p_type from {part} where p_partkey % 30 = 0"),
    "_SRC_ROLE": Facts("role string", "select distinct concat('r', p_size) from {part}"),
    "_DST_ROLE": Facts("role string", "select distinct concat('r', p_size) from {part} where p_size % 5 <> 0"),
    "_SRC_EXT": Facts("name string, version string", "select concat('x', p_partkey), cast(p_size as string) from {part}"),
    "_DST_EXT": Facts("name string, version string", "select concat('x', p_partkey), cast(case when p_partkey % 6 = 0 then p_size + 1 else p_size end as string) from {part} where p_partkey % 8 <> 0 union all select concat('y', p_partkey), '1' from {part} where p_partkey % 99 = 0"),
    "_SRC_IDX": Facts("table string, index string, is_unique boolean, ttl long, partial string, collation string", _INDEX.format("p_size % 2 = 0", "case when p_size % 3 = 0 then p_size * 60 end", "case when p_size % 5 = 0 then 'x > 1' end")),
    "_DST_IDX": Facts("table string, index string, is_unique boolean, ttl long, partial string, collation string", _INDEX.format("p_size % 2 = 0 and p_partkey % 9 <> 0", "case when p_size % 3 = 0 and p_partkey % 4 <> 0 then p_size * 60 end", "case when p_size % 5 = 0 then case when p_partkey % 7 = 0 then 'x > 2' else 'x > 1' end end") + " where p_partkey % 31 <> 0"),
    "_SRC_CON": Facts("table string, constraint string, deferrable boolean, deferred boolean", "select p_brand, concat('fk', p_partkey), p_size % 2 = 0, p_size % 4 = 0 from {part}"),
    "_DST_CON": Facts("table string, constraint string, deferrable boolean, deferred boolean", "select p_brand, concat('fk', p_partkey), p_size % 2 = 0 and p_partkey % 5 <> 0, p_size % 4 = 0 and p_partkey % 3 <> 0 from {part}"),
    "_TRIG": Facts("table string, name string, enabled boolean, validated boolean", "select p_brand, concat('tr', p_partkey), p_size % 7 <> 0, p_partkey % 11 <> 0 from {part}"),
    "_RLS": Facts("table string, row_security boolean", "select concat('c', c_custkey), c_custkey % 3 = 0 from {customer}"),
    "_POL": Facts("table string, policy string", "select concat('c', o_custkey), cast(o_orderkey as string) from {orders} where o_orderkey % 5 = 0"),
    "_SRC_CAP": Facts("collection string, capped boolean, size long", "select concat('c', c_custkey), c_custkey % 2 = 0, 1000 * (c_custkey % 50) from {customer}"),
    "_DST_CAP": Facts("collection string, capped boolean, size long", "select concat('c', c_custkey), c_custkey % 2 = 0 and c_custkey % 7 <> 0, 1000 * (c_custkey % 49) from {customer}"),
    "_SRC_TOPIC": Facts("topic string, partitions long", "select concat('u', user_id), count(*) from {events} group by user_id"),
    "_DST_TOPIC": Facts("topic string, partitions long", "select concat('u', user_id), count(*) from {events} where event_id % 3 <> 0 group by user_id union all select concat('v', user_id), count(*) from {events} where user_id % 10 = 0 group by user_id"),
    "_SRC_TS": Facts("topic string, name string, value string", "select concat('u', c_custkey), case c_custkey % 4 when 0 then 'cleanup.policy' when 1 then 'segment.ms' when 2 then 'retention.ms' else 'other' end, c_mktsegment from {customer}"),
    "_DST_TS": Facts("topic string, name string, value string", "select concat('u', c_custkey), case c_custkey % 4 when 0 then 'cleanup.policy' when 1 then 'segment.ms' when 2 then 'retention.ms' else 'other' end, case when c_custkey % 6 = 0 then 'x' else c_mktsegment end from {customer} where c_custkey % 10 <> 0"),
    "_KEYCOLS": Facts("table string, index string, nullable boolean", "select concat('c', c_custkey % 400), case when c_custkey % 5 = 0 then null else concat('u', c_custkey % 3) end, case when c_custkey % 5 = 0 then null else c_custkey % 4 = 0 end from {customer}"),
    "_ROUT": Facts("schema string, obj_type string, name string", "select p_brand, case p_size % 3 when 0 then 'function' when 1 then 'view' else 'trigger' end, concat(p_name, ' ', p_partkey) from {part}"),
    "_SRC_LOGIN": Facts("login string, secret string, roles array<string>", "select c_name, cast(c_custkey * 7 as string), split(concat(c_mktsegment, ',r', c_nationkey), ',') from {customer}"),
    "_DST_LOGIN": Facts("login string, secret string, roles array<string>", "select c_name, cast(case when c_custkey % 9 = 0 then 1 else c_custkey * 7 end as string), case when c_custkey % 5 = 0 then split('other', ',') else split(concat('r', c_nationkey, ',', c_mktsegment), ',') end from {customer} where c_custkey % 7 <> 0 union all select concat('new', c_custkey), 'x', split('r', ',') from {customer} where c_custkey % 70 = 0"),
    "_SRC_ROLES": Facts("login string, roles array<string>", "select c_name, split(concat(c_mktsegment, ',r', c_nationkey, ',vendor'), ',') from {customer}"),
    "_DST_ROLES": Facts("login string, roles array<string>", "select c_name, case when c_custkey % 4 = 0 then split('root', ',') else split(c_mktsegment, ',') end from {customer}"),
    "_SIZES": Facts("constraint string, size long", "select 'positive', count(*) from {orders} union all select 'known', count(*) from {customer}"),
    "_SAMPLES": Facts("db string, ts long, src_rows long, dst_rows long, src_tables map<string,long>", _SAMPLE.replace("{0}", "map('t', cast(src as bigint), 'u', cast(dst as bigint))"), _SAMPLE.replace("{0}", "map(['t', 'u'], [cast(src as bigint), cast(dst as bigint)])")),
    "_EVENTS": Facts("hop string, ts long, event string", "select concat('h', user_id % 5), event_id, event_type from {events}"),
    "_POINTS": Facts("hop string, db string, tag string, ts long", "select case when user_id % 2 = 0 then 'h' else 'g' end, case when user_id % 3 = 0 then 'a' else 'b' end, event_type, event_id from {events}"),
    "_CYCLES": Facts("check string, scope string, cycle long, status string", "select 'data', concat('u', user_id), row_number() over (partition by user_id order by event_id), case (event_id * 7) % 5 when 0 then 'diff' when 1 then 'error' when 2 then 'skip' else 'ok' end from {events}"),
    "_ENDS": Facts("topic string, part long, off long", "select event_type, user_id % 4, count(*) from {events} group by event_type, user_id % 4"),
    "_BASE": Facts("topic string, part long, off long", "select event_type, user_id % 4, count(*) from {events} where event_id % 3 <> 0 and user_id % 4 <> 3 group by event_type, user_id % 4"),
    "_SRC_GROUPS": Facts("grp string, topic string, part long, off long", "select concat('g', user_id % 7), event_type, user_id % 4, count(*) from {events} group by concat('g', user_id % 7), event_type, user_id % 4"),
    "_DST_GROUPS": Facts("grp string, lag long", "select concat('g', user_id % 7), 40 * count(*) from {events} where user_id % 7 < 5 group by user_id % 7"),
    "_SRC_KV": Facts(_ENTRY, "select concat('k', event_id), case event_id % 3 when 0 then 'string' when 1 then 'set' else 'list' end, case when event_id % 3 = 0 then event_type end, case when event_id % 3 <> 0 then split(concat(event_type, ',', user_id, ',z'), ',') end from {events}"),
    "_DST_KV": Facts(_ENTRY, "select concat('k', event_id), case when event_id % 11 = 0 then 'string' when event_id % 3 = 0 then 'string' when event_id % 3 = 1 then 'set' else 'list' end, case when event_id % 3 = 0 or event_id % 11 = 0 then case when event_id % 7 = 0 then 'new' else event_type end end, case when event_id % 3 = 0 or event_id % 11 = 0 then null when event_id % 3 = 1 or event_id % 5 = 0 then split(concat('z,', user_id, ',', event_type), ',') else split(concat(event_type, ',', user_id, ',z'), ',') end from {events} where event_id % 13 <> 0 union all select concat('n', event_id), 'string', 'v', null from {events} where event_id % 100 = 0"),
    "_SRC_TTL": Facts("key string, ttl long", "select concat('k', event_id), case when event_id % 4 = 0 then -1 else 1000 * (event_id % 5000) end from {events}"),
    "_DST_TTL": Facts("key string, ttl long", "select concat('k', event_id), case when event_id % 9 = 0 then -1 when event_id % 4 = 0 then -1 else 1000 * (event_id % 5000) - 1000 * (user_id % 200) end from {events} where event_id % 6 <> 0"),
    "_BIG": Facts("key string, bytes long", "select concat('k', doc_id), length(text) from {documents}"),
    "_CLOCKS": Facts("src_s double, dst_s double", "select o_totalprice, o_totalprice + (o_custkey % 7) / cast(10 as double) from {orders}"),
    "_TABLE_SIZES": Facts("table string, n long", "select p_type, count(*) from {part} group by p_type"),
    "_SESSIONS": Facts("id long, age_s double", "select o_orderkey, o_totalprice from {orders}"),
    "_FACTS": Facts("name string, value string", "select 'wal_level', case when count(*) > 10 then 'logical' else 'replica' end from {nation} union all select 'inactive_slots', cast(sum(case when o_orderkey % 997 = 0 then 1 else 0 end) as string) from {orders} union all select 'longest_transaction_s', cast(max(o_totalprice) as string) from {orders} union all select 'tables_without_key', cast(count(*) - count(distinct c_custkey) as string) from {customer} union all select 'invalid_indexes', cast(count(*) as string) from {part} where p_size = 0"),
    "_RESULTS": Facts(_RESULT, _RESULTS),
    "_RERUN": Facts(_RESULT, "select 'data', concat('app', c_custkey % 9, ' u', c_custkey), case when c_custkey % 5 = 0 then 'diff' else 'ok' end, 'again', '', '' from {customer}"),
    "_DRILLED": Facts("scope string, n long", "select concat('app', o_custkey % 9, ' t', o_orderkey), o_orderkey % 2 from {orders} where o_orderkey % 3 = 0"),
    "_TRUSTED": Facts(_RESULT, _RESULTS + " union all select 'structural', concat('app', o_custkey % 9, ' t', o_orderkey), case when o_orderkey % 5 = 0 then 'diff' else 'ok' end, '', '', '' from {orders} where o_orderkey % 2 = 1"),
}
