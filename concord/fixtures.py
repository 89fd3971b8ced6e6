"""Source and target pairs derived from the driver's tables, in a form that Spark and DuckDB both run.

Tables in braces are DataFrames on the Spark side and views of the same name in DuckDB. Small catalog
tables are given as literal rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from concord.session import table

#: Columns of the compared tables with their kinds: i integer, d double, t timestamp, s string.
COLUMNS = {
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "s", "text": "s"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
}

PAIRS = {
    "orders_dst": """select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 89 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority
        from {orders} where o_orderkey % 97 <> 0
        union all select o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from {orders} where o_orderkey % 101 = 0""",
    "lineitem_dst": "select * from {lineitem} where l_orderkey % 97 <> 0 union all select * from {lineitem} where l_orderkey % 101 = 0",
    "events_dst": "select event_id, ts + interval '8' hour as ts, user_id, event_type, value, props from {events}",
    "part_dst": "select p_partkey, p_name, p_brand, p_type, p_size, case when p_partkey % 7 = 0 then p_retailprice * 1.001 else p_retailprice end as p_retailprice from {part}",
    "text_src": "select doc_id, case when doc_id % 10 = 0 then null else text end as text, lang from {documents}",
    "text_dst": "select doc_id, case when doc_id % 10 = 0 then '' else text end as text, lang from {documents}",
    "fffd_dst": "select doc_id, case when doc_id % 50 = 0 then concat(text, chr(65533)) else text end as text from {documents}",
    "labels_dst": "select case when doc_id % 13 = 0 then doc_id + 1000000 else doc_id end as doc_id, quality, toxic from {labels}",
    "bags_src": "select nullif(o_custkey % 40, 0) as k, o_orderstatus as v, cast(o_orderkey % 3 as double) as x from {orders}",
    "bags_dst": "select nullif(o_custkey % 40, 0) as k, case when o_orderkey % 997 = 0 then 'Z' else o_orderstatus end as v, cast(o_orderkey % 3 as double) as x from {orders} where o_custkey % 40 <> 7 union all select 1000 + o_orderkey % 2, null, null from {orders} where o_orderkey % 500 = 0",
    "part_exact_dst": "select p_partkey, p_name, p_brand, p_type, p_size, case when p_partkey % 11 = 0 then p_retailprice + 0.0000001 else p_retailprice end as p_retailprice from {part}",
    "names": "select c_custkey as id, c_mktsegment as name from {customer} union all select c_custkey + 1000000000, lower(c_mktsegment) from {customer}",
    "net": "select l_orderkey, l_linenumber, l_extendedprice, l_discount, case when l_orderkey % 11 = 0 then cast(0 as double) else l_extendedprice * (1 - l_discount) end as net from {lineitem}",
    "conversations_dst": "select conv_id, turn, role, case when turn = 1 and conv_id % 5 = 0 then concat(text, '!') else text end as text from {conversations} where not (conv_id % 7 = 0 and turn = 0)",
    "log": "select event_type as topic, user_id % 4 as part, row_number() over (partition by event_type, user_id % 4 order by event_id) - 1 as off, event_id as key, props as v from {events}",
    "ticks": "select 'events' as series, cast(floor(event_id / 100) as bigint) as tick, count(*) as n from {events} group by 2",
    "counters_src": """select 'orders' as counter, max(o_orderkey) as last_value, 1 as increment, true as is_called, true as owned from {orders}
        union all select 'part', max(p_partkey), 1, true, true from {part} union all select 'customer', max(c_custkey), 1, true, true from {customer}
        union all select 'supplier', max(s_suppkey), 1, true, false from {supplier} union all select 'events', max(event_id), 1, true, true from {events}""",
    "counters_dst": """select 'orders' as counter, min(o_orderkey) as last_value, 1 as increment, false as is_called, true as owned from {orders}
        union all select 'part', max(p_partkey), 1, true, true from {part} union all select 'customer', max(c_custkey) - 5, 1, true, true from {customer}
        union all select 'supplier', min(s_suppkey), 1, false, false from {supplier}""",
    "counter_maxima": """select 'orders' as counter, max(o_orderkey + case when o_orderkey % 101 = 0 then 1000000 else 0 end) as high from {orders}
        union all select 'part', max(p_partkey) from {part} union all select 'customer', max(c_custkey) from {customer} union all select 'supplier', max(s_suppkey) from {supplier}""",
    "order_lines": """select concat('0/', hex(o_orderkey)) as lsn, case when o_orderkey % 13 = 0 then concat('BEGIN ', o_orderkey)
        when o_orderkey % 11 = 0 then concat('table public.plain: INSERT: note[text]:', chr(39), o_orderpriority, chr(39))
        when o_orderkey % 5 = 0 then concat('table public.keyed: INSERT: cust[integer]:', o_custkey, ' prio[text]:', chr(39), o_orderstatus, chr(39), chr(39), o_orderpriority, chr(39), ' v[text]:', chr(39), 'cust[integer]:7', chr(39))
        else concat('table public.orders: ', case o_orderkey % 3 when 0 then 'DELETE' when 1 then 'UPDATE' else 'INSERT' end, ': o_orderkey[bigint]:', o_orderkey, ' note[text]:', chr(39), o_orderpriority, chr(39)) end as line from {orders}""",
    "order_positions": "select 'src' as side, concat('0/', hex(max(o_orderkey))) as lsn from {orders} union all select 'dst', concat('0/', hex(min(o_orderkey))) from {orders}",
    "order_versions": "select o_orderpriority as tbl, o_orderkey as version from {orders}",
    "order_images": "select case when o_orderkey % 7 <> 0 then o_orderkey end as before_id, case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then o_orderkey + 1000000000 else o_orderkey end as after_id from {orders}",
    "event_feed": """select concat('{{"_id": {{"_data": "', event_id, '"}}, "operationType": "', case when event_id % 9 = 0 then 'drop' when event_id % 2 = 0 then 'insert' else 'delete' end, '", "documentKey": {{"_id": ', case when event_id % 3 = 0 then concat('{{"$oid": "', user_id, '"}}') else concat('"', user_id, '"') end, '}}}}') as line from {events}""",
    "docs_nested": """select conv_id as id, concat('{{"turn": ', turn, ', "a.b": {{"role": "', role, '", "n": [', length(text), ', {{"deep": ', case when turn % 2 = 0 then 'true' else 'null' end, '}}]}}, "x": ', case when conv_id % 3 = 0 then '1.5' else '2' end, '}}') as doc from {conversations}""",
    "docs_nested_dst": """select conv_id as id, concat('{{"turn": "', turn, '", "a.b": {{"role": "', role, '", "n": [', length(text), ', {{"deep": ', case when turn % 2 = 0 then '1' else 'null' end, '}}]}}', case when conv_id % 5 = 0 then ', "new": {{}}' else '' end, ', "x": 2}}') as doc from {conversations}""",
    "secret_lines": "select concat('postgresql://u', c_custkey, ':p', c_custkey, '@h/db password=', c_custkey, ' next') as line from {customer}",
    "order_seconds": "select o_orderkey, o_totalprice as s from {orders}",
    "docs_json": "select event_id as id, props as doc from {events}",
    "docs_json_dst": "select event_id as id, case when event_id % 50 = 0 then '{{\"k\": null}}' when event_id % 77 = 0 then '{{}}' when event_id % 3 <> 0 then '{{\"k\": \"x\"}}' else props end as doc from {events} where event_id % 91 <> 0",
}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")


def run_text(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A select over tables in braces, in Spark."""
    used = {n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text}
    # the code point function is named differently in Spark, whose chr() takes its argument modulo 256
    return spark.sql(text.replace("chr(65533)", "'\ufffd'"), **used)


def duck_text(text: str) -> str:
    """The same select in DuckDB."""
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")


def pair(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a driver table under its own name."""
    return run_text(spark, sf_dir, PAIRS[name]) if name in PAIRS else table(spark, sf_dir, name)


def duck(name: str) -> str:
    """The same table as a DuckDB subquery."""
    return f"({duck_text(PAIRS[name])})" if name in PAIRS else f"(select * from {name})"


def duck_fields(columns: dict[str, str], prefix: str = "") -> list[str]:
    """Canonical text of each column in DuckDB, as ``functions.canon`` defines it."""
    forms = {"i": "cast({0} as varchar)", "s": "{0}", "d": "cast({0} + cast(0 as double) as varchar)", "t": "cast(epoch_us({0}) as varchar)"}
    return [forms[kind].format(prefix + name) for name, kind in columns.items()]


def duck_row_hash(columns: dict[str, str], mode: str = "length", prefix: str = "") -> str:
    parts = duck_fields(columns, prefix)
    if mode == "length":
        measured = [f"cast(length({p}) as varchar) || ':' || {p}" if kind == "s" else f"{p} || ';'" for p, kind in zip(parts, columns.values())]
        return "md5(" + " || ".join(f"coalesce({m}, '~')" for m in measured) + ")"
    separator, null = {"pipe": ("|", "~"), "hash": ("#", "~null~")}[mode]
    return f"md5(concat_ws('{separator}', " + ", ".join(f"coalesce({p}, '{null}')" for p in parts) + "))"


def duck_number(md5: str) -> str:
    return f"cast(cast('0x' || substr({md5}, 1, 16) as ubigint) as hugeint)"


@dataclass(frozen=True)
class Derived:
    """A derived table whose column ``given`` is called ``name``, a word that one of the two dialects keeps for itself."""

    table: str
    given: str
    name: str

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return pair(spark, sf_dir, self.table).withColumnRenamed(self.given, self.name)

    def sql(self) -> str:
        return f'(select {self.given} as "{self.name}", * exclude ({self.given}) from {duck(self.table)})'
