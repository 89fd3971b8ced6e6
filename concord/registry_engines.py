"""Queries of the mechanisms that compare, repair and follow live engines, over the driver's tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.fixtures import COLUMNS, duck, duck_row_hash, pair
from concord.functions import dialects
from concord.model import Endpoint, Pair, TableMeta
from concord.operators import diff, keys, sketch, stores
from concord.plans import checks
from concord.registry import ORACLE_SQL, query
from concord.sources import pushdown
from concord.streaming import delta


def _multisets(key: str, src: str, dst: str) -> str:
    """key and kind of every key whose rows (key, v) differ, as multisets, in DuckDB."""
    side = lambda sql: f"(select {key}, string_agg(v, chr(10) order by v) as v from ({sql}) group by {key})"
    return f"""select coalesce(s.{key}, d.{key}) as {key}, case when d.v is null then 'missing' when s.v is null then 'extra' else 'changed' end as kind
        from {side(src)} s full outer join {side(dst)} d on s.{key} is not distinct from d.{key} where s.v is distinct from d.v"""


# ---- nested values

_NEST = "select event_id, concat_ws('|', epoch_us(ts), event_type, coalesce(cast({0} as varchar), '~'), user_id) as v from events"


@query(_multisets("event_id", _NEST.format("value"), "select event_id, concat_ws('|', epoch_us(ts) + case when event_id % 77 = 0 then 1 else 0 end, event_type, coalesce(cast(case when event_id % 91 = 0 then null else value end as varchar), '~'), user_id + case when event_id % 59 = 0 then 1 else 0 end) as v from events where event_id % 83 <> 0"))
def nested_diff(spark, sf_dir):
    """Arrays of times, maps and structs that differ by a microsecond, a null or a part; the order of a map's entries is none."""
    events = pair(spark, sf_dir, "events")

    def nested(df, micros, value, user, turned):
        entries = [F.lit("type"), F.col("event_type"), F.lit("value"), value.cast("string")]
        entries = entries[2:] + entries[:2] if turned else entries
        times = F.array(F.lit("2020-01-01").cast("timestamp"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros))
        return df.select("event_id", times.alias("times"), F.create_map(*entries).alias("entries"), F.struct(F.array(user).alias("ids"), F.struct("event_type").alias("deep")).alias("who"))

    src = nested(events, F.lit(0), F.col("value"), F.col("user_id"), False)
    shift = lambda n: F.when(F.col("event_id") % n == 0, 1).otherwise(0)
    dst = nested(events.where("event_id % 83 <> 0"), shift(77), F.when(F.col("event_id") % 91 != 0, F.col("value")), F.col("user_id") + shift(59), True)
    return diff.differences(src, dst, ["event_id"])


# ---- pairs of two engines

_HETERO = "select o_orderkey, concat_ws('|', cast(round(cast(o_totalprice as decimal(15,2)), 2) as varchar), o_orderkey % 2 = 0, cast(o_orderdate as date), o_custkey) as v from {0}"
_HETERO_DIFF = _multisets("o_orderkey", _HETERO.format("orders"), _HETERO.format(duck("orders_dst")))


@query(
    f"""select 'schema' as "check", 'sales.orders' as scope, 'ok' as status, '' as detail
    union all select 'counts', 'sales.orders', case when s = d then 'ok' else 'diff' end, 'src=' || s || ' dst=' || d from (select (select count(*) from orders) as s, (select count(*) from {duck('orders_dst')}) as d)
    union all select 'data', 'sales.orders', case when missing + extra + changed > 0 then 'diff' else 'ok' end, 'missing=' || missing || ' extra=' || extra || ' changed=' || changed || case when changed > 0 then ' columns=price' else '' end
    from (select count(*) filter (where kind = 'missing') as missing, count(*) filter (where kind = 'extra') as extra, count(*) filter (where kind = 'changed') as changed from ({_HETERO_DIFF}))"""
)
def hetero_check(spark, sf_dir):
    """A check of a pair of two engines: other names, decimals against doubles, booleans against 0/1, dates against times, numbers as texts."""

    def read(side, name):
        orders = pair(spark, sf_dir, "orders" if side == "src" else "orders_dst")
        price, day = F.col("o_totalprice").cast("decimal(15,2)"), F.col("o_orderdate").cast("date")
        if side == "src":
            return orders.select("o_orderkey", price.alias("price"), (F.col("o_orderkey") % 2 == 0).alias("even"), day.alias("day"), F.col("o_custkey").cast("string").alias("customer"))
        return orders.select(F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_custkey").alias("Customer"), day.cast("timestamp").alias("DAY"), (1 - F.col("o_orderkey") % 2).cast("tinyint").alias("even"), price.cast("double").alias("Price"))

    two = Pair("two", "hetero", Endpoint(host="a"), Endpoint(host="b"), tables=("sales.orders",), meta={"sales.orders": TableMeta(key=("o_orderkey",))}, read=read)
    return checks.check(spark, two, ("schema", "counts", "data")).select("check", "scope", "status", "detail")


# ---- fingerprints by the engine, and the descent

_ORDERS_SCHEMA = T.StructType([T.StructField(n, {"i": T.LongType(), "s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampType()}[k]) for n, k in COLUMNS["orders"].items()])
_ORDER_HASH = duck_row_hash(COLUMNS["orders"])
_PUSHED = pushdown.fingerprint_sql(dialects.DUCKDB, "orders_dst", _ORDERS_SCHEMA, "o_orderkey", 4096)


@query(f"with orders_dst as {duck('orders_dst')} {_PUSHED}")
def pushed_fingerprint(spark, sf_dir):
    """Ranges as Spark sums them; the SQL is the statement that an engine is sent for the same."""
    return pushdown.FrameSide(pair(spark, sf_dir, "orders_dst").select(*COLUMNS["orders"]), "o_orderkey").chunks(4096)


@query(f"select * from ({_multisets('o_orderkey', *(f'select o_orderkey, {_ORDER_HASH} as v from {t}' for t in ('orders', duck('orders_dst'))))})")
def descent_diff(spark, sf_dir):
    """The keys that differ, from rows of ranges that differ alone."""
    src, dst = (pushdown.FrameSide(pair(spark, sf_dir, t).select(*COLUMNS["orders"]), "o_orderkey") for t in ("orders", "orders_dst"))
    return pushdown.differences(src, dst, "o_orderkey")


# ---- sketches and keys


@query(ORACLE_SQL["descent_diff"])
def sketch_diff(spark, sf_dir):
    """The keys that differ, from two tables of cells."""
    src, dst = (pair(spark, sf_dir, t).select(*COLUMNS["orders"]) for t in ("orders", "orders_dst"))
    return sketch.reconcile(src, dst, ["o_orderkey"])


_KEYED = {"orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"], "conversations": ["conv_id", "turn", "role"]}


def _keys_sql(table: str, columns: list[str]) -> str:
    """The sets of up to three columns that are keys and of which no part is, by counting each."""
    sets = [s for k in (1, 2, 3) for s in combinations(columns, k)]
    is_key = "\n union all ".join(f"select '{','.join(s)}' as columns, {len(s)} as width, [{', '.join(repr(c) for c in s)}] as names, (select count(*) from (select distinct {', '.join(s)} from {table})) = (select count(*) from {table}) as ok" for s in sets)
    return f"(with k as ({is_key}) select '{table}' as table_name, columns from k where ok and not exists (select 1 from k p where p.ok and p.width < k.width and list_has_all(k.names, p.names)))"


@query(" union all ".join(f"select * from {_keys_sql(t, c)}" for t, c in _KEYED.items()))
def minimal_keys(spark, sf_dir):
    """The smallest sets of columns that tell the rows of a table apart."""
    rows = [(t, ",".join(s)) for t, c in _KEYED.items() for s in keys.minimal_keys(pair(spark, sf_dir, t), c)]
    return spark.createDataFrame(rows, "table_name string, columns string")


# ---- keys as multisets, as checks and repairs compare them

_V, _X = "coalesce(length(v) || ':' || v, '~')", "coalesce(cast(x + 0 as varchar) || ';', '~')"
_BAGS, _BAGS_DST = duck("bags_src"), duck("bags_dst")
_PART = COLUMNS["part"]
_PART_ROWS = f"select p_partkey, {duck_row_hash(_PART)} as v from {{0}}"


def _bag(table: str, text: str) -> str:
    return f"(select k, count(*) as n, string_agg({text}, chr(10) order by {text}) as t from {table} group by k)"


@query(f"""select coalesce(s.k, d.k) as k, case when d.n is null then 'missing' when s.n is null then 'extra' when s.t <> d.t then 'changed' else 'same' end as kind
    from {_bag(_BAGS, f'{_V} || {_X}')} s full outer join {_bag(_BAGS_DST, f'{_V} || {_X}')} d on s.k is not distinct from d.k where coalesce(s.k, d.k) % 3 = 0""")
def restricted_multisets(spark, sf_dir):
    """Kinds of the given keys, under each of which both sides hold many rows."""
    src, dst = pair(spark, sf_dir, "bags_src"), pair(spark, sf_dir, "bags_dst")
    return diff.restricted(src, dst, src.union(dst).select("k").where("k % 3 = 0"), ["k"])


@query(" union all ".join(f"select * from (select '{c}' as \"column\", count(*) as n_diff from {_bag(_BAGS, t)} s join {_bag(_BAGS_DST, t)} d on s.k is not distinct from d.k where s.t <> d.t or s.n <> d.n) where n_diff > 0" for c, t in (("v", _V), ("x", _X))))
def column_drift_multisets(spark, sf_dir):
    """In how many keys that both sides have the values of a column differ, null keys and repeated ones included."""
    return diff.column_drift(pair(spark, sf_dir, "bags_src"), pair(spark, sf_dir, "bags_dst"), ["k"])


def _ranked(table: str) -> str:
    return f"(select k, v, cast(x + 0 as varchar) as x, row_number() over (partition by k order by {_V} || {_X}) as r from {table})"


_CHANGED = f"(select s.k from {_bag(_BAGS, f'{_V} || {_X}')} s join {_bag(_BAGS_DST, f'{_V} || {_X}')} d on s.k is not distinct from d.k where s.t <> d.t)"


@query(" union all ".join(f"select coalesce(cast(s.k as varchar), '\\N') as key, '{c}' as \"column\", s.{c} as src_value, d.{c} as dst_value from {_ranked(_BAGS)} s join {_ranked(_BAGS_DST)} d on s.k is not distinct from d.k and s.r = d.r where s.{c} is distinct from d.{c} and exists (select 1 from {_CHANGED} c where c.k is not distinct from s.k)" for c in ("v", "x")))
def sample_compare_multisets(spark, sf_dir):
    """Differing values of repeated keys, whose rows are paired in the order of their texts."""
    return diff.sample_compare(pair(spark, sf_dir, "bags_src"), pair(spark, sf_dir, "bags_dst"), ["k"])


_PART_KINDS = f"select s.p_partkey, case when s.v <> d.v then 'changed' else 'same' end as kind from ({_PART_ROWS.format('part')}) s join ({_PART_ROWS.format(duck('part_dst'))}) d on s.p_partkey = d.p_partkey"


@query(f"select kind, count(*) as n from ({_PART_KINDS}) where p_partkey in (select p_partkey from part order by md5('probe' || cast(p_partkey as varchar)) limit 300) group by 1")
def probe_multisets(spark, sf_dir):
    return diff.probe(pair(spark, sf_dir, "part").select(*_PART), pair(spark, sf_dir, "part_dst").select(*_PART), ["p_partkey"], 300)


@query(f"select * from ({_PART_KINDS}) where kind <> 'same' and p_partkey % 4 <> 1")
def touched_multisets(spark, sf_dir):
    src, dst = (pair(spark, sf_dir, t).select(*_PART) for t in ("part", "part_dst"))
    return delta.verify_touched(src, dst, src.select("p_partkey").where("p_partkey % 4 <> 1"), ["p_partkey"])


# ---- nested documents

_DEEP = {"$": "'object'", "$.turn": "'int'", "$['a.b']": "'object'", "$['a.b'].role": "'string'", "$['a.b'].n": "'array'", "$.x": "case when conv_id % 3 = 0 then 'double' else 'int' end"}


@query(" union all ".join(f"select '{path.replace(chr(39), chr(39) * 2)}' as path, {kind} as type, count(*) as n from conversations group by 2" for path, kind in _DEEP.items()) + " union all select '$[''a.b''].n[*]', 'variant', count(*) from conversations")
def nested_paths(spark, sf_dir):
    """Types by path of documents made of conversations: nested objects, arrays of mixed elements, names with dots."""
    return stores.path_types(pair(spark, sf_dir, "docs_nested"))


@query("select * from (values ('$.turn', 'int', 'string'), ('$.x', case when (select count(*) from conversations where conv_id % 3 = 0) > 0 then 'double' else 'int' end, 'int'), ('$.new', null, case when (select count(*) from conversations where conv_id % 5 = 0) > 0 then 'object' end)) t(path, src_type, dst_type) where src_type is distinct from dst_type")
def nested_path_drift(spark, sf_dir):
    return stores.path_drift(pair(spark, sf_dir, "docs_nested"), pair(spark, sf_dir, "docs_nested_dst"))
