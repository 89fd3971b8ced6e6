"""Readers of both sides: files, JDBC, SQLite, key-value dumps, logs and documents, by engine name."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing, contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from concord.model import SYSTEM_PREFIXES, Endpoint, Pair, TableMeta
from concord.functions import dialects
from concord.operators import align
from concord.sources import catalogs, pushdown
from concord.sources.retry import retried

#: Other names of the same engines.
ALIASES = {"postgresql": "postgres", "pg": "postgres", "mariadb": "mysql", "mongo": "mongodb", "sqlserver": "mssql", "sqlite3": "sqlite", "files": "parquet", "valkey": "redis", "redpanda": "kafka"}
JDBC = {"postgres": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}?connectionTimeZone=UTC", "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}"}
FILES = ("parquet", "orc", "json", "csv")
#: A live engine is asked for this many ranges of a table at most.
MAX_RANGES = 2000
SYSTEM_DATABASES = ("template0", "template1", "postgres", "information_schema", "performance_schema", "mysql", "sys", "admin", "config", "local", "master", "tempdb", "model", "msdb")


def engine_of(name: str) -> str:
    """The engine behind a name; unknown names are errors."""
    engine = ALIASES.get(name.lower(), name.lower())
    if engine not in READERS:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(READERS))}")
    return engine


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite")`` with options ``path``, ``table``, ``partitions`` and ``where``; read only.

    Partitions are ranges of rowid, each read by its own task through its own connection; a table without rowids
    is one. A column is what it was declared as if all its values are, else a column of texts.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        whole, real = ("bigint", "integer"), ("double", "real")
        kinds = {"INTEGER": whole, "INT": whole, "BIGINT": whole, "REAL": real, "FLOAT": real, "DOUBLE": real, "BLOB": ("binary", "blob")}
        table = _name(self.options["table"])
        with sqlite_connection(self.options["path"]) as db:
            columns = [(c[1], kinds.get(c[2].upper().split("(")[0])) for c in db.execute(f"pragma table_info({table})")]
            typed = [(name, kind) for name, kind in columns if kind]
            odd = db.execute("select " + ", ".join(f"max(typeof({_name(n)}) not in ('{k[1]}', 'null'{', ' + repr('integer') if k == real else ''}))" for n, k in typed) + f" from {table}").fetchone() if typed else ()
        mixed = {name for (name, _), x in zip(typed, odd) if x}
        return ", ".join(f"`{name}` {kind[0] if kind and name not in mixed else 'string'}" for name, kind in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SQLiteReader(dict(self.options), schema)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, [f.name for f in schema.fields]
        cast = {"string": str, "double": float}
        self.casts = [cast.get(f.dataType.typeName(), lambda v: v) for f in schema.fields]

    def partitions(self) -> list[_Range]:
        with sqlite_connection(self.options["path"]) as db:
            try:
                low, high = db.execute(f"select min(rowid), max(rowid) from {_name(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a table without rowids
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, 0)]
        n = max(1, int(self.options.get("partitions", 1)))
        width = (high - low) // n + 1
        return [_Range(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(map(_name, self.names))
        sql, values = f"select {columns} from {_name(self.options['table'])}", ()
        conditions = [f"({self.options['where']})"] if self.options.get("where") else []
        if partition.low is not None:
            conditions, values = [*conditions, "rowid >= ? and rowid < ?"], (partition.low, partition.high)
        with sqlite_connection(self.options["path"]) as db:
            for row in db.execute(sql + (" where " + " and ".join(conditions) if conditions else ""), values):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, self.casts))


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def sqlite_connection(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection that is closed at the end."""
    with closing(sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)) as db:
        yield db


def sqlite_tables(path: str) -> list[str]:
    with sqlite_connection(path) as db:
        return [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]


def sqlite_counters(path: str) -> dict[str, int]:
    with sqlite_connection(path) as db:
        known = db.execute("select 1 from sqlite_master where name = 'sqlite_sequence'").fetchone()
        return dict(db.execute("select name, seq from sqlite_sequence")) if known else {}


def read_files(spark: SparkSession, end: Endpoint, database: str, table: str, kind: str = "parquet") -> DataFrame:
    root = "/".join(x for x in (end.options["path"].rstrip("/"), database) if x)
    reader = spark.read.format(kind)
    if kind == "csv":
        # an empty string and a null stay apart: nulls are a token, empty strings are quoted
        reader = reader.option("header", True).option("nullValue", "\\N").option("emptyValue", "")
    return reader.load(f"{root}/{table}.{kind}")


def read_jdbc(spark: SparkSession, end: Endpoint, database: str, table: str, kind: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table or, with ``query`` in the options, a query. Bounds deal rows to tasks, they drop none."""
    reader = spark.read.format("jdbc").option("url", end.options.get("url") or JDBC[kind].format(host=end.host, port=end.port, database=database)).option("user", end.user).option("password", end.password)
    reader = reader.option("query", end.options["query"]) if "query" in end.options else reader.option("dbtable", table)
    if key and bounds and "query" not in end.options:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def read_query(spark: SparkSession, end: Endpoint, database: str, kind: str, sql: str) -> DataFrame:
    """The rows of one query on a live engine."""
    return read_jdbc(spark, Endpoint(end.host, end.port, end.user, end.password, {**end.options, "query": sql}), database, "", kind)


def _quoted(kind: str, column: str) -> str:
    return dialects.dialect(kind).column(column) if kind in dialects.DIALECTS else column


def read_by_key(spark: SparkSession, end: Endpoint, database: str, table: str, kind: str, key: tuple[str, ...], slice_rows: int, workers: int) -> DataFrame:
    """A table read in ranges of its key, if that is one integer column; the ranges come from its least and largest key."""
    if len(key) == 1:
        low, high = read_query(spark, end, database, kind, f"select min({_quoted(kind, key[0])}) as low, max({_quoted(kind, key[0])}) as high from {table}").first()
        if isinstance(low, int) and high > low:
            ranges = max(workers, -(-(high - low + 1) // slice_rows))
            return read_jdbc(spark, end, database, table, kind, key[0], (low, high + 1), min(ranges, MAX_RANGES))
    return read_jdbc(spark, end, database, table, kind)


def read_sqlite(spark: SparkSession, end: Endpoint, database: str, table: str, partitions: int = 4, where: str = "") -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", end.options["path"]).option("table", table).option("partitions", partitions).option("where", where).load()


def read_documents(spark: SparkSession, end: Endpoint, database: str, table: str) -> DataFrame:
    """id, doc: one JSON text for each line of an export."""
    lines = spark.read.text("/".join(x for x in (end.options["path"].rstrip("/"), database, f"{table}.jsonl") if x))
    return lines.select(F.coalesce(F.get_json_object("value", "$._id.$oid"), F.get_json_object("value", "$._id")).alias("id"), F.col("value").alias("doc"))


def read_entries(spark: SparkSession, end: Endpoint, database: str, table: str) -> DataFrame:
    """A key-value dump: key, type, str, hash, items, scores, ttl."""
    schema = "key string, type string, str string, hash map<string,string>, items array<string>, scores map<string,double>, ttl bigint, bytes bigint"
    return spark.read.schema(schema).json("/".join(x for x in (end.options["path"].rstrip("/"), database, f"{table}.jsonl") if x))


def read_log(spark: SparkSession, end: Endpoint, database: str, table: str) -> DataFrame:
    """topic, part, off, key, v of a log: from a broker where its connector is there, else from files."""
    if "bootstrap" in end.options:
        raw = spark.read.format("kafka").option("kafka.bootstrap.servers", end.options["bootstrap"]).option("subscribe", table).load()
        return raw.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("v"))
    return read_files(spark, end, database, table, end.options.get("format", "parquet"))


READERS = {
    **{kind: (lambda s, e, d, t, kind=kind: read_files(s, e, d, t, kind)) for kind in FILES},
    **{kind: (lambda s, e, d, t, kind=kind: read_jdbc(s, e, d, t, kind)) for kind in JDBC},
    "generic": lambda s, e, d, t: read_jdbc(s, e, d, t, "generic"),
    "sqlite": read_sqlite,
    "mongodb": read_documents,
    "redis": read_entries,
    "kafka": read_log,
    "hetero": None,
}


def bind(spark: SparkSession, pair: Pair, database: str = "") -> Pair:
    """Give ``pair`` its readers, tables and what the catalogs say; a mixed pair reads each side with its own engine.

    Keys that the configuration names come before those of the source's catalog.
    """
    engine = engine_of(pair.engine)
    kinds = {"src": engine, "dst": engine}
    if engine == "hetero":
        kinds = {"src": engine_of(pair.options["source_engine"]), "dst": engine_of(pair.options["target_engine"])}
    ends = {"src": pair.source, "dst": pair.target}
    ask = {side: (lambda end, db, sql, kind=kinds[side]: retried(lambda: read_query(spark, end, db, kind, sql))) for side in ends}

    def read(side: str, table: str) -> DataFrame:
        kind, db = kinds[side], pair.side_db(side, database)
        if kind in JDBC:
            meta = pair.meta.get(table)
            return read_by_key(spark, ends[side], db, table, kind, meta.key if meta else (), pair.slice, pair.workers)
        return READERS[kind](spark, ends[side], db, table)

    def facts(side: str, kind: str) -> DataFrame | None:
        db = pair.side_db(side, database)
        if kinds[side] == "sqlite":
            return sqlite_facts(spark, ends[side].options["path"], kind)
        if kinds[side] in FILES:
            return file_facts(spark, ends[side], db, kind)
        return catalogs.facts(spark, ask[side], ends[side], db, kinds[side], kind)

    def push(side: str, table: str, key: str) -> pushdown.SqlSide | None:
        """The side as an engine that sums it up itself; None where it has no SQL."""
        kind, db, end = kinds[side], pair.side_db(side, database), ends[side]
        table = pair.names.get(table, table) if side == "dst" else table
        if kind == "sqlite":
            query, rows = pushdown.sqlite_ask(spark, end.options["path"]), lambda where: read_sqlite(spark, end, db, table, where=where)
        elif kind in dialects.DIALECTS:
            query = lambda sql: [tuple(r) for r in ask[side](end, db, sql).collect()]
            rows = lambda where: read_query(spark, end, db, kind, f"select * from {dialects.dialect(kind).name_of(table)} where {where}")
        else:
            return None
        return pushdown.SqlSide(dialects.dialect(kind), table, read(side, table).schema, key, query, rows)

    pair.read, pair.facts, pair.push = read, facts, push
    if not pair.tables:
        given = pair.options.get("tables")
        pair.tables = tuple(given or list_tables(spark, ends["src"], kinds["src"], database))
        there = None if given and engine != "hetero" else tuple(list_tables(spark, ends["dst"], kinds["dst"], pair.side_db("dst", database)))
        if engine == "hetero":
            pair.names = align.resolve(pair.tables, there)
            back = {theirs: ours for ours, theirs in pair.names.items()}
            there = tuple(back.get(t, t) for t in there)
        pair.target_tables = None if given else there
    if kinds["src"] in JDBC:
        pair.meta = catalogs.table_meta(ask["src"], ends["src"], database, kinds["src"]) | pair.meta
    elif kinds["src"] == "sqlite":
        pair.meta = sqlite_meta(ends["src"].options["path"]) | pair.meta
    return pair


def list_tables(spark: SparkSession, end: Endpoint, engine: str, database: str = "") -> list[str]:
    """Table names of a side, without system tables. An engine whose tables cannot be listed is an error, not an empty list."""
    if engine == "sqlite":
        return sqlite_tables(end.options["path"])
    if engine in JDBC:
        return catalogs.table_names(lambda e, d, sql: read_query(spark, e, d, engine, sql), end, database, engine)
    suffix = {"mongodb": "jsonl", "redis": "jsonl"}.get(engine, engine)
    if engine in (*FILES, "mongodb", "redis"):
        root = "/".join(x for x in (end.options["path"].rstrip("/"), database) if x)
        return sorted(n.removesuffix(f".{suffix}") for n in folder(spark, root) if n.endswith(f".{suffix}") and not n.startswith(SYSTEM_PREFIXES))
    raise ValueError(f"tables of {engine!r} cannot be listed; name them as options.tables")


def folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def file_facts(spark: SparkSession, end: Endpoint, database: str, kind: str) -> DataFrame | None:
    """Facts that an export has laid beside its tables, as _catalog/<kind>.json."""
    root = "/".join(x for x in (end.options["path"].rstrip("/"), database, "_catalog") if x)
    return spark.read.json(f"{root}/{kind}.json") if f"{kind}.json" in folder(spark, root) else None


def sqlite_facts(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    if kind == "counters":
        rows = [(t, n, 1, True, True) for t, n in sqlite_counters(path).items()]
        return spark.createDataFrame(rows, "table string, last_value long, increment long, is_called boolean, owned boolean")
    if kind == "objects":
        with sqlite_connection(path) as db:
            rows = db.execute("select type, name from sqlite_master where name not like 'sqlite_%'").fetchall()
        return spark.createDataFrame(rows, "obj_type string, obj_name string")
    if kind == "params":
        with sqlite_connection(path) as db:
            rows = [(p, str(db.execute(f"pragma {p}").fetchone()[0])) for p in ("encoding", "user_version", "application_id", "page_size")]
        return spark.createDataFrame(rows, "name string, value string")
    return None


def sqlite_meta(path: str) -> dict[str, TableMeta]:
    """Keys and references of each table, as its own catalog has them."""
    found = {}
    with sqlite_connection(path) as db:
        for table in sqlite_tables(path):
            key = tuple(c[1] for c in sorted(db.execute(f'pragma table_info("{table}")').fetchall(), key=lambda c: c[5]) if c[5])
            references: dict[int, list] = {}
            for r in db.execute(f'pragma foreign_key_list("{table}")').fetchall():
                references.setdefault(r[0], []).append((r[1], r[2], r[3], r[4]))
            foreign = []
            for rows in references.values():
                rows.sort()
                if all(r[3] for r in rows):
                    foreign.append((tuple(r[2] for r in rows), rows[0][1], tuple(r[3] for r in rows)))
            found[table] = TableMeta(key=key, foreign=tuple(foreign))
    return found


def catalog_tables(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.name.startswith(SYSTEM_PREFIXES))


def user_databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_DATABASES)


def settings(spark: SparkSession) -> DataFrame:
    """name, value of the session's own settings."""
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value")


def sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by key: the same rows on both sides."""
    return df.orderBy(*key).limit(n)


def integer_key(df: DataFrame, key: list[str]) -> str | None:
    """The key column if there is one alone and it is an integer: such tables can be cut into ranges."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return key[0] if len(key) == 1 and kinds.get(key[0]) in ("byte", "short", "integer", "long") else None
