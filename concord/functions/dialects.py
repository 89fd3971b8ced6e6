"""What each engine's SQL calls things: names, types, counters and the expressions of canonical text.

A dialect writes statements for an engine; nothing here runs them. ``row_number_sql`` is the row hash of
``functions.canon`` as that engine computes it, so fingerprints of both sides compare whoever computed them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class NotExpressible(ValueError):
    """An engine's SQL has no form of a column's canonical text, so its rows must be read."""


@dataclass(frozen=True)
class Dialect:
    """How one engine writes names, values, types and the parts of a fingerprint. Forms take their argument as {0}."""

    name: str
    quotes: tuple[str, str]
    #: Spark's type names in the engine's words; decimals keep their digits, other types are texts.
    types: dict[str, str]
    text_type: str
    decimal: str = "DECIMAL({0},{1})"
    #: Canonical text of a type: integer, decimal, boolean, date, timestamp, text and, where it can, double.
    texts: dict[str, str] = field(default_factory=dict)
    length: str = "length({0})"
    join: Callable[[list[str]], str] = lambda parts: " || ".join(parts)
    md5: str = "md5({0})"
    #: The sum over rows of the first sixteen hex digits of {0}, as text.
    hash_sum: str = ""
    floor: str = "floor({0} / {1})"
    #: Where a table's columns stand in ALTER TABLE.
    add_column: str = "ADD COLUMN"

    def name_of(self, name: str) -> str:
        """A name in quotes, each part of a dotted one by itself."""
        return ".".join(self.column(part) for part in name.split("."))

    def column(self, name: str) -> str:
        a, b = self.quotes
        return a + name.replace(b, b + b) + b

    def literal(self, value: object) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"

    def type_of(self, kind: T.DataType) -> str:
        if isinstance(kind, T.DecimalType):
            return self.decimal.format(kind.precision, kind.scale)
        return self.types.get(kind.typeName(), self.text_type)

    def text(self, column: str, kind: T.DataType) -> str:
        """The canonical text of a column; an error if the engine cannot tell it exactly."""
        name = "integer" if isinstance(kind, _WHOLE) else kind.typeName().replace("timestamp_ntz", "timestamp")
        name = "text" if isinstance(kind, T.StringType) else name
        if name not in self.texts:
            raise NotExpressible(f"{self.name} has no canonical text of {kind.simpleString()}")
        return self.texts[name].format(self.column(column))

    def part(self, column: str, kind: T.DataType) -> str:
        """A column's part of a row's text: a text behind its length, anything else before a mark, null as a token."""
        text = self.text(column, kind)
        whole = self.join([self.texts["integer"].format(self.length.format(text)), "':'", text]) if isinstance(kind, T.StringType) else self.join([text, "';'"])
        return f"coalesce({whole}, '~')"

    def row_md5(self, schema: T.StructType) -> str:
        return self.md5.format(self.join([self.part(f.name, f.dataType) for f in schema]))


def _reprinted(plain: str, position: str) -> str:
    """A double's shortest digits, which {0} gives as text, in the form that the canonical text has: plain from 1e-3 to 1e7, else with an exponent."""
    t = plain
    size = "abs({0})"
    sign = "case when {0} < 0 then '-' else '' end"
    body = f"ltrim({t}, '-')"
    mark = position.format(body, "'e'")
    mantissa = f"case when {mark} > 0 then substr({body}, 1, {mark} - 1) else {body} end"
    power = f"case when {mark} > 0 then cast(substr({body}, {mark} + 1) as int) else 0 end"
    point = f"case when {position.format(f'({mantissa})', chr(39) + '.' + chr(39))} > 0 then {position.format(f'({mantissa})', chr(39) + '.' + chr(39))} - 1 else length({mantissa}) end"
    digits = f"replace(({mantissa}), '.', '')"
    whole = f"ltrim({digits}, '0')"
    first = f"(length({digits}) - length({whole}))"
    exponent = f"(({power}) + ({point}) - {first} - 1)"
    shown = f"rtrim({whole}, '0')"
    scientific = f"{sign} || substr({shown}, 1, 1) || '.' || case when length({shown}) > 1 then substr({shown}, 2) else '0' end || 'E' || cast({exponent} as varchar)"
    simple = f"{t} || case when {position.format(t, chr(39) + '.' + chr(39))} > 0 then '' else '.0' end"
    return f"case when {{0}} = 0 then '0.0' when {size} >= 1e-3 and {size} < 1e7 then {simple} else {scientific} end"


#: Special values of doubles before anything else.
def _double(special: dict[str, str], rest: str) -> str:
    return "case " + " ".join(f"when {test} then '{text}'" for test, text in special.items()) + f" else {rest} end"


_BOOLEAN = "case when {0} then 't' when not {0} then 'f' end"

POSTGRES = Dialect(
    "postgres", ('"', '"'),
    {"byte": "smallint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "real", "double": "double precision", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"},
    "text", "numeric({0},{1})",
    {
        "integer": "({0})::text", "decimal": "({0})::text", "boolean": _BOOLEAN, "date": "({0} - date '1970-01-01')::text", "text": "({0})::text",
        "timestamp": "(extract(epoch from {0}) * 1000000)::bigint::text",
        "double": _double({"{0} = 'NaN'": "NaN", "{0} = 'Infinity'": "Infinity", "{0} = '-Infinity'": "-Infinity"}, _reprinted("({0})::text", "strpos({0}, {1})")),
    },
    hash_sum="coalesce(sum((('x' || substr({0}, 1, 8))::bit(32)::bigint)::numeric * 4294967296 + ('x' || substr({0}, 9, 8))::bit(32)::bigint), 0)::text",
    floor="floor({0}::numeric / {1})::bigint",
)

MYSQL = Dialect(
    "mysql", ("`", "`"),
    {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "tinyint(1)", "date": "date", "timestamp": "datetime(6)", "timestamp_ntz": "datetime(6)", "binary": "longblob"},
    "longtext", "decimal({0},{1})",
    {
        "integer": "cast({0} as char)", "decimal": "cast({0} as char)", "boolean": _BOOLEAN, "date": "cast(datediff({0}, '1970-01-01') as char)", "text": "convert({0} using utf8mb4)",
        "timestamp": "cast(timestampdiff(microsecond, '1970-01-01', {0}) as char)",
    },
    length="char_length({0})", join=lambda parts: f"concat({', '.join(parts)})",
    hash_sum="cast(coalesce(sum(cast(conv(substr({0}, 1, 16), 16, 10) as decimal(20,0))), 0) as char)",
)

MSSQL = Dialect(
    "mssql", ("[", "]"),
    {"byte": "smallint", "short": "smallint", "integer": "int", "long": "bigint", "float": "real", "double": "float", "boolean": "bit", "date": "date", "timestamp": "datetimeoffset(6)", "timestamp_ntz": "datetime2(6)", "binary": "varbinary(max)"},
    "nvarchar(max)", "decimal({0},{1})",
    {
        "integer": "cast({0} as varchar(max))", "decimal": "cast({0} as varchar(max))", "boolean": "case when {0} = 1 then 't' when {0} = 0 then 'f' end", "date": "cast(datediff(day, '1970-01-01', {0}) as varchar(max))",
        "timestamp": "cast(datediff_big(microsecond, '1970-01-01', {0}) as varchar(max))",
    },
    length="len({0} + 'x') - 1", join=lambda parts: " + ".join(parts), md5="lower(convert(varchar(32), hashbytes('MD5', {0}), 2))",
    hash_sum="cast(coalesce(sum(cast(convert(bigint, convert(varbinary(4), substring({0}, 1, 8), 2)) as decimal(38,0)) * 4294967296 + convert(bigint, convert(varbinary(4), substring({0}, 9, 8), 2))), 0) as varchar(40))",
    add_column="ADD",
)

#: ``double_text``, ``md5`` and ``hash_sum`` are functions that a connection is given before it is asked.
SQLITE = Dialect(
    "sqlite", ('"', '"'),
    {"byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "float": "REAL", "double": "REAL", "boolean": "INTEGER", "binary": "BLOB"},
    "TEXT", "NUMERIC({0},{1})",
    {"integer": "cast({0} as text)", "text": "cast({0} as text)", "double": "double_text({0})", "binary": "lower(hex({0}))"},
    hash_sum="coalesce(hash_sum({0}), '0')",
    floor="floor_div({0}, {1})",
)

DUCKDB = Dialect(
    "duckdb", ('"', '"'),
    {"byte": "tinyint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "blob"},
    "varchar", "decimal({0},{1})",
    {
        "integer": "cast({0} as varchar)", "decimal": "cast({0} as varchar)", "boolean": _BOOLEAN, "date": "cast(date_diff('day', date '1970-01-01', {0}) as varchar)", "text": "{0}",
        "timestamp": "cast(epoch_us({0}) as varchar)",
        "double": _double({"isnan({0})": "NaN", "isinf({0}) and {0} > 0": "Infinity", "isinf({0})": "-Infinity"}, _reprinted("cast({0} as varchar)", "strpos({0}, {1})")),
    },
    hash_sum="cast(coalesce(sum(cast(cast('0x' || substr({0}, 1, 16) as ubigint) as hugeint)), 0) as varchar)",
    floor="cast(floor({0} / {1}) as bigint)",
)

DIALECTS = {d.name: d for d in (POSTGRES, MYSQL, MSSQL, SQLITE, DUCKDB)}


def dialect(engine: str) -> Dialect:
    if engine not in DIALECTS:
        raise NotExpressible(f"no SQL dialect of {engine!r}")
    return DIALECTS[engine]


def counter_statements(engine: str, counter: str, value: int, called: bool = True) -> list[str]:
    """Statements that set a counter so that ``value`` is its last number, or for engines that keep the next one, its next.

    ``called`` false is a counter that has given no number yet: its next one is ``value``.
    """
    own = dialect(engine)
    if engine == "postgres":
        return [f"SELECT setval({own.literal(own.name_of(counter))}, {value}, {str(called).lower()})"]
    if engine == "mysql":
        return [f"ALTER TABLE {own.name_of(counter)} AUTO_INCREMENT = {value}"]
    if engine == "mssql":
        return [f"DBCC CHECKIDENT ({own.literal(own.name_of(counter))}, RESEED, {value})"]
    if engine == "sqlite":
        name = own.literal(counter)
        if not called:
            return [f"DELETE FROM sqlite_sequence WHERE name = {name}"]
        return [f"DELETE FROM sqlite_sequence WHERE name = {name}", f"INSERT INTO sqlite_sequence (name, seq) VALUES ({name}, {value})"]
    raise NotExpressible(f"{engine} has no counters")


def add_column(engine: str, table: str, column: str, kind: T.DataType | str) -> tuple[str, str]:
    """The statement that adds a column, and the one that takes it away again; ``kind`` is a type of the engine's own or of Spark's."""
    own = dialect(engine)
    declared = kind if isinstance(kind, str) else own.type_of(kind)
    return f"ALTER TABLE {own.name_of(table)} {own.add_column} {own.column(column)} {declared}", f"ALTER TABLE {own.name_of(table)} DROP COLUMN {own.column(column)}"
