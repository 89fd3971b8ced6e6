import duckdb
import pytest

from concord.llm import queries


def norm(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    pick = lambda rows, names: [tuple(map(norm, (r[names.index(c)] for c in columns))) for r in rows]
    assert sorted(pick([tuple(r) for r in df.collect()], df.columns), key=str) == sorted(pick(found.fetchall(), found.columns), key=str)


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
