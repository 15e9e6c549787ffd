"""Every registered query against its SQL on the smallest scale."""

import pytest

from tunekit_checks.compare import connect, rows_of
from tunekit_checks.oracle import oracle_sql
from tunekit_checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(REGISTRY)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = REGISTRY[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["json_shape", "csv_ragged", "csv_header_union"])
def test_files_grow_with_rows(spark, con, name, monkeypatch):
    from tunekit_checks import queries

    paths, work_dir = [], queries.work_dir
    monkeypatch.setattr(queries, "FILE_ROWS", 10, raising=False)
    monkeypatch.setattr(queries, "work_dir", lambda *a: paths.append(work_dir(*a)) or paths[-1])
    df = REGISTRY[name](spark, SF)
    result = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())
    written = spark.read.format("binaryFile").load(paths[0]).where("length > 0")
    assert written.count() > 16
