import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_training_data_package():
    root = pathlib.Path(core.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text(), f
