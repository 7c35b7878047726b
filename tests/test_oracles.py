"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import bindings
from quillspark.plans.queries import ORACLES, QUERIES
from tests.conftest import SMALL


def rows(df: pd.DataFrame) -> list[tuple]:
    one = lambda v: "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
        assert len(got)  # a check of nothing against nothing shows nothing
    else:
        assert len(got)


def test_whole_texts(spark):
    """Notes hold the whole texts that they are made of."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    longest = docs.loc[docs.text.str.len().idxmax()]
    note = bindings.notes(spark, SMALL).filter(f"note_id = {longest.doc_id}").first()["text"]
    assert note.count(longest.text) == 2
