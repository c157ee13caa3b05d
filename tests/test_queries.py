"""Every query of the engine against its SQL, on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from factweave.plans.stored_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    show = lambda v: "" if pd.isna(v) else round(float(v), 6) if isinstance(v, numbers.Number) else str(v)
    return sorted(sorted(map(tuple, ([show(v) for v in r] for r in df[sorted(df.columns)].astype(object).values.tolist()))), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_questions_of_odd_texts(spark, tmp_path):
    """Words that go on with a letter beyond ASCII, ends that only Java takes as lines', other blanks."""
    texts = ["Doñez ñta", "Was", "isolate", "do_it", "is-it", "Is it", " is it", "\tis it", "so? ", "so?\u0085", "so? \n", "so?\x0b", "so? ", "so?\r\n", "so?.", "", " ", "whoé\n?", "a?\nb"]
    pd.DataFrame({"conv_id": 1, "turn": range(len(texts)), "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    got = QUERIES["questions"](spark, str(tmp_path)).toPandas()
    want = duckdb.sql(ORACLE["questions"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet'")).df()
    said = [dict(zip(df.turn, df.question)) for df in (got, want)]
    assert {texts[i]: (said[0][i], said[1][i]) for i in said[1] if said[0][i] != said[1][i]} == {}
