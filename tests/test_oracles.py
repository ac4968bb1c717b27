import duckdb
import pytest

from syllabary.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(frame, columns):
    clean = frame[columns].astype(object).where(lambda x: x.notna(), None)
    return sorted(tuple("~" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in clean.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert _rows(got.toPandas(), columns) == _rows(want.df(), columns)
