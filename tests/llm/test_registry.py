import duckdb
import pytest

import __spark_entry__ as entry
from tarn.llm import queries

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.queries()) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_table(spark, name):
    table = {"op3_warc": "pages", "op6_chat": None}.get(name, "documents")
    rows = queries.queries()[name](spark, DATA).collect()
    if table:
        ids = [r[f"{'page' if table == 'pages' else 'doc'}_id"] for r in rows]
        want = [r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(f"{'page' if table == 'pages' else 'doc'}_id").collect()]
        assert sorted(set(ids)) == sorted(want) and (name == "op10_packing" or len(ids) == len(want))
