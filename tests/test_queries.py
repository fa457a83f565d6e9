"""Every query against its SQL on the smallest tables, and the entry module without the optional parts."""

import os
import subprocess
import sys

import pytest

from aktenwerk.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    want = duck.execute(SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    flat = lambda t: sorted(repr(list(r.values())) for r in t.select(columns).to_pylist())
    assert flat(got) == flat(want)


def test_benchmark_quotes_of_any_length(spark, tmp_path):
    """Items of one word to many, at both ends of a text and inside of words."""
    docs = [(1, "eins zwei drei vier fünf sechs sieben acht neun zehn elf"), (2, "Vorzweiwort und\n drei  vier"), (3, None), (4, "zwei"), (5, "eins zwei drei vier fünf sechs sieben acht neunzig")]
    items = [(10, "zwei"), (11, "drei vier"), (12, "zwei drei vier"), (13, docs[0][1]), (14, "eins zwei drei vier fünf sechs sieben acht neun"), (15, "wei drei vier fünf"), (16, "fehlt hier ganz"), (17, "neun zehn elf")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["document_id"], r["pos"], r["q_start"]) for r in QUERIES["jon2_benchmark_quotes"](spark, str(tmp_path)).collect()}
    flat = {i: " ".join((t or "").split()) for i, t in docs}
    assert got == {(i, k, t.find(x)) for i, t in flat.items() for k, x in items if x in t}


def test_entry_without_optional_parts():
    code = "import sys; sys.modules['llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
