"""Every query with SQL against DuckDB at the smallest scale, and the driver's contract."""

import glob
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_runs_twice_alike(spark, sf, name):
    one, two = (sorted(map(str, entry.queries()[name](spark, sf).collect())) for _ in range(2))
    assert one == two


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/quillspark/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path


def test_means_on_the_limit_in_the_order_of_the_file(spark, tmp_path):
    """ocr_page over a lineitem of many files and row groups, whose means lie on the limit: as the SQL on one thread."""
    import random

    r = random.Random(7)
    lines = [(k, n, x / 100) for k in range(3000) for n, x in enumerate(r.sample(r.choice([(0, 1, 9, 10, 10), (0, 2, 8, 10, 10), (0, 3, 8, 9, 10), (0, 4, 7, 9, 10), (0, 5, 6, 9, 10)]), 5))]
    r.shuffle(lines)
    (tmp_path / "lineitem.parquet").mkdir()
    for n, (a, z) in enumerate([(0, 500), (500, 1500), (1500, 3500), (3500, len(lines))]):  # Spark reads the largest first
        k, no, x = zip(*lines[a:z], strict=True)
        pq.write_table(pa.table({"l_orderkey": k, "l_linenumber": no, "l_discount": x}), tmp_path / f"lineitem.parquet/{n}.parquet", row_group_size=300)
    spark.createDataFrame([(k, k % 500) for k in range(3000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = con.execute(entry.oracle_sql()["ocr_page"])
    df = entry.queries()["ocr_page"](spark, str(tmp_path))
    assert plain([tuple(x) for x in df.collect()], df.columns) == plain(found.fetchall(), [c[0] for c in found.description])
