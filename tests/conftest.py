import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SF_LARGER = os.environ.get("TEST_SF_LARGER_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from tidelog.session import local

    s = local("8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a folder."""
    import duckdb

    def run(sql: str, sf_dir: str = SF):
        con = duckdb.connect()
        for name in sorted(os.listdir(sf_dir)):
            path = f"{sf_dir}/{name}"
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        out = con.execute(sql)
        return [c[0] for c in out.description], out.fetchall()

    return run


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and SQL give the same rows under the same names."""

    def check(df, sql: str, sf_dir: str = SF):
        names = sorted(df.columns)
        cols, rows = duck(sql, sf_dir)
        assert sorted(cols) == names
        at = [cols.index(n) for n in names]
        assert sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rows), key=repr)

    return check
