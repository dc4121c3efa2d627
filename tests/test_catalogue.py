"""Every query with an oracle agrees with DuckDB at the smallest scale."""

import duckdb
import pytest

from glyphmill.plans import catalogue, more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else None
    if isinstance(v, list):
        return tuple(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
