"""Every query that has SQL gives its rows; the others give rows."""

import duckdb
import pytest

from ebbtide.plans.registry import FLAGSHIP, ORACLES, QUERIES
from ebbtide.sources.events import events

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def cells(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    if name in ORACLES:
        want = sql.sql(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({ORACLES[name]})")
        assert cells(got) == cells(want.fetchall())
    else:
        assert name in ("adwin_drift",) or got


@pytest.mark.parametrize("name", ["scm_conservative", "hk_estimate"])
def test_every_key_of_a_group_has_its_estimate(spark, name):
    rows = events(spark, DATA, "event_type").select("grp", "key").distinct().collect()
    got = [(r.grp, r.key) for r in QUERIES[name](spark, DATA).collect()]
    assert sorted(got) == sorted((r.grp, r.key) for r in rows)


def test_the_entry_module_names_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries()) and FLAGSHIP in QUERIES
