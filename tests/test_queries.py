"""Every registered evidence query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfold.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = [tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in data]
    return sorted(columns), sorted(map(repr, shown))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    want = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_whole_tables(spark, sql):
    """Every line has its run, and every observation of every day its change."""
    lines = sql.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert QUERIES["history"](spark, DATA).count() == lines
    days = sql.execute("SELECT count(DISTINCT ts::DATE), count(DISTINCT (user_id, ts::DATE)) FROM events").fetchone()
    changes = QUERIES["observed_changes"](spark, DATA)
    assert (changes.select("day").distinct().count(), changes.count()) == days
    seen = {}
    for user, day in sql.execute("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') FROM events").fetchall():
        seen.setdefault(day, set()).add(user)
    runs = sorted(seen)
    gone = {(u, now) for before, now in zip(runs, runs[1:], strict=False) for u in seen[before] - seen[now]}
    assert {(r["user_id"], r["day"]) for r in QUERIES["not_observed"](spark, DATA).collect()} == gone


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["snowflake_ts", "tiktok_content_rows"])
def test_ids_of_large_tables(spark, tmp_path, name):
    """Events beyond 547,000 have ids of more than 63 bits, those beyond 2,502,000 times after 2100, those beyond 251,802,000
    years of five digits."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + k AS event_id) FROM '{DATA}/events.parquet', (SELECT unnest([0, 547000, 2502000, 5900000, 251802000]) AS k)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
