"""One user and one customer hold a third of all rows, over many chunks."""

import duckdb
import pytest

from sessionledger.catalog import ORACLES, QUERIES

from .conftest import SF, TABLES
from .test_oracles import rows_of

NAMES = [
    "usage_totals", "last_response", "running_usage", "dedup_stats", "child_outcomes", "turn_summary",
    "turn_summary_b", "last_known", "status_episodes", "recent_context", "latest_per_key", "account_rows",
    "per_host_head", "adapter_latest_usage", "predecessor_check", "activity_sessions",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    change = {
        "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)",
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey)",
    }
    for t in TABLES:
        con.execute(f"COPY (SELECT {change.get(t, '*')} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, small_chunks, name):
    folder, con = skewed
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLES[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
