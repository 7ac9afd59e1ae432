"""Values that stand still: roots whose bars close where they open, have one z only, or one price only give what the SQL gives."""

import collections
import math
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.plans.registry import ORACLES, QUERIES

SOURCE = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def still(tmp_path_factory):
    """Clicks and views of sf0.01, some with a price of 0 inside an hour; every hour of error (300) and signup (11) closes
    where it opens; purchase has one price."""
    own = f"SELECT event_type, ts, value FROM '{SOURCE}' WHERE event_type IN ('click', 'view')"
    ends = f"SELECT unnest([min(ts), max(ts)]) FROM '{SOURCE}' GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)"
    rows = duckdb.sql(f"SELECT event_type, ts, CASE WHEN i % 501 = 0 THEN 0.0 ELSE value END FROM (SELECT *, CASE WHEN ts NOT IN ({ends}) THEN row_number() OVER (PARTITION BY ts NOT IN ({ends}) ORDER BY ts) END AS i FROM ({own}))").fetchall()
    for root, hours in (("error", 300), ("signup", 11), ("purchase", 100)):
        for h in range(hours):
            price = 10.0 + h * 7 % 13 if root != "purchase" else 5.0
            for minute, factor in ((0, 1.0), (20, (1.5, 2.0, 3.0)[h % 3]), (30, (0.5, 0.8, 0.9, 0.6)[h % 4]), (50, 1.0)):
                rows.append((root, datetime(2024, 1, 3) + timedelta(hours=h, minutes=minute), price * (factor if root != "purchase" else 1.0)))
    d = tmp_path_factory.mktemp("still")
    root, ts, value = zip(*rows)
    pq.write_table(pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "event_type": list(root), "value": pa.array(value, pa.float64())}), d / "events.parquet")
    return d


def rows(found):
    return collections.Counter(tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found)


@pytest.mark.parametrize("name", ["f8_f9_variants", "f21_residual_curve", "w3_w4_correlations"])
def test_as_sql(spark, still, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{still}/events.parquet'")
    got = QUERIES[name](spark, str(still))
    want = con.execute(ORACLES[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    want = rows(tuple(r[i] for i in at) for r in want.fetchall())
    assert {r[0] for r in want} >= {"click", "error", "view"}
    assert rows(got.collect()) == want
