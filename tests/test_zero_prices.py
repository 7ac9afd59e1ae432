"""Prices of 0: logs are infinite, sigma stays infinite to the end of its session, and every query gives what its SQL gives."""

import collections
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.plans.registry import ORACLES, QUERIES

SOURCE = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def zeroed(tmp_path_factory):
    """The events of sf0.01 with every 501st value 0, but none at either end of an hourly bar, as in the larger tables."""
    e = pq.read_table(SOURCE)
    ends = duckdb.sql(f"SELECT unnest([arg_min(event_id, ts), arg_max(event_id, ts)]) AS i FROM '{SOURCE}' GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)").fetchall()
    ends, value = {i for (i,) in ends}, e["value"].to_pylist()
    inner = [k for k, i in enumerate(e["event_id"].to_pylist()) if i not in ends]
    for k in inner[::501]:
        value[k] = 0.0
    d = tmp_path_factory.mktemp("zeroed")
    pq.write_table(e.set_column(e.schema.get_field_index("value"), "value", pa.array(value, e.schema.field("value").type)), d / "events.parquet")
    return d


def rows(found):
    return collections.Counter(tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found)


@pytest.mark.parametrize("name", ["b2_parent_bars", "c1_c2_clean_z", "c3_c5_student_flow", "c4_gaussian_flow", "d2_d5_gates", "d6_thresholds", "d7_d8_events", "d10_d12_cells", "d10_d16_d20_cells", "d14_event_counts", "d15_sanity", "d17_cross_cutting", "d18_best", "d19_d20_horizon_decay", "x1_x7_subbar_features"])
def test_as_sql(spark, zeroed, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zeroed}/events.parquet'")
    assert rows(QUERIES[name](spark, str(zeroed)).collect()) == rows(con.execute(ORACLES[name]).fetchall())
