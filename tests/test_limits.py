"""Queries against their SQL on tables in which many rows stand exactly on a limit."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cadenza.plans import registry


def events(folder, values, users=1500, each=40):
    """Events with the values that values() gives, as many of each user."""
    n = users * each
    kinds = ("view", "signup", "purchase", "error", "click")
    rng = random.Random(4)
    columns = {
        "event_id": pa.array(range(n), "int64"), "ts": pa.array([1_704_067_200_000_000 + i * 1_000_000 for i in range(n)], "timestamp[us]"),
        "user_id": pa.array([i % users for i in range(n)], "int64"), "event_type": [rng.choice(kinds) for _ in range(n)],
        "value": pa.array([values(rng) for _ in range(n)], "float64"), "props": [f'{{"k": {rng.randrange(100)}}}' for _ in range(n)],
    }
    pq.write_table(pa.table(columns), f"{folder}/events.parquet")


def both(spark, folder, name):
    df = registry.QUERIES[name](spark, str(folder))
    with duckdb.connect(config={"threads": 1, "memory_limit": "2GB"}) as c:
        c.sql(f"create view events as select * from '{folder}/events.parquet'")
        found = c.execute(registry.ORACLE[name])
        names = [d[0] for d in found.description]
        want = found.fetchall()
    return sorted(map(tuple, df.select(*names).collect())), sorted(want)


def test_slopes_on_the_limit(spark, tmp_path):
    events(tmp_path, lambda rng: None if rng.random() < 0.02 else rng.randrange(30_000, 30_030) / 100)
    got, want = both(spark, tmp_path, "slope_stop")
    assert len(want) > 100 and got == want


def test_shares_on_the_limit(spark, tmp_path):
    """Sums that are exact in the SQL too, and shares that end on half of the last place."""
    events(tmp_path, lambda rng: rng.randrange(1, 2_000) / 4, each=8)
    got, want = both(spark, tmp_path, "nucleus_filter")
    assert len(want) > 1000 and got == want


def test_shares_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    found = []
    for k in range(2):
        (folder := tmp_path / str(k)).mkdir()
        events(folder, lambda rng: rng.randrange(1, 40) / 100)
        t = pq.read_table(f"{folder}/events.parquet")
        pq.write_table(t[::-1] if k else t, f"{folder}/events.parquet")
        found.append(both(spark, folder, "nucleus_filter")[0])
    assert found[0] == found[1]


def test_shares_of_odd_values(spark, tmp_path):
    """Users without any value, with zeros alone, and with values beyond decimals."""
    events(tmp_path, lambda rng: rng.choice([None, 0.0, 1e30, 2.5]), each=4)
    got, want = both(spark, tmp_path, "nucleus_filter")
    assert len(want) > 500 and got == want


def test_keys_are_voted_on_where_windows_lie(spark, tmp_path):
    """No row for each window, profile and key; a window of equal sums, here of notes without a pitch, votes as in the SQL."""
    events(tmp_path, lambda rng: rng.randrange(1, 9) * 10.0, users=200, each=30)
    t = pq.read_table(f"{tmp_path}/events.parquet")
    props = [None if u < 5 else p for u, p in zip(t["user_id"].to_pylist(), t["props"].to_pylist())]
    pq.write_table(t.set_column(t.schema.get_field_index("props"), "props", pa.array(props, "string")), f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, "window_key_vote")
    assert len(want) > 100 and got == want
    plan = registry.QUERIES["window_key_vote"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
