"""Stateful streams give the rows of the batch, in three triggers and across a restart from the checkpoint."""

import datetime

import pytest

from factloom.streaming import progress, stateful

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def parts(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    rows = [(i, START + datetime.timedelta(minutes=7 * i + (i * i) % 5, milliseconds=i), f"u{i * i % 7 % 4}", ["up", "down", None, "up", "down"][i * i % 11 % 5], f"r{i // 12}", f"s{i % 3}", "done" if i % 4 else "running") for i in range(90)]
    rows += [(200, None, "u1", "up", "r1", "s1", "done"), (201, START, None, "up", "r1", "s1", "done")]
    cuts = [rows[:33], rows[33:34] + rows[90:], rows[34:90]]
    schema = "event_id long, ts timestamp, user string, state string, run string, step string, status string"
    frames = [spark.createDataFrame(c, schema) for c in cuts]
    yield frames, str(tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, parts, operator, mode):
    """The rows given over three starts from one checkpoint, a file more each."""
    frames, path = parts
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
        made = operator(progress.read_stream(spark, f"{path}/in", frames[0]))
        out = stateful.write_available(made, f"{path}/out", f"{path}/checkpoint", mode)
    return out.orderBy("trigger").drop("trigger").collect()


def whole(parts):
    a, b, c = parts[0]
    return a.union(b).union(c)


def test_state_changes(spark, parts):
    operator = lambda df: stateful.state_changes(df, "user", "state")
    want = operator(whole(parts)).collect()
    assert len(want) > 10 and {r.was for r in want} == {"up", "down"}
    assert sorted(map(repr, streamed(spark, parts, operator, "append"))) == sorted(map(repr, want))


def test_runs_keep_the_last_that_moved(spark, parts):
    operator = lambda df: stateful.run_states(df, "user", "run", 2)
    want = {(r.key, r.run, r.step): (r.status, r.ts, r.event_id, r.kept) for r in operator(whole(parts)).collect()}
    got = {}
    for r in streamed(spark, parts, operator, "update"):
        got[r.key, r.run, r.step] = (r.status, r.ts, r.event_id, r.kept)  # the last row of a step is its state
    assert {k: v for k, v in got.items() if v[3]} == {k: v for k, v in want.items() if v[3]}
    assert all(want[k] == v for k, v in got.items()) and any(not v[3] for v in got.values())


def test_idle_keys_are_released_by_timers(spark, parts):
    operator = lambda df: stateful.released(df, "user", 1500)
    want = operator(whole(parts)).collect()
    ends = {r.key: max(x.end for x in want if x.key == r.key) for r in want}
    assert len(want) > 10 and len(ends) > 1
    assert sorted(map(repr, streamed(spark, parts, operator, "append"))) == sorted(map(repr, want))


def test_no_rows(spark, parts):
    none = parts[0][0].limit(0)
    assert stateful.state_changes(none, "user", "state").count() == stateful.run_states(none, "user", "run").count() == stateful.released(none, "user", 60).count() == 0
