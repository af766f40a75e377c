"""The log of state changes, and the catalogue of projects."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from veilspan.schema import STATE_SCHEMAS
from veilspan.sources.state import State, catalogue, create_project, delete_project, project_exists
from veilspan.sources.state_log import StateLog

DAY = dt.datetime(2024, 1, 1)


def state(spark, mappings, tokens=()):
    rows = [("p", "EMAIL", o, f"s-{o}", n, DAY, DAY + dt.timedelta(days=d)) for o, n, d in mappings]
    return State(spark.createDataFrame(rows, STATE_SCHEMAS["mappings"]), spark.createDataFrame([("p", "words", t, f"t-{t}") for t in tokens], STATE_SCHEMAS["token_map"]),
                 spark.createDataFrame([], STATE_SCHEMAS["networks"]), spark.createDataFrame([], STATE_SCHEMAS["placeholders"]))


def held(s):
    return {(r.original, r.surrogate, r["count"], r.last_seen) for r in s.mappings.collect()}, {r.token for r in s.token_map.collect()}


def test_batches_add_up_and_may_run_again(spark, tmp_path):
    log = StateLog(spark, f"{tmp_path}/log")
    assert held(log.load()) == (set(), set())
    states = [state(spark, [("a", 1, 0)], ["x"]), state(spark, [("a", 3, 2), ("b", 1, 1)], ["x", "y"]), state(spark, [("a", 3, 2), ("b", 6, 4)], ["x", "y"])]
    for batch, new in enumerate(states):
        for _ in range(2):  # the second try replaces the first
            log.append(batch, log.load(batch), new)
        assert held(log.load()) == held(new) and held(log.load(batch)) == (held(states[batch - 1]) if batch else (set(), set()))
    assert spark.read.parquet(f"{tmp_path}/log/change-0000000002/mappings").count() == 1  # a batch writes its own change only
    log.compact(1)
    assert held(log.load()) == held(states[2]) and held(log.load(2)) == held(states[1])
    log.append(2, log.load(2), states[1])
    assert held(log.load()) == held(states[1])


def test_a_change_that_is_not_complete_is_not_seen(spark, tmp_path, monkeypatch):
    log = StateLog(spark, f"{tmp_path}/log")
    log.append(0, log.load(0), state(spark, [("a", 1, 0)]))
    fails = State(log.load().mappings, None, None, None)
    with pytest.raises(AttributeError):
        log._write(fails, "change", 1)
    assert held(log.load())[0] == {("a", "s-a", 1, DAY)}


def test_one_of_many_writers_gets_a_name(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    assert catalogue(spark, path).count() == 0 and not project_exists(spark, path, "Audit 2024")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: create_project(spark, path, "Audit 2024"), range(6)))
    assert sorted(won) == [False] * 5 + [True] and project_exists(spark, path, "audit  2024")
    assert create_project(spark, path, "other") and {(r.project, r.slug) for r in catalogue(spark, path).collect()} == {("Audit 2024", "audit-2024"), ("other", "other")}
    delete_project(spark, path, "Audit 2024")
    assert not project_exists(spark, path, "Audit 2024") and create_project(spark, path, "audit 2024")
