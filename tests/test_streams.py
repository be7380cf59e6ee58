"""Streams over a log in many files that are not in time order give what its SQL gives."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException

import __spark_entry__ as entry
from tests import parity
from tideline.session import shared_dir
from tideline.streaming import changes, heartbeats, tail


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("shuffled"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").toPandas()
    first = events["ts"].min()
    events["ts"] = first + ((events["ts"] - first) * (200 / max(1, (events["ts"].max() - first).days))).dt.floor("us")  # 200 days
    order = [31, *range(15, 31), *range(14, -1, -1)]
    os.mkdir(f"{sf}/events.parquet")
    for at, k in enumerate(order):
        path = f"{sf}/events.parquet/part-{at:02}.parquet"
        events.iloc[k * len(events) // 32 : (k + 1) * len(events) // 32].to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    return sf


@pytest.mark.parametrize("name", ["log_tail_stream", "circuit_stream", "windowed_counts_stream"])
def test_order_and_number_of_files_do_not_matter(spark, shuffled, name):
    con = parity.oracle("/root/testdata/sf0.001")
    con.execute(f"create or replace view events as select * from read_parquet('{shuffled}/events.parquet/*.parquet')")
    assert parity.differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], shuffled) == []


def test_runs_that_end_against_a_minute_by_minute_clock():
    """advance() in any split of time equals looking at each moment in turn."""
    rnd = random.Random(2)
    for _ in range(150):
        beats = [(rnd.randrange(60), k, rnd.randrange(3), rnd.random() < 0.2) for k in range(rnd.randrange(1, 25))]
        patience, live, ended = rnd.randrange(1, 9), {}, []
        for now in range(80):
            for lane in sorted(live):
                if live[lane][1] + patience == now - 1:  # the moment of the deadline has passed
                    started, last, n = live.pop(lane)
                    ended.append((lane, started, last, n, "failed", last + patience, not live))
            for at, _, lane, report in sorted(beats):
                if at == now and (lane in live or not report):
                    started, _, n = live.get(lane, (now, now, 0))
                    live[lane] = (started, now, n + 1)
                    if report:
                        live.pop(lane)
                        ended.append((lane, started, now, n + 1, "success", now, not live))
        state, rest, got = {}, list(beats), []
        for mark in (20, 33, 79):
            out, rest = heartbeats.advance(state, rest, mark, patience)
            got += out
        assert got == ended and not state and not rest


def test_lost_runs_free_their_task_and_leave_no_state(spark):
    """Two lanes of one task: the task is free when the second of them has ended. Late beats within the delay count."""
    day = "2024-01-{:02} {:02}:00:00"
    rows = [(2, 1, day.format(1, 0), "click", '{"k": 0}'), (3, 1, day.format(1, 5), "click", '{"k": 1}'), (4, 1, day.format(2, 4), "click", '{"k": 1}'), (5, 1, day.format(2, 20), "purchase", '{"k": 1}'),
            (6, 2, day.format(3, 0), "view", None), (7, 3, day.format(30, 0), "view", "{}"), (8, None, day.format(30, 0), "view", "{}"), (9, 4, None, "view", "{}")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, t string, event_type string, props string").selectExpr("event_id", "user_id", "cast(t as timestamp_ntz) as ts", "event_type", "0.0 as value", "props")
    found, progress = heartbeats.lost_runs(events)
    got = sorted((r.task_id, r.lane, r.beats, r.outcome, str(r.ended_at), r.released) for r in found.collect())
    assert got == [(1, 0, 1, "failed", "2024-01-02 00:00:00", False), (1, 1, 3, "success", "2024-01-02 20:00:00", True), (2, 0, 1, "failed", "2024-01-04 00:00:00", True)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # of the task that may still be heard of; operators are listed from the last


def test_tail_tells_once_and_keeps_what_is_late(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found, progress = tail.followed(events)
    rows = found.collect()
    told, late = [r for r in rows if r.told], [r for r in rows if not r.told]
    assert len({r.event_id for r in told}) == len(told) and late
    assert {r.event_id for r in rows} == {r.event_id for r in events.collect()}  # nothing is lost without a trace
    sizes = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert max(sizes) < 0.5 * len(told)  # ids of the last delay and one delivery, not of all
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == len(late)


def test_a_stop_between_writing_and_commit_tells_each_change_once(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stopped = []

    def after(number: int) -> None:
        if number in (1, 3) and number not in stopped:
            stopped.append(number)
            raise RuntimeError("stopped before the commit")

    with pytest.raises(StreamingQueryException):
        changes.watched(events, after=after)
    lines = lambda df: sorted((r.user_id or -1, r.poll, r.line) for r in df.collect())
    plain = lines(changes.watched(events)[0])
    stopped.clear()
    assert lines(changes.watched(events, after=after, restarts=2)[0]) == plain and stopped == [1, 3]
    assert [x for x in plain if x[2] == changes.END] == [(-1, 5, changes.END)]
    by_user = {}
    for user, _, line in plain:
        assert by_user.get(user) != line
        by_user[user] = line


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf(dict):
        get = lambda self, key, default=None: default

    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_neighbouring_tasks_share_a_state_row(spark):
    """Eighty tasks with a live run each are two rows of state; repeated rows of a delivery count once."""
    rows = [(1, 1, "2024-01-01 00:00:00", "view", None)] + [(7 * k, k, f"2024-01-30 00:00:{k % 60:02}", "view", '{"k": 0}') for k in range(64, 144)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, t string, event_type string, props string").selectExpr("event_id", "user_id", "cast(t as timestamp_ntz) as ts", "event_type", "0.0 as value", "props")
    found, progress = heartbeats.lost_runs(events)
    assert [(r.task_id, r.beats, r.outcome) for r in found.collect()] == [(1, 1, "failed")]
    assert [op["numRowsTotal"] for op in progress[-1]["stateOperators"]] == [2]
