"""Heartbeats with timers: runs that are not heard of for too long fail, and free their task when no other run lives.

State by block of BLOCK neighbouring task numbers, and in it by task: beats not yet in order (newer than the watermark) and its live runs. When the watermark advances, beats up to
it are taken in order of time and number; a run's deadline is its last beat plus the patience. A beat at the deadline still
counts. An event-time timer is set for the first deadline or waiting beat of the block, so a run fails though nothing more
is heard of its task. A task without a live run and a waiting beat has no state, nor has a block without such a task. A block, not a task, is what
Spark hands to Python, since that costs far more than to take a task's few beats. Beats at or below the watermark are too
late: Spark leaves them out.

Defined results: a report of a run that does not live is left out; the first beat after an end begins a new run; equal
times go by event number; a repeated row counts once: while it is not late, its first copy still waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import arrivals

#: Task numbers that share a state row: 2 ** BLOCK_BITS.
BLOCK_BITS = 6
STATE = "task array<long>, at array<long>, number array<long>, lane array<long>, report array<boolean>, of array<long>, live array<long>, started array<long>, last array<long>, beats array<long>"
ENDED = "task_id long, lane long, started_us long, last_us long, beats long, outcome string, ended_us long, released boolean"
Beat = tuple[int, int, int, bool]
Run = list[int]


def advance(live: dict[int, Run], waiting: list[Beat], upto: int, patience: int) -> tuple[list[tuple], list[Beat]]:
    """Takes beats up to a time, and ends runs; live is changed. Returns (runs that ended, beats that still wait)."""
    ended = []

    def end(lane: int, outcome: str, at: int) -> None:
        started, last, beats = live.pop(lane)
        ended.append((lane, started, last, beats, outcome, at, not live))

    def expire(before: int) -> None:
        while live:
            last, lane = min((run[1], lane) for lane, run in live.items())
            if last + patience >= before:
                return
            end(lane, "failed", last + patience)

    for at, _, lane, report in sorted(b for b in waiting if b[0] <= upto):
        expire(at)
        if lane in live:
            live[lane] = [live[lane][0], at, live[lane][2] + 1]
        elif not report:
            live[lane] = [at, at, 1]
        if report and lane in live:
            end(lane, "success", at)
    expire(upto + 1)
    return ended, [b for b in waiting if b[0] > upto]


def ended_runs(beats: DataFrame, patience: int) -> DataFrame:
    """A stream (task_id, lane, report, event_id, us, and at with a watermark) as the runs that end, each once."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, at, number, lane, report, *runs = ([list(x) for x in state.get] if state.exists else [[] for _ in range(10)])
        tasks: dict[int, tuple[dict[int, Run], set[Beat]]] = {}
        for t, k, *run in zip(*runs):
            tasks.setdefault(t, ({}, set()))[0][k] = list(run)
        for p in parts:
            for kept, c in ((task, "task_id"), (at, "us"), (number, "event_id"), (lane, "lane"), (report, "report")):
                kept += p[c].tolist()
        for t, *beat in zip(task, at, number, lane, report):
            tasks.setdefault(t, ({}, set()))[1].add(tuple(beat))
        mark = state.getCurrentWatermarkMs() * 1000
        ended, first, beats_left, runs_left = [], [], [], []
        for t, (live, waiting) in tasks.items():
            done, rest = advance(live, list(waiting), mark, patience)
            ended += [(t, *e) for e in done]
            beats_left += [(t, *b) for b in rest]
            runs_left += [(t, k, *run) for k, run in live.items()]
            first += [b[0] for b in rest] + [run[1] + patience for run in live.values()]
        if first:
            columns = lambda rows, n: map(list, zip(*rows)) if rows else ([] for _ in range(n))
            state.update((*columns(beats_left, 5), *columns(runs_left, 5)))
            state.setTimeoutTimestamp(max(-(-min(first) // 1000) - 1, 1))  # fires once the watermark has reached it
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=[x.split(" ")[0] for x in ENDED.split(", ")])

    return beats.withColumn("block", F.shiftright("task_id", BLOCK_BITS)).groupBy("block").applyInPandasWithState(step, ENDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def lost_runs(events: DataFrame, patience_hours: int = 24, delay_days: int = arrivals.DELAY_DAYS, n: int = arrivals.DELIVERIES) -> tuple[DataFrame, list[dict]]:
    """Runs that end by report or by silence in a log that arrives in n deliveries, and the batches' progress."""
    spark = events.sparkSession
    landed = arrivals.deliveries(events, n)

    def start(base: str):
        beats = arrivals.read(landed, f"{base}/landing").withWatermark("at", f"{delay_days} days").filter("user_id is not null")
        beats = beats.select(F.col("user_id").alias("task_id"), (F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 2).alias("lane"), F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("report"), "event_id", arrivals.micros().alias("us"), "at")
        return ended_runs(beats, patience_hours * 3600 * arrivals.MICROS).writeStream.foreachBatch(arrivals.by_batch(lambda k: f"{base}/ended/{k}"))

    base, progress = arrivals.in_deliveries(landed, "heartbeats", start, n)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    rows = arrivals.rows_of(spark, f"{base}/ended", ENDED)
    return rows.select("task_id", "lane", time("started_us").alias("started_at"), time("last_us").alias("last_beat"), "beats", "outcome", time("ended_us").alias("ended_at"), "released"), progress


SQL = f"""with {arrivals.sql()},
 beats as (select user_id as task_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) % 2 as lane, event_type = 'purchase' as report, event_id, epoch_us(ts) as us from marked where not late and user_id is not null group by all),
 mark as (select mark * 1000 as us from newest where delivery = {arrivals.DELIVERIES}),
 known as (select * from beats where us <= (select us from mark)),
 cut as (select *, coalesce(lag(report) over w or us - lag(us) over w > 24 * 3600000000, true) as begins from known window w as (partition by task_id, lane order by us, event_id)),
 numbered as (select *, sum(case when begins then 1 else 0 end) over (partition by task_id, lane order by us, event_id) as run from cut),
 runs as (select task_id, lane, run, min(us) as started_us, arg_min(event_id, (us, event_id)) as first, max(us) as last_us, count(*) as beats, bool_or(report) as reported, arg_max(event_id, (us, event_id)) as last from numbered group by 1, 2, 3 having not (count(*) = 1 and bool_or(report))),
 closed as (select *, case when reported then last_us else last_us + 24 * 3600000000 end as ended_us from runs),
 done as (select *, ended_us <= (select us from mark) as over from closed),
 line as (select task_id, lane, run, started_us as us, 0 as kind, first as number, 1 as change from done union all select task_id, lane, run, ended_us, case when reported then 0 else 1 end, case when reported then last else lane end, -1 from done where over),
 alive as (select *, sum(change) over (partition by task_id order by us, kind, number, change desc) as n from line)
select d.task_id, d.lane, make_timestamp(started_us) as started_at, make_timestamp(last_us) as last_beat, beats, case when reported then 'success' else 'failed' end as outcome, make_timestamp(ended_us) as ended_at, n = 0 as released
from done d join alive a on a.task_id = d.task_id and a.lane = d.lane and a.run = d.run and a.change = -1 where over"""
