"""What has changed since it was last told: one text of server-sent events by key, and a log that can be closed.

State by task: its last event but views, how many errors it had, and the text that was told last. A batch is a poll: if a
task's text differs from the one told, it is told. A task whose last event is its report is told as an empty object. Each
batch's lines are in a folder of its number, so a stop between the writing of a batch and its commit, and a new start,
give each change once. The last line of a closed log is the end marker; a log without it can be taken up again where its
checkpoint is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import arrivals

STATE = "us long, number long, type string, errors long, told string"
TOLD = "user_id long, poll int, data string"
LINES = "user_id long, poll int, line string"
END = "event: end\ndata: cycle\n\n"


def text(kind: str, errors: int) -> str:
    return "{}" if kind == "purchase" else f'{{"type":"{kind}","errors":{errors}}}'


def told(rows: DataFrame) -> DataFrame:
    """A stream (user_id, us, event_id, event_type, delivery) as the changes of its tasks' texts."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, number, kind, errors, last = state.get if state.exists else (None, None, None, 0, None)
        poll = 0
        for p in parts:
            poll = max(poll, int(p["delivery"].max()))
            errors += int((p["event_type"] == "error").sum())
            newest = max(zip(p["us"].tolist(), p["event_id"].tolist(), p["event_type"].tolist()))
            if us is None or newest[:2] > (us, number):
                us, number, kind = newest
        now = text(kind, errors)
        state.update((us, number, kind, errors, now))
        yield pd.DataFrame([(key[0], poll, now)] if now != last else [], columns=["user_id", "poll", "data"])

    return rows.groupBy("user_id").applyInPandasWithState(step, TOLD, STATE, "append", GroupStateTimeout.NoTimeout)


def sink(base: str, after: Callable[[int], None] = lambda _: None) -> Callable[[DataFrame, int], None]:
    """Lines of a batch in its folder; after() is called between the writing and the commit."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("user_id", "poll", F.concat(F.lit("event: activity\ndata: "), "data", F.lit("\n\n")).alias("line")).write.mode("overwrite").parquet(f"{base}/lines/{number}")
        after(number)

    return keep


def close(df: DataFrame, base: str, poll: int) -> None:
    """The end marker, written once however often it is asked for."""
    df.sparkSession.createDataFrame([(None, poll, END)], LINES).write.mode("overwrite").parquet(f"{base}/lines/end")


def watched(events: DataFrame, delay_days: int = arrivals.DELAY_DAYS, n: int = arrivals.DELIVERIES, after: Callable[[int], None] = lambda _: None, restarts: int = 0) -> tuple[DataFrame, list[dict]]:
    """The closed log of changes of a log that arrives in n deliveries, each event once, and the batches' progress."""
    landed = arrivals.deliveries(events.filter("event_type <> 'view' and user_id is not null"), n)

    def start(base: str):
        rows = arrivals.read(landed, f"{base}/landing").withWatermark("at", f"{delay_days} days").dropDuplicatesWithinWatermark(["event_id"]).select("user_id", arrivals.micros().alias("us"), "event_id", "event_type", "delivery")
        return told(rows).writeStream.foreachBatch(sink(base, after))

    base, progress = arrivals.in_deliveries(landed, "changes", start, n, restarts)
    close(events, base, n)
    return arrivals.rows_of(events.sparkSession, f"{base}/lines", LINES), progress


SQL = f"""with {arrivals.sql("(select * from events where event_type <> 'view' and user_id is not null) x")},
 once as (select event_id, user_id, ts, event_type, min(delivery) as delivery from marked where not late group by all),
 polls as (select user_id, delivery, max((epoch_us(ts), event_id, event_type)) as newest, count(*) filter (where event_type = 'error') as errors from once group by 1, 2),
 state as (select user_id, delivery, max(newest) over w as newest, sum(errors) over w as errors from polls window w as (partition by user_id order by delivery)),
 texts as (select user_id, delivery, case when newest[3] = 'purchase' then '{{}}' else concat('{{"type":"', newest[3], '","errors":', cast(errors as varchar), '}}') end as data from state)
select user_id, delivery as poll, concat('event: activity', chr(10), 'data: ', data, chr(10), chr(10)) as line from texts qualify data is distinct from lag(data) over (partition by user_id order by delivery)
union all select null, {arrivals.DELIVERIES}, concat('event: end', chr(10), 'data: cycle', chr(10), chr(10))"""
