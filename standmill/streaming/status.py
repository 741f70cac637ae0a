"""Job status as a stream: latest state, step times, timeouts, telemetry windows, tiles merged as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from standmill.functions.keys import half_even

FINISHED = ("completed", "failed")


def state_of(step: Column) -> Column:
    return F.when(step.isin(*FINISHED), step).otherwise("processing")


def latest_status(status: DataFrame) -> DataFrame:
    """Per task its last report; a field that is missing there keeps its last known value. For batches and streams alike."""
    order = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    found = status.groupBy("task_id").agg(*[last(c) for c in ("step", "progress", "value")], F.max("ts").alias("updated"), F.count("*").alias("n_reports"))
    return found.withColumn("status", state_of(F.col("step")))


def step_durations(status: DataFrame) -> DataFrame:
    """Each stretch of reports of one step of a task: its start, and the seconds (to 0.1) until the next one began."""
    task = Window.partitionBy("task_id").orderBy("ts", "event_id")
    begins = status.withColumn("before", F.lag("step").over(task)).filter(F.col("before").isNull() | (F.col("before") != F.col("step")))
    seconds = F.lead("ts").over(task).cast("double") - F.col("ts").cast("double")
    return begins.select("task_id", "event_id", "step", F.col("ts").alias("started"), half_even(seconds, 1).alias("seconds"))


def step_timer(stream: DataFrame) -> DataFrame:
    """step_durations on a stream: the open step and its start are kept per task; a row comes out when a step ends."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, started, event = state.get if state.exists else (None, None, None)
        ended = []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for new, ts, number in zip(rows["step"], rows["ts"], rows["event_id"]):
            if new != step:
                if step is not None:
                    ended.append((key[0], event, step, pd.Timestamp(started, unit="us"), round((ts.value // 1000 - started) / 1e6, 1)))
                step, started, event = new, ts.value // 1000, int(number)
        state.update((step, started, event))
        yield pd.DataFrame(ended, columns=["task_id", "event_id", "step", "started", "seconds"])

    return stream.groupBy("task_id").applyInPandasWithState(
        work, "task_id long, event_id long, step string, started timestamp, seconds double", "step string, started long, event_id long", "append", GroupStateTimeout.NoTimeout
    )


def pending_requests(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Requests (task_id, ...) of which no finished state is known."""
    done = status.filter(F.col("step").isin(*FINISHED)).select("task_id").distinct()
    return requests.join(done, "task_id", "left_anti")


def pending_requests_stream(requests: DataFrame, status: DataFrame, keep: str | None = None) -> DataFrame:
    """pending_requests on two streams: (task_id, version, pending) whenever it changes for a requested task; the row of the highest
    version of a task counts (latest_pending). A finish may come before or after its request, or long after. Per task the state
    holds two flags and the version; with ``keep`` (a duration of processing time) a task that is requested and finished is
    forgotten after that long without news. A query with ``keep`` wakes up to forget, so it needs a trigger that goes on, not availableNow."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        asked, finished, version = state.get if state.exists else (False, False, 0)
        before = asked and not finished if version else None
        for rows in parts:
            asked = asked or bool(rows["asked"].any())
            finished = finished or bool((~rows["asked"]).any())
        pending = asked and not finished
        changed = asked and pending != before
        state.update((asked, finished, version + changed))
        if keep_ms and asked and finished:
            state.setTimeoutDuration(keep_ms)
        if changed:
            yield pd.DataFrame({"task_id": [key[0]], "version": [version + 1], "pending": [pending]})

    done = status.filter(F.col("step").isin(*FINISHED)).select("task_id", F.lit(False).alias("asked"))
    both = requests.select("task_id", F.lit(True).alias("asked")).unionByName(done)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return both.groupBy("task_id").applyInPandasWithState(work, "task_id long, version int, pending boolean", "asked boolean, finished boolean, version int", "append", timeout)


def latest_pending(changes: DataFrame) -> DataFrame:
    """The tasks that are pending after all these changes."""
    return changes.groupBy("task_id").agg(F.max_by("pending", "version").alias("pending")).filter("pending").select("task_id")


def run_timeouts(status: DataFrame, limit_s: float, now: Column) -> DataFrame:
    """Tasks that have run (time in the queue does not count) for longer than the limit, and are not finished in time."""
    running = F.min(F.when(~F.col("step").isin("queued", *FINISHED), F.col("ts")))
    ended = F.min(F.when(F.col("step").isin(*FINISHED), F.col("ts")))
    found = status.groupBy("task_id").agg(running.alias("started"), ended.alias("ended")).filter("started IS NOT NULL")
    ran = F.when(F.col("ended") >= F.col("started"), F.col("ended")).otherwise(now).cast("double") - F.col("started").cast("double")
    return found.withColumn("ran_s", half_even(ran, 1)).filter(F.col("ran_s") > limit_s).select("task_id", "started", "ran_s")


def run_timeouts_stream(stream: DataFrame, limit: str = "20 hours") -> DataFrame:
    """The same on a stream with a watermark on ts, which stands for now: one row (task_id, started) for each task whose
    first run report is older than the limit, unless its first finish came at or after it and within the limit."""
    limit_us = int(pd.Timedelta(limit).total_seconds() * 1_000_000)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, told = state.get if state.exists else (None, None, False)
        if state.hasTimedOut:
            state.update((started, ended, True))
            yield pd.DataFrame({"task_id": [key[0]], "started": [pd.Timestamp(started, unit="us")]})
            return
        for rows in parts:
            us = rows["ts"].astype("datetime64[us]").astype("int64")
            finished = rows["step"].isin(FINISHED)
            running = ~finished & (rows["step"] != "queued")
            if finished.any():
                ended = int(us[finished].min()) if ended is None else min(ended, int(us[finished].min()))
            if running.any():
                started = int(us[running].min()) if started is None else min(started, int(us[running].min()))
        state.update((started, ended, told))
        in_time = started is not None and ended is not None and 0 <= ended - started <= limit_us
        if started is not None and not told and not in_time:
            state.setTimeoutTimestamp(max((started + limit_us) // 1000, state.getCurrentWatermarkMs() + 1))

    return stream.groupBy("task_id").applyInPandasWithState(
        work, "task_id long, started timestamp", "started long, ended long, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def telemetry_windows(samples: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str | None = None, late: str | None = None, key: str = "step") -> DataFrame:
    """Mean and largest value per key and time window: tumbling, sliding or session (size is then the gap)."""
    if late:
        samples = samples.withWatermark("ts", late)
    if kind == "session":
        window = F.session_window("ts", size)
    elif kind in ("tumbling", "sliding"):
        window = F.window("ts", size, slide or size)
    else:
        raise ValueError(f"unknown kind {kind}")
    found = samples.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return found.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_value", "max_value")


def progress_pct(tiles: DataFrame, total: DataFrame, by: str = "scene_id") -> DataFrame:
    """20 to 85 percent by the share of a scene's tiles that are done."""
    done = tiles.groupBy(by).agg(F.size(F.collect_set("tile_id")).alias("done"))  # exact on a stream too; a scene has few tiles
    return done.join(total, by).select(by, (20 + F.floor(65 * F.col("done") / F.col("n_tiles"))).cast("int").alias("progress"))
