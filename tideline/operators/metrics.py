"""Task metrics: rates, roll-ups, load of stages, timelines.

metrics: (job, task_id, ts, tuples_processed, current_rate). tasks: (job, task_id, stage, state, started_at).
Task ids repeat between jobs, so a task is always (job, task_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TASK = ["job", "task_id"]


def task_rates(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task and second: tuples so far, tuples in that second, and the average since its start.

    samples: (job, task_id, ts, tuples) with tuples as counted in each event.
    """
    second = F.date_trunc("second", "ts").alias("second")
    per = samples.groupBy(*TASK, second).agg(F.sum("tuples").cast("long").alias("in_second"))
    so_far = F.sum("in_second").over(Window.partitionBy(*TASK).orderBy("second"))
    before = F.lag("second").over(Window.partitionBy(*TASK).orderBy("second"))
    gap = F.unix_timestamp(F.col("second").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    out = per.withColumn("total", so_far).withColumn("rate", F.try_divide(F.col("in_second").cast("double"), F.coalesce(gap, F.lit(1))))
    out = out.join(tasks.select(*TASK, "started_at"), TASK)
    age = F.unix_timestamp(F.col("second").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "started_at").cast("timestamp"))
    return out.select(*TASK, "second", "in_second", "total", "rate", F.try_divide(F.col("total").cast("double"), age).alias("average"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest sample of each task; of equally new ones the one with the fewest tuples stays."""
    others = [c for c in metrics.columns if c not in TASK]
    newest = F.max_by(F.struct(*others), F.struct(F.col("ts"), *[-F.col(c) for c in ("tuples_processed",) if c in metrics.columns]))
    return metrics.groupBy(*TASK).agg(newest.alias("s")).select(*TASK, *[F.col(f"s.{c}").alias(c) for c in others])


def flow_rate(events: DataFrame, key: str = "key", seconds: float = 1.0) -> DataFrame:
    """events(key, ts, size) with flow: bytes a second over the trailing span, both ends included.

    Time is cut into buckets as long as the span, and a span that ends in one bucket begins there or in the
    one before. Each row goes to its own bucket and, a span later, as history to the next. There the own
    rows up to a time and the history from that time on are a running sum each, one in order of time and one
    against it: work is in proportion to rows, and no sum is taken off another.
    """
    length = int(seconds * 1e6)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("_us", us).withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).where("_own or _us is not null")
    rows = rows.withColumn("_us", F.when(F.col("_own"), F.col("_us")).otherwise(F.col("_us") + length))
    rows = rows.withColumn("_bucket", F.col("_us") - F.pmod("_us", F.lit(length)))
    up_to = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(key, "_bucket").orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_up_to", F.sum(F.when(F.col("_own"), F.col("size"))).over(up_to))
    rows = rows.withColumn("_since", F.sum(F.when(~F.col("_own"), F.col("size"))).over(since))
    total = F.coalesce(F.col("_up_to") + F.col("_since"), "_up_to", "_since")
    return rows.where("_own").withColumn("flow", total / F.lit(seconds)).drop("_us", "_own", "_bucket", "_up_to", "_since")


def stage_rollup(metrics: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per job and stage: number of tasks, sums of their rates and tuples; unknown tasks are left out."""
    rows = metrics.join(tasks.select(*TASK, "stage"), TASK)
    return rows.groupBy("job", "stage").agg(F.count(F.lit(1)).alias("tasks"), F.sum("current_rate").alias("rate"), F.sum("tuples_processed").cast("long").alias("tuples"))


def stage_seconds(metrics: DataFrame, tasks: DataFrame) -> DataFrame:
    """(job, second, stage, n, rate, tuples): running tasks with tuples, latest sample in each second."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second")
    live = metrics.join(tasks.where("state = 'running' and stage > 0").select(*TASK, "stage"), TASK)
    newest = F.max_by(F.struct("current_rate", "tuples_processed"), F.struct("ts", "tuples_processed"))
    last = live.groupBy("job", second, "stage", "task_id").agg(newest.alias("s")).where("s.tuples_processed > 0")
    return last.groupBy("job", "second", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("s.current_rate").alias("rate"), F.sum("s.tuples_processed").cast("long").alias("tuples"))


def scaling_decisions(metrics: DataFrame, tasks: DataFrame, low: float, high: float, least_tuples: int = 50) -> DataFrame:
    """(job, second, stage, n, average, action): where a stage's mean rate a task leaves the limits.

    A report on recorded metrics: 'up' above ``high``, 'down' below ``low`` (with more than one task);
    seconds within the limits, or with fewer than ``least_tuples``, are left out.
    """
    average = F.col("rate") / F.col("n")
    action = F.when(average > high, "up").when((average < low) & (F.col("n") > 1), "down")
    rows = stage_seconds(metrics, tasks).where(F.col("tuples") >= least_tuples)
    return rows.select("job", "second", "stage", "n", average.alias("average"), action.alias("action")).where("action is not null")


def job_timeline(events: DataFrame) -> DataFrame:
    """Per job, from events(job, task_id, event, ts): span, completions, restarts, status.

    A task's repeated completions count once; restarts count each.
    """
    once = events.where("event <> 'restart'").groupBy("job", "task_id", "event").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    again = events.where("event = 'restart'").select("job", "task_id", "event", "ts", F.lit(1).cast("long").alias("n"))
    rows = once.unionByName(again)
    n = lambda e: F.count_if(F.col("event") == e)
    out = rows.groupBy("job").agg(
        F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("event") == "end", F.col("ts"))).alias("ended"),
        n("start").alias("expected"),
        n("end").alias("completed"),
        n("restart").alias("restarts"),
        n("failed").alias("failures"),
    )
    seconds = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    done = (F.col("completed") >= F.col("expected")) & (F.col("expected") > 0)
    return out.withColumn("status", F.when(done, "completed").otherwise("running")).withColumn("duration_us", F.when(done, seconds))


def task_list(events: DataFrame, op: str | None = None, state: str | None = None) -> DataFrame:
    """The newest state of each task of events(job, task_id, op, state, host, ts, seq), filtered if asked."""
    rest = ["op", "state", "host", "ts"]
    out = events.groupBy(*TASK).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")).select(*TASK, *[F.col(f"s.{c}").alias(c) for c in rest])
    if op:
        out = out.where(F.col("op") == op)
    return out.where(F.col("state") == state) if state else out
