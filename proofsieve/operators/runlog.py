"""Run states and operational metrics from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.operators.ordered import running_sum

STATUSES = ["pending", "running", "completed", "failed"]
#: Upper ends of the latency buckets, in seconds.
LATENCY = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]


def latest_run_state(events: DataFrame) -> DataFrame:
    """(job_id, status, ts, error): the last event of each job, of equal times that of the larger event_id; a completed run has no error."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status", "error")).alias("e"))
    return last.select("job_id", "e.status", "e.ts", F.when(F.col("e.status") != "completed", F.col("e.error")).alias("error"))


def run_stats(states: DataFrame) -> DataFrame:
    return states.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def run_status(memo: Column | str, errors: Column | str) -> Column:
    """completed with a memo; else with errors failed only if none is recoverable; else failed. ``errors`` is an array with a field recoverable."""
    m, e = (F.col(x) if isinstance(x, str) else x for x in (memo, errors))
    some = F.coalesce(F.size(e) > 0, F.lit(False))
    return F.when(F.coalesce(F.length(m) > 0, F.lit(False)), "completed").when(some & F.exists(e, lambda x: x["recoverable"]), "completed").otherwise("failed")


def fatal_runs(errors: DataFrame) -> DataFrame:
    """Runs that have an error that isn't recoverable; their remaining collection steps are skipped."""
    return errors.where(~F.col("recoverable")).select("run_id").distinct()


def route(runs: DataFrame, errors: DataFrame) -> DataFrame:
    return runs.join(fatal_runs(errors).withColumn("fatal", F.lit(True)), "run_id", "left").withColumn("next", F.when(F.col("fatal"), "draft").otherwise("collect")).drop("fatal")


def counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def latency_histogram(events: DataFrame, by: str, value: str, buckets: list[float] | None = None) -> DataFrame:
    """(by, le, n): events of at most ``le``, cumulative, with +Inf last."""
    ends = buckets or LATENCY
    sums = events.groupBy(by).agg(*[F.count_if(F.col(value) <= le).alias(f"b{k}") for k, le in enumerate(ends)], F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(ends)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return sums.select(by, F.explode(rows).alias("b")).select(by, "b.le", "b.n")


def histogram_quantile(histogram: DataFrame, by: str, q: float) -> DataFrame:
    """(by, value): the quantile from cumulative buckets, linear inside a bucket; the last finite end if it falls beyond it."""
    w = Window.partitionBy(by).orderBy("le")
    rows = histogram.select("*", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lo"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), F.max("n").over(Window.partitionBy(by)).alias("total"))
    first = rows.where((F.col("n") >= q * F.col("total")) & (F.col("total") > 0)).withColumn("k", F.row_number().over(w)).where("k = 1")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (q * F.col("total") - F.col("below")) / F.when(F.col("n") > F.col("below"), F.col("n") - F.col("below"))
    return first.select(by, F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.coalesce(inside, F.col("lo"))).alias("value"))


def active_runs(events: DataFrame, by: str | None = None) -> DataFrame:
    """(event_id, ts, active): the gauge of runs that are on, +1 for a start and -1 for an end (column delta), after each event in the order of time; over all events, or those of each ``by``."""
    rows = events.select("event_id", "ts", "delta", *[c for c in (by,) if c])
    return running_sum(rows, "delta", ["ts", "event_id"], "active", [by] if by else None).drop("delta")


def run_counts(states: DataFrame) -> DataFrame:
    """(ticker, status, n): runs by ticker and state."""
    return counts(states, "ticker", "status")


def error_counts(errors: DataFrame) -> DataFrame:
    """(component, n, fatal): errors by component, and how many of them can't be recovered from."""
    return errors.groupBy("component").agg(F.count("*").alias("n"), F.count_if(~F.col("recoverable")).alias("fatal"))


def trailing_count(events: DataFrame, by: str, seconds: int) -> DataFrame:
    """Events of the same key in the ``seconds`` up to each event, itself included. A null time counts with the other nulls of its key.

    Each event counts from its time on and no longer once ``seconds`` have passed, so the number is a running sum over arrivals and departures in the order of
    time, in linear work however many events a window holds. Pass narrow rows: a copy of each stands where it departs, without its columns.
    """
    own, at = F.struct("*"), F.unix_micros("ts")
    comes = F.struct(at.alias("at"), F.lit(0).alias("leaves"), F.lit(1).cast("bigint").alias("delta"), own.alias("own"))
    goes = F.struct((at + seconds * 1_000_000).alias("at"), F.lit(1).alias("leaves"), F.lit(-1).cast("bigint").alias("delta"), F.when(F.lit(False), own).alias("own"))
    rows = events.select(F.col(by).alias("__by"), F.explode(F.when(at.isNull(), F.array(comes)).otherwise(F.array(comes, goes))).alias("__x")).select("__by", "__x.*")
    counted = running_sum(rows.withColumn("undated", F.col("at").isNull()), "delta", ["at", "leaves"], "n", ["__by", "undated"], ties=True)  # at one time arrivals come first: an event of exactly ``seconds`` ago still counts
    return counted.where("leaves = 0").select("own.*", "n")


def rate_windows(events: DataFrame, by: str, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(by, start, n, rate): events and events a second in windows."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.groupBy(by, win.alias("w")).agg(F.count("*").alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return rows.select(by, F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def get_runs(states: DataFrame, ids: DataFrame) -> DataFrame:
    """States of the jobs asked for; an id that isn't there has no row."""
    return states.join(ids.select("job_id").distinct(), "job_id")
