"""Structured Streaming jobs: incremental ingest, run states, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofsieve.functions.text import clean_section_text
from proofsieve.operators.index import build_chunks, chunk_fixed, slice_sections, upsert
from proofsieve.sources.scratch import work_dir as work_dir

#: States after which a run isn't stale.
FINAL = ["completed", "failed"]


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table, a folder or one file, as a stream with the table's schema. The stream's source takes one file only by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a stream over all that is there, batch by batch, and returns the query that has ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def ingest_stream(filings: DataFrame, index: str, checkpoint: str, size: int = 1000, overlap: int = 200, sections: bool = False) -> None:
    """Filings (ticker, filing_type, filing_date, raw_name, text) to chunks, added to the log at ``index`` batch by batch. With ``sections`` the texts
    are whole filings, without a raw_name, and are cut into their sections first.

    A batch writes its own chunks alone, under its number, so the cost follows the batch and not the index; one that is run again after a failure
    replaces what it wrote. ``index_of`` reads the log as an index, ``compact`` shortens it.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch
        if sections:
            named = batch.withColumn("document_id", F.struct("ticker", "filing_type", "filing_date"))
            rows = slice_sections(named).select("document_id.*", F.col("section_key").alias("raw_name"), F.col("content").alias("text"))
        chunked = chunk_fixed(rows.withColumn("content", clean_section_text("text")), "content", size, overlap).withColumn("company_name", F.lit(None).cast("string"))
        chunks = build_chunks(chunked.select("ticker", "company_name", "filing_type", "filing_date", "raw_name", "chunk_index", "chunk_text"))
        chunks.write.mode("overwrite").parquet(f"{index}/batch={number}")

    run_to_end(filings, "append", checkpoint, put)


def _numbers(spark: SparkSession, index: str, kind: str) -> list[int]:
    """The numbers of a log's folders of a kind: ``batch`` of the stream, ``base`` of compactions, ``manifest`` of compactions that are complete."""
    home = spark._jvm.org.apache.hadoop.fs.Path(index)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(home)] if files.exists(home) else []
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))


def index_of(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of a log, of each id those of the last batch that has it; chunk ids follow from the filing, so nothing is entered twice.

    Only the newest base and the batches after it are read; a base alone has each id once already.
    """
    upto = max(_numbers(spark, index, "manifest"), default=-1)
    newer = [n for n in _numbers(spark, index, "batch") if n > upto]
    parts = [spark.read.parquet(f"{index}/base={upto}")] if upto >= 0 else []
    if newer:
        rows = spark.read.option("basePath", index).parquet(*[f"{index}/batch={n}" for n in newer])
        parts.append(rows.withColumn("version", F.col("batch").cast("bigint")).drop("batch"))
    if upto >= 0 and not newer:
        return parts[0]
    chunks = reduce(DataFrame.unionByName, parts)
    return upsert(chunks.limit(0), chunks)


def compact(spark: SparkSession, index: str) -> int:
    """Writes the log up to its last batch as one base, and returns that batch's number.

    The base counts from when its manifest is there, which is written last: a compaction that fails changes nothing, one that is run again writes the same.
    Folders that no longer count may be deleted when nobody reads them any more.
    """
    upto = max(_numbers(spark, index, "batch"), default=-1)
    if upto > max(_numbers(spark, index, "manifest"), default=-1):
        index_of(spark, index).write.mode("overwrite").parquet(f"{index}/base={upto}")
        spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{index}/manifest={upto}")
    return upto


def run_states(events: DataFrame, stale_after_s: int = 86_400, lateness: str = "10 minutes", keep_final_s: int = 3_600) -> DataFrame:
    """Changes (job_id, status, ts, event_id) of run states from a stream of (job_id, status, ts, event_id).

    A transition that is older than the state is ignored. A run that isn't final is 'stale' once the watermark passes its last transition by ``stale_after_s``.
    Every state has a timer: that of a final run is removed without a row once the watermark passes its last transition by ``keep_final_s``, so what is kept
    follows the runs of the last while and not all runs ever. A transition after that begins a new state; older ones are late by then and dropped.
    """
    def change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, ms, event = state.get
            state.remove()
            if status not in FINAL:
                yield pd.DataFrame({"job_id": [key[0]], "status": ["stale"], "ts": [pd.Timestamp(ms, unit="ms")], "event_id": [event]})
            return
        old = state.get if state.exists else None
        best = (old[1], old[2], old[0]) if old else None
        for frame in frames:
            for ts, event, status in zip(frame["ts"], frame["event_id"], frame["status"], strict=True):
                now = (int(ts.timestamp() * 1000), int(event), status)
                best = now if best is None or now[:2] > best[:2] else best
        state.update((best[2], best[0], best[1]))
        wait = keep_final_s if best[2] in FINAL else stale_after_s
        state.setTimeoutTimestamp(max(best[0] + wait * 1000, state.getCurrentWatermarkMs() + 1))
        if old is None or best[:2] != (old[1], old[2]):
            yield pd.DataFrame({"job_id": [key[0]], "status": [best[2]], "ts": [pd.Timestamp(best[0], unit="ms")], "event_id": [best[1]]})

    keyed = events.withWatermark("ts", lateness).groupBy("job_id")
    return keyed.applyInPandasWithState(change, "job_id bigint, status string, ts timestamp, event_id bigint", "status string, ms bigint, event_id bigint", "update", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, by: str, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(by, start, n) of a stream of events in tumbling or sliding windows; rows later than ``lateness`` are dropped in append and update mode."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(by, window.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def session_windows(events: DataFrame, by: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of a stream of events in sessions: events of a key belong together while each comes less than ``gap`` after the one before."""
    return events.withWatermark("ts", lateness).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def in_arrivals(spark: SparkSession, arrivals: list[DataFrame], rows: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """What ``rows`` makes in append mode of a stream whose files come in several lots, the stream being stopped and started again in between.

    A lot is written to the stream's folder, the stream runs to the end of what is there, and what it gives out is final. A window is given out once the
    watermark has passed its end, rows of windows that have been given out are dropped, and windows still open at the end stay in the state.
    """
    for lot in arrivals:
        lot.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(arrivals[0].schema).parquet(f"{base}/in")
        made = rows(stream)
        run_to_end(made, "append", f"{base}/checkpoint", lambda df, k: df.write.mode("overwrite").parquet(f"{base}/out/batch={k}"))
    return spark.read.option("basePath", f"{base}/out").schema(made.schema).parquet(f"{base}/out/batch=*").drop("batch")
