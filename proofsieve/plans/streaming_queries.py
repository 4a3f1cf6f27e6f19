"""Queries of the streaming jobs: each table is read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsieve.plans import views as V
from proofsieve.plans.evaluation_queries import STATUS
from proofsieve.sources.scratch import written
from proofsieve.streaming import streams as Z

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT document_id, count(*) AS n_chunks FROM (SELECT upper(source) || '_' || lang || '_' || doc_id AS document_id, unnest(range(0, greatest(length(t) - 201, 0) // 800 + 1)) AS i, t FROM
(SELECT source, lang, doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS t FROM documents) WHERE length(t) > 0)
WHERE trim(t[i * 800 + 1:i * 800 + 1000], ' ' || chr(9) || chr(10) || chr(13) || chr(12)) <> '' GROUP BY 1""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = Z.stream_of(spark, f"{d}/documents.parquet")
    filings = docs.select(F.upper("source").alias("ticker"), F.col("lang").alias("filing_type"), F.col("doc_id").cast("string").alias("filing_date"), F.lit("Business").alias("raw_name"), "text")
    base = Z.work_dir(spark, "stream-ingest")
    Z.ingest_stream(filings, f"{base}/index", f"{base}/checkpoint")
    return Z.index_of(spark, f"{base}/index").groupBy("document_id").agg(F.count("*").alias("n_chunks"))


CLEAN = r"trim(regexp_replace(regexp_replace(replace({}, chr(13) || chr(10), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


@query(f"""WITH {V.FILINGS}, {V.FILING_PIECES}, cleaned AS (SELECT document_id, section_key, {CLEAN.format('content')} AS t FROM sections),
cut AS (SELECT document_id, section_key, trim(t[i * 800 + 1:i * 800 + 1000], ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS x FROM (SELECT *, unnest(range(0, greatest(length(t) - 201, 0) // 800 + 1)) AS i FROM cleaned WHERE length(t) > 0))
SELECT document_id, section_key, count(*) AS n_chunks, sum(length(x))::BIGINT AS n_chars FROM cut WHERE x <> '' GROUP BY 1, 2""")
def stream_sections(spark: SparkSession, d: str) -> DataFrame:
    """Whole filings through sections to chunks, in two arrivals, the log being compacted after each."""
    base = Z.work_dir(spark, "stream-sections")
    filings = V.filings(spark, d).select("ticker", F.lit("10-K").alias("filing_type"), F.col("document_id").alias("filing_date"), "text")
    made = written(filings, "stream-filings")  # put together once for both arrivals
    for k in range(2):
        made.where(F.pmod(F.xxhash64("filing_date"), F.lit(2)) == k).write.mode("append").parquet(f"{base}/in")
        Z.ingest_stream(spark.readStream.schema(filings.schema).parquet(f"{base}/in"), f"{base}/index", f"{base}/checkpoint", sections=True)
        Z.compact(spark, f"{base}/index")
    return Z.index_of(spark, f"{base}/index").groupBy(F.col("metadata")["filing_date"].alias("document_id"), "section_key").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(f"SELECT job_id, status FROM (SELECT user_id AS job_id, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_run_state(spark: SparkSession, d: str) -> DataFrame:
    events = Z.stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("job_id"), F.expr(STATUS).alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    base = Z.work_dir(spark, "stream-runs")
    Z.run_to_end(Z.run_states(events), "update", f"{base}/checkpoint", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{base}/changes/batch={k}"))
    changes = spark.read.parquet(f"{base}/changes").where("status <> 'stale'")
    last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("batch").desc()))
    return changes.withColumn("nth", last).where("nth = 1").select("job_id", "status")


#: Events in two arrivals: one in fifty comes after all others. The watermark follows the latest event of the first arrival, then of both.
LATE = """e AS (SELECT *, event_id % 50 = 0 AS late FROM events), mark AS (SELECT date_trunc('millisecond', max(ts) FILTER (NOT late)) - INTERVAL 10 MINUTES AS first, date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES AS last FROM e)"""


def _arrivals(spark: SparkSession, d: str, *columns: str) -> list[DataFrame]:
    events = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return [events.where(f"event_id % 50 {way} 0").select(*columns, "ts") for way in ("<>", "=")]


@query(f"""WITH {LATE} SELECT event_type, CAST(w AS VARCHAR) AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, late FROM e), mark
WHERE w + INTERVAL 1 HOUR <= last AND (NOT late OR w + INTERVAL 1 HOUR > first) GROUP BY 1, 2""")
def stream_windows_append(spark: SparkSession, d: str) -> DataFrame:
    """In append mode: windows that the watermark has passed, each once, without the events that came after that."""
    base = Z.work_dir(spark, "stream-append")
    return Z.in_arrivals(spark, _arrivals(spark, d, "event_type"), lambda s: Z.event_windows(s, "event_type"), base).withColumn("start", F.col("start").cast("string"))


@query(f"""WITH {LATE}, cut AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM e WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM cut),
session AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTES AS t, count(*) AS n FROM numbered GROUP BY user_id, k)
SELECT user_id, CAST(s AS VARCHAR) AS start, CAST(t AS VARCHAR) AS "end", n FROM session, mark WHERE t <= first""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user that are over, of the events that came in time."""
    base = Z.work_dir(spark, "stream-sessions")
    made = Z.in_arrivals(spark, _arrivals(spark, d, "user_id")[:1], lambda s: Z.session_windows(s, "user_id"), base)
    return made.select("user_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """In complete mode, which leaves no window open at the end."""
    events = Z.stream_of(spark, f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    base = Z.work_dir(spark, "stream-windows")
    Z.run_to_end(Z.event_windows(events, "event_type"), "complete", f"{base}/checkpoint", lambda df, k: df.write.mode("overwrite").parquet(f"{base}/windows"))
    return spark.read.parquet(f"{base}/windows").withColumn("start", F.col("start").cast("string"))
