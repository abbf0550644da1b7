"""Queries for latency and traffic metrics (M1-M12). Streams are run to their end over the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import reuse_key
from corpusmill.operators import maintenance, metrics
from corpusmill.operators.scale import ranked, shared_folder, stage
from corpusmill.plans.inputs import Inputs
from corpusmill.plans.registry import query
from corpusmill.plans.reuse import FIRINGS
from corpusmill.streaming import live


def _le(bounds: list[float]) -> str:
    return ", ".join(f"('{b}', {b}::DOUBLE)" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"


@query(
    "M1_latency_histogram",
    f"""SELECT method, endpoint, le, count(*) FILTER (latency_s <= bound) AS cumulative, count(*) AS total, round(sum(latency_s), 6) AS sum
    FROM v_metric, (VALUES {_le(metrics.HTTP_BOUNDS)}) b(le, bound) GROUP BY ALL""",
)
def _(i: Inputs):
    return metrics.latency_histogram(i.metrics(), metrics.HTTP_BOUNDS, ["method", "endpoint"])


def _quantile(source: str, keys: str, bounds: list[float], name: str) -> str:
    """CTEs: cumulative counts of ``source`` per key and bound, and the quantiles from them."""
    qs = "(0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)"
    return f"""
    {name}_cum AS (SELECT {keys}, bound, count(*) FILTER (latency_s <= bound) AS n, count(*) AS total
      FROM {source}, (VALUES {_le(bounds)}) b(le, bound) GROUP BY ALL),
    {name}_step AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS lower FROM {name}_cum WINDOW w AS (PARTITION BY {keys} ORDER BY bound)),
    {name}_q AS (SELECT {keys}, q, any_value(total) AS total, arg_min(CASE WHEN bound = 'inf'::DOUBLE THEN {bounds[-1]}::DOUBLE WHEN n = below THEN bound
        ELSE lower + (bound - lower) * (total * q - below) / (n - below) END, bound) AS v
      FROM {name}_step, (VALUES {qs}) p(q) WHERE n >= total * q GROUP BY ALL)"""


PIVOT = "round(max(v) FILTER (q = 0.5), 6) AS p50, round(max(v) FILTER (q = 0.95), 6) AS p95, round(max(v) FILTER (q = 0.99), 6) AS p99"


@query(
    "M2_latency_quantiles",
    f"SELECT endpoint, until, any_value(total) AS total, {PIVOT} FROM m_q GROUP BY endpoint, until",
    _quantile("v_minute", "endpoint, until", metrics.HTTP_BOUNDS, "m"),
)
def _(i: Inputs):
    return metrics.latency_quantiles(i.metrics(), metrics.HTTP_BOUNDS, ["endpoint"])


@query(
    "M2_percentiles_approx",
)
def _(i: Inputs):
    return metrics.latency_percentiles(i.metrics(), ["endpoint"])


@query(
    "M3_event_rate",
    "SELECT method, endpoint, until, round(count(*) / 60e0, 6) AS rate FROM v_minute WHERE k = 0 GROUP BY ALL",
)
def _(i: Inputs):
    return metrics.event_rate(i.metrics(), ["method", "endpoint"], 1)


@query(
    "M4_hit_ratio",
    """SELECT layer, until, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS ratio
    FROM v_minute GROUP BY ALL""",
)
def _(i: Inputs):
    return metrics.hit_ratio(i.metrics(), ["layer"])


@query(
    "M5_error_ratio",
    """SELECT until, count(*) FILTER (status LIKE '5%') AS errors, count(*) AS n, round(count(*) FILTER (status LIKE '5%') / count(*)::DOUBLE, 6) AS ratio
    FROM v_minute WHERE k = 0 GROUP BY until""",
)
def _(i: Inputs):
    return metrics.error_ratio(i.metrics())


@query(
    "M6_slowest",
    """SELECT until, CAST(row_number() OVER (PARTITION BY until ORDER BY p95 DESC, endpoint) AS INT) AS rank, endpoint, p95
    FROM (SELECT until, endpoint, round(v, 6) AS p95 FROM m_q WHERE q = 0.95) QUALIFY rank <= 10""",
    _quantile("v_minute", "endpoint, until", metrics.HTTP_BOUNDS, "m"),
)
def _(i: Inputs):
    return metrics.slowest(i.metrics())


@query(
    "M7_in_flight",
    """SELECT ts, CAST(sum(step) OVER (ORDER BY ts) AS BIGINT) AS open FROM (SELECT ts, sum(step) AS step FROM (
      SELECT date_trunc('second', ts) AS ts, 1 AS step FROM v_metric UNION ALL SELECT end_second, -1 FROM v_metric) GROUP BY ts)""",
)
def _(i: Inputs):
    rows = i.metrics()
    return metrics.in_flight(rows.select(F.date_trunc("second", "ts").alias("ts")), rows.select(F.col("end_second").alias("ts")))


@query(
    "M8_request_counts",
    "SELECT date_trunc('hour', ts) AS start, method, endpoint, status, count(*) AS n FROM v_metric GROUP BY ALL",
)
def _(i: Inputs):
    return metrics.request_counts(i.metrics())


@query(
    "M9_stage_latency",
    f"""SELECT stage, n, mean, p50, p95, p99 FROM (SELECT stage, count(*) AS n, round(sum(latency_s) / count(*), 6) AS mean FROM v_metric GROUP BY stage)
    JOIN (SELECT stage, {PIVOT} FROM s_q GROUP BY stage) USING (stage)""",
    _quantile("v_metric", "stage", metrics.RETRIEVE_BOUNDS, "s"),
)
def _(i: Inputs):
    return metrics.stage_latency(i.metrics())


def _stream(i: Inputs, rows: DataFrame, order: str = "ts", parts: int = 4) -> DataFrame:
    """``rows`` as a stream of files, written one after the other in order; each is a trigger of its own."""
    path = f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    dealt = stage(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "stream-parts")
    for part in range(parts):
        dealt.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(i: Inputs, result: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming query over everything there is and returns what it wrote: all rows, or the last one of each key."""
    path = f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/out-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    sink = live.UpsertSink(path, keys) if keys is not None else None
    running = (
        result.writeStream.outputMode(mode).foreachBatch(sink or write).option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    if sink:
        return sink.read(i.spark, result.schema)
    return i.spark.read.schema(result.schema).parquet(f"{path}/data").select(result.columns)


@query("M8_request_counts_stream", "SELECT date_trunc('hour', ts) AS start, method, endpoint, status, count(*) AS n FROM v_metric GROUP BY ALL")
def _(i: Inputs):
    rows = i.metrics().select("ts", "method", "endpoint", "status")
    return _run(i, live.request_counts_stream(_stream(i, rows)), "update", ["start", "method", "endpoint", "status"])


@query(
    "M2_latency_quantiles_stream",
    f"SELECT endpoint, until, any_value(total) AS total, {PIVOT} FROM m_q GROUP BY endpoint, until",
    _quantile("v_minute", "endpoint, until", metrics.HTTP_BOUNDS, "m"),
)
def _(i: Inputs):
    rows = _stream(i, i.metrics().select("ts", "endpoint", "latency_s"))
    return _run(i, live.latency_quantiles_stream(rows, metrics.HTTP_BOUNDS, ["endpoint"]), "update", ["endpoint", "until"])


@query("M2_percentiles_stream")
def _(i: Inputs):
    """Sketches of minutes from a stream, merged; tests hold them against exact percentiles."""
    rows = _stream(i, i.metrics().select("ts", "endpoint", "latency_s"))
    sketches = _run(i, live.latency_sketches_stream(rows, ["endpoint"]), "update", ["endpoint", "minute"])
    return live.sketched_quantiles(sketches, ["endpoint"])


@query(
    "M3_event_rate_stream",
    "SELECT method, endpoint, until, round(count(*) / 60e0, 6) AS rate FROM v_minute WHERE k = 0 GROUP BY ALL",
)
def _(i: Inputs):
    rows = _stream(i, i.metrics().select("ts", "method", "endpoint"))
    return _run(i, live.event_rate_stream(rows, ["method", "endpoint"]), "update", ["method", "endpoint", "until"])


@query(
    "M4_hit_ratio_stream",
    """SELECT layer, until, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS ratio
    FROM v_minute GROUP BY ALL""",
)
def _(i: Inputs):
    rows = _stream(i, i.metrics().select("ts", "layer", "hit"))
    return _run(i, live.hit_ratio_stream(rows, ["layer"]), "update", ["layer", "until"])


@query(
    "M5_error_ratio_stream",
    """SELECT until, count(*) FILTER (status LIKE '5%') AS errors, count(*) AS n, round(count(*) FILTER (status LIKE '5%') / count(*)::DOUBLE, 6) AS ratio
    FROM v_minute WHERE k = 0 GROUP BY until""",
)
def _(i: Inputs):
    rows = _stream(i, i.metrics().select("ts", "status"))
    return _run(i, live.error_ratio_stream(rows), "update", ["until"])


@query(
    "M6_slowest_stream",
    """SELECT until, CAST(row_number() OVER (PARTITION BY until ORDER BY p95 DESC, endpoint) AS INT) AS rank, endpoint, p95
    FROM (SELECT until, endpoint, round(v, 6) AS p95 FROM m_q WHERE q = 0.95) QUALIFY rank <= 10""",
    _quantile("v_minute", "endpoint, until", metrics.HTTP_BOUNDS, "m"),
)
def _(i: Inputs):
    """Ranked from the windows that the stream has stored."""
    rows = _stream(i, i.metrics().select("ts", "endpoint", "latency_s"))
    windows = _run(i, live.latency_quantiles_stream(rows, metrics.HTTP_BOUNDS, ["endpoint"], quantiles=(0.95,)), "update", ["endpoint", "until"])
    top = ranked(windows.where("p95 IS NOT NULL"), ["until"], [F.desc("p95"), F.col("endpoint")], 10)
    return top.select("until", "rank", "endpoint", "p95")


@query(
    "M9_stage_latency_stream",
    f"""SELECT stage, n, mean, p50, p95, p99 FROM (SELECT stage, count(*) AS n, round(sum(latency_s) / count(*), 6) AS mean FROM v_metric GROUP BY stage)
    JOIN (SELECT stage, {PIVOT} FROM s_q GROUP BY stage) USING (stage)""",
    _quantile("v_metric", "stage", metrics.RETRIEVE_BOUNDS, "s"),
)
def _(i: Inputs):
    rows = _stream(i, i.metrics().select("ts", "stage", "latency_s"))
    return _run(i, live.stage_latency_stream(rows), "update", ["stage"])


@query("M10_hot_questions_stream", "SELECT question, ts FROM walk WHERE fired", FIRINGS)
def _(i: Inputs):
    asks = i.query_log().select("ts", "question")
    return _run(i, live.hot_questions_stream(_stream(i, asks)), "append")


def _late(i: Inputs, rows: DataFrame) -> DataFrame:
    """``rows`` as a stream that brings some of them up to six minutes after others of their time."""
    jitter = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 7) * 60_000_000)
    return _stream(i, rows.withColumn("_order", jitter), "_order").drop("_order")


def _settled(i: Inputs, stream: DataFrame, sink: live.HotQuestions | live.ReuseLog) -> DataFrame:
    """Runs a stream into a sink to the end and returns what it found."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.path}/progress").trigger(availableNow=True).start().awaitTermination()
    sink.finish(i.spark)
    return sink.read(i.spark)


def _sink_path(i: Inputs) -> str:
    return f"{shared_folder(i.spark)}/{i.spark.sparkContext.applicationId}/sink-{uuid.uuid4().hex}"


@query("M10_hot_questions_late", "SELECT question, ts, event_id FROM walk WHERE fired", FIRINGS)
def _(i: Inputs):
    """Four triggers, rows out of order; a question's counter carries over, and a hot one is split as in the batch operator."""
    asks = i.query_log().select("event_id", "ts", "question")
    return _settled(i, _late(i, asks), live.HotQuestions(_sink_path(i), asks.schema))


@query(
    "C1_reuse_exact_stream",
    """SELECT a.event_id, coalesce(answer_id, -1) AS answer_id FROM asks a LEFT JOIN (
      SELECT x.event_id, x.answer_id FROM exact x JOIN asks a USING (event_id) WHERE NOT EXISTS (
        SELECT 1 FROM changes c WHERE c.scope = a.scope AND c.ts <= a.ts AND c.ts > x.cached_at)) USING (event_id)""",
    """
    keyed AS (SELECT event_id, ts, event_type, user_id % 3 AS scope, concat(user_id % 5, '::t', user_id % 7, '::u', user_id) AS key FROM events),
    asks AS (SELECT * FROM keyed WHERE event_type IN ('click', 'view')),
    changes AS (SELECT * FROM keyed WHERE event_type = 'error' AND event_id % 10 = 0),
    exact AS (SELECT a.event_id, max(s.ts) AS cached_at, arg_max(s.event_id, (s.ts, s.event_id)) AS answer_id FROM asks a JOIN keyed s
      ON s.event_type = 'purchase' AND s.key = a.key AND s.ts <= a.ts AND a.ts - s.ts <= INTERVAL 24 HOUR GROUP BY a.event_id)""",
)
def _(i: Inputs):
    """Asks, answers and changes that outdate them in one stream of four triggers, out of order."""
    user, kind = F.col("user_id"), F.col("event_type")
    key = reuse_key((user % 5).cast("string"), user % 7, user)
    named = F.when(kind.isin("click", "view"), "ask").when(kind == "purchase", "answer").when((kind == "error") & (F.col("event_id") % 10 == 0), "change")
    events = i.table("events").select("event_id", "ts", named.alias("kind"), key.alias("key"), (user % 3).alias("scope")).where("kind IS NOT NULL")
    served = _settled(i, _late(i, events), live.ReuseLog(_sink_path(i), events.schema))
    return served.select("event_id", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"))


@query(
    "M11_dedup_stream",
    """SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')""",
)
def _(i: Inputs):
    docs = i.table("documents").select("source", maintenance.file_hash(F.col("text")).alias("file_hash"))
    arrivals = docs.filter("source != 'src0'").select("file_hash", F.timestamp_seconds(F.lit(1_704_067_200)).alias("ts"))
    corpus = docs.filter("source = 'src0'").select("file_hash")
    return _run(i, live.dedup_stream(_stream(i, arrivals, "file_hash"), corpus).select("file_hash"), "append")


@query("M12_daily_stats_stream", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(latency_s), 6) AS total FROM v_metric GROUP BY day")
def _(i: Inputs):
    rows = i.metrics().select("ts", "latency_s")
    return _run(i, live.daily_stats_stream(_stream(i, rows), "latency_s"), "update", ["day"]).withColumn("total", F.round("total", 6))
