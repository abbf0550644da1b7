"""Event-time queries over streams; the batch forms live in ``operators``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.functions.text import normalize_question
from corpusmill.operators.metrics import RETRIEVE_BOUNDS, histogram_quantile, request_counts, stage_latency
from corpusmill.operators.reuse import ANSWER_TTL, DAY_SECONDS, HOT_ASKS, hot_firings, reuse_exact
from corpusmill.operators.scale import latest_before, ranked, stage

LATENESS = "10 minutes"


def hot_questions_stream(stream: DataFrame, n: int = HOT_ASKS, window_seconds: int = DAY_SECONDS) -> DataFrame:
    """Asks (question, ts) at which a question's counter reaches ``n`` within the window and resets.

    The state of a question is at most ``n - 1`` times, and it is dropped once
    the watermark has passed the window of the last ask.
    """
    width = window_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        fired = []
        for at in sorted(t for pdf in batches for t in pdf["at"]):
            times = [t for t in times if at - t <= width] + [at]
            if len(times) >= n:
                fired.append(at)
                times = []
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max(times[-1] // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame({"question": key[0], "ts": pd.to_datetime(fired, unit="us")})

    asks = stream.withWatermark("ts", LATENESS).select(
        normalize_question(F.col("question")).alias("question"), "ts", F.unix_micros("ts").alias("at")
    )
    return asks.groupBy("question").applyInPandasWithState(
        step, "question string, ts timestamp", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def dedup_stream(stream: DataFrame, corpus: DataFrame) -> DataFrame:
    """Arriving documents (file_hash, ts) that neither the corpus nor the stream so far holds.

    The state keeps every hash of the stream for good, however late its copy arrives; it is
    dealt by hash and grows with the distinct hashes.
    """
    fresh = stream.dropDuplicates(["file_hash"])
    return fresh.join(corpus.select("file_hash").distinct(), "file_hash", "left_anti")


def daily_stats_stream(stream: DataFrame, value: str | None = None) -> DataFrame:
    """Events per day, with the sum of ``value`` if given; for update or complete output."""
    totals = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    days = stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 day")).agg(*totals)
    return days.select(F.to_date("window.start").alias("day"), *[c for c in days.columns if c != "window"])


def request_counts_stream(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    return request_counts(stream.withWatermark("ts", LATENESS), width)


# ---- trailing windows ------------------------------------------------------


def _trailing(stream: DataFrame, labels: list[str], width: int, totals: list[Column], lateness: str) -> DataFrame:
    """Sums of the ``width`` minutes that end with ``until``, per label; for update output. Windows behind the watermark leave the state."""
    windows = F.window("ts", f"{width} minutes", "1 minute")
    summed = stream.withWatermark("ts", lateness).groupBy(windows.alias("w"), *labels).agg(*totals)
    return summed.select(*labels, F.col("w.end").alias("until"), *[c for c in summed.columns if c != "w" and c not in labels])


def latency_quantiles_stream(
    stream: DataFrame, bounds: list[float], labels: list[str], width: int = 5, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), lateness: str = LATENESS
) -> DataFrame:
    """``metrics.latency_quantiles`` on a stream: one count for each bound is all the state of a window."""
    counts = [F.count_if(F.col("latency_s") <= bound).alias(f"b{i}") for i, bound in enumerate(bounds)]
    summed = _trailing(stream, labels, width, [*counts, F.count("latency_s").alias("total")], lateness)
    buckets = F.array(*[F.col(f"b{i}") for i in range(len(bounds))], F.col("total"))
    return summed.select(*labels, "until", "total", *[F.round(histogram_quantile(buckets, bounds, q), 6).alias(f"p{round(q * 100)}") for q in quantiles])


def latency_sketches_stream(stream: DataFrame, labels: list[str], lateness: str = LATENESS) -> DataFrame:
    """(labels, minute, sketch): a KLL sketch of the latencies of each minute, for any later window to merge."""
    minutes = F.window("ts", "1 minute")
    made = stream.withWatermark("ts", lateness).groupBy(minutes.alias("w"), *labels).agg(F.count("latency_s").alias("n"), F.expr("kll_sketch_agg_double(latency_s)").alias("sketch"))
    return made.select(*labels, F.col("w.start").alias("minute"), "n", "sketch")


def sketched_quantiles(sketches: DataFrame, labels: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of merged sketches per label; their rank is off by under two percent."""
    merged = sketches.groupBy(*labels).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    return merged.select(*labels, "n", *[F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)").alias(f"p{round(q * 100)}") for q in quantiles])


def event_rate_stream(stream: DataFrame, labels: list[str], width: int = 1, lateness: str = LATENESS) -> DataFrame:
    """``metrics.event_rate`` on a stream."""
    summed = _trailing(stream, labels, width, [F.count("*").alias("n")], lateness)
    return summed.select(*labels, "until", F.round(F.col("n") / (60.0 * width), 6).alias("rate"))


def hit_ratio_stream(stream: DataFrame, labels: list[str], width: int = 5, lateness: str = LATENESS) -> DataFrame:
    """``metrics.hit_ratio`` on a stream."""
    totals = [F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")]
    return _trailing(stream, labels, width, totals, lateness).withColumn("ratio", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 6))


def error_ratio_stream(stream: DataFrame, width: int = 1, lateness: str = LATENESS) -> DataFrame:
    """``metrics.error_ratio`` on a stream."""
    totals = [F.count_if(F.col("status").startswith("5")).alias("errors"), F.count("*").alias("n")]
    summed = _trailing(stream, [], width, totals, lateness)
    return summed.select("until", "errors", "n", F.round(F.try_divide("errors", "n"), 6).alias("ratio"))


def stage_latency_stream(stream: DataFrame, bounds: list[float] = RETRIEVE_BOUNDS) -> DataFrame:
    """``metrics.stage_latency`` on a stream, over all of it: the state is one row for each stage."""
    return stage_latency(stream, bounds)


class UpsertSink:
    """Rows by key under ``path``: each batch of an update stream in a folder of its own, the last one of a key counts.

    A batch that runs again replaces its folder, so nothing counts twice. ``compact`` merges what there is into
    buckets of keys, written beside the old ones before it takes their place in the list of bases.
    """

    def __init__(self, path: str, keys: list[str], buckets: int = 16):
        self.path, self.keys, self.buckets = path, keys, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        keys = [F.col(k) for k in self.keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*self.keys, "_r.*")

    def _bases(self, spark: SparkSession) -> int | None:
        """The last batch that a whole base holds."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bases")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return None
        done = [s.getPath() for s in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("-")[1]) for p in done), default=None)

    def _rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        stored = StructType([*schema.fields, StructField("batch", LongType())])
        base = self._bases(spark)
        rows = spark.read.schema(stored).parquet(f"{self.path}/changes")
        if base is None:
            return rows
        merged = spark.read.schema(stored).parquet(f"{self.path}/bases/base-{base}").select(*stored.names)
        return merged.unionByName(rows.where(F.col("batch") > base))

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The rows as they are now, one for each key."""
        return self._latest(self._rows(spark, schema)).select(*schema.names)

    def compact(self, spark: SparkSession, schema: StructType) -> None:
        """A base of all batches so far; later reads take it and newer batches only."""
        rows = self._rows(spark, schema)
        last = rows.agg(F.max("batch")).first()[0]
        if last is None:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        whole = self._latest(rows).withColumn("bucket", bucket)
        whole.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/bases/base-{last}")


# ---- state in stored tables ------------------------------------------------


class _Settled:
    """Micro-batches that wait for the watermark: rows are worked on in order of time, once none before them can come.

    Each batch writes its state to a folder of its own and reads that of the batch before, so a batch
    that runs again does the same. Rows later than the watermark is are refused and counted. A hot key is worked on
    by the batch operators, which split it; no task holds the state of a key.
    """

    def __init__(self, path: str, schema: StructType, lateness_seconds: int = 600):
        self.path, self.schema, self.lateness = path, schema, lateness_seconds

    def _read(self, spark: SparkSession, name: str, batch_id: int, schema: StructType) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch_id}")

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={batch_id}")

    MARKS = StructType([StructField("seen_us", LongType()), StructField("refused", LongType())])

    def __call__(self, batch: DataFrame, batch_id: int, final: bool = False) -> None:
        spark = batch.sparkSession
        before = self._read(spark, "marks", batch_id - 1, self.MARKS).first()
        seen, refused = (before["seen_us"], before["refused"]) if before else (None, 0)
        floor = F.timestamp_micros(F.lit((seen or 0) - self.lateness * 1_000_000))
        arrived = stage(batch.select(self.schema.names), "arrived")
        fresh = arrived.where(F.col("ts") >= floor) if seen is not None else arrived
        counted = arrived.agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last")).first()
        refused += counted["n"] - fresh.count()
        newest = max(x for x in (seen, counted["last"], 0) if x is not None)
        pending = self._read(spark, "pending", batch_id - 1, self.schema).unionByName(fresh)
        due = F.lit(True) if final else F.col("ts") < F.timestamp_micros(F.lit(newest - self.lateness * 1_000_000))
        self._write("pending", batch_id, pending.where(~due))
        self._settle(stage(pending.where(due), "due"), batch_id, newest)
        self._write("marks", batch_id, spark.createDataFrame([(newest, refused)], self.MARKS))

    def _settle(self, due: DataFrame, batch_id: int, newest_us: int) -> None:
        raise NotImplementedError

    def last_batch(self, spark: SparkSession) -> int:
        found = spark.read.parquet(f"{self.path}/marks").agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def finish(self, spark: SparkSession) -> None:
        """Works on what still waits, as if time had passed."""
        self(spark.createDataFrame([], self.schema), self.last_batch(spark) + 1, final=True)

    def refused(self, spark: SparkSession) -> int:
        return self._read(spark, "marks", self.last_batch(spark), self.MARKS).first()["refused"]


class HotQuestions(_Settled):
    """``reuse.hot_firings`` over micro-batches: (question, ts, event_id) of asks at which a question's counter fires.

    What a question carries over is its last asks since it fired, fewer than ``n``; questions whose asks have left the window are dropped.
    """

    def __init__(self, path: str, schema: StructType, n: int = HOT_ASKS, window_seconds: int = DAY_SECONDS, lateness_seconds: int = 600):
        super().__init__(path, schema, lateness_seconds)
        self.n, self.window = n, window_seconds

    def _settle(self, due: DataFrame, batch_id: int, newest_us: int) -> None:
        asks = due.withColumn("question", normalize_question(F.col("question")))
        carried = self._read(due.sparkSession, "carried", batch_id - 1, self.schema)
        log = stage(carried.unionByName(asks), "asks")
        fired = self._write("fired", batch_id, hot_firings(log, self.n, self.window))
        last = fired.groupBy("question").agg(F.max(F.struct("ts", "event_id")).alias("fired"))
        open_ = log.join(last, "question", "left").where(F.col("fired").isNull() | (F.struct("ts", "event_id") > F.col("fired")))
        alive = open_.where(F.unix_micros("ts") >= newest_us - (self.window + self.lateness) * 1_000_000)
        kept = ranked(alive.select(self.schema.names), ["question"], [F.desc("ts"), F.desc("event_id")], self.n - 1)
        self._write("carried", batch_id, kept.select(self.schema.names))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/fired").drop("batch")


class ReuseLog(_Settled):
    """Exact reuse over micro-batches of one stream of events (kind, key, scope, ts, event_id): asks, stored answers and changes of a scope.

    An ask gets the newest answer of its key not older than ``ttl`` that no change of its scope has outdated (C1 and C9
    in one). Answers leave the state when they are too old for any ask to come; of changes the last one of each scope stays.
    """

    def __init__(self, path: str, schema: StructType, ttl: int = ANSWER_TTL, lateness_seconds: int = 600):
        super().__init__(path, schema, lateness_seconds)
        self.ttl = ttl

    def _settle(self, due: DataFrame, batch_id: int, newest_us: int) -> None:
        spark = due.sparkSession
        entries = stage(self._read(spark, "entries", batch_id - 1, self.schema).unionByName(due.where("kind <> 'ask'")), "entries")
        asks = due.where("kind = 'ask'").select("event_id", "ts", "key", "scope")
        answers = entries.where("kind = 'answer'").select("key", F.col("ts").alias("cached_at"), F.col("event_id").alias("answer_id"))
        found = reuse_exact(asks, answers, self.ttl)
        changed = entries.where("kind = 'change'").select("scope", F.col("ts").alias("changed_at"), F.lit(1).alias("one"))
        dated = latest_before(found, changed, ["scope"], "ts", "changed_at", ["one"], "change")
        alive = F.col("change").isNull() | (F.col("cached_at") >= F.col("change.at"))
        self._write("served", batch_id, dated.select("event_id", F.when(alive, F.col("answer_id")).alias("answer_id"), F.when(alive, F.col("cached_at")).alias("cached_at")))
        young = entries.where((F.col("kind") == "answer") & (F.unix_micros("ts") >= newest_us - (self.ttl + self.lateness) * 1_000_000))
        last = entries.where("kind = 'change'").groupBy("scope").agg(F.max_by(F.struct(*self.schema.names), F.struct("ts", "event_id")).alias("r")).select("r.*")
        self._write("entries", batch_id, young.select(self.schema.names).unionByName(last.select(self.schema.names)))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/served").drop("batch")
