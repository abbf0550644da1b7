"""Latency and traffic metrics over an event table (ts, endpoint, method, status, latency_s).

Trailing windows are evaluated on a one-minute grid: events are first reduced to
minutes, and only those few rows are copied to the windows they belong to. The
same functions run on streams wherever they use event-time windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators.scale import ranked, running

# Upper bounds of the histogram buckets in seconds.
HTTP_BOUNDS = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0]
RETRIEVE_BOUNDS = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]
GENERATE_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]

MINUTE_US = 60_000_000


def histogram(events: DataFrame, keys: list[Column | str], bounds: list[float], value: str = "latency_s") -> DataFrame:
    """Per key: ``buckets`` (cumulative counts per bound, then all), ``total`` and ``sum``; one pass."""
    counts = [F.count_if(F.col(value) <= bound) for bound in bounds]
    return events.groupBy(*keys).agg(
        F.array(*counts, F.count(value)).alias("buckets"), F.count(value).alias("total"), F.sum(value).alias("sum")
    )


def latency_histogram(events: DataFrame, bounds: list[float], labels: list[str], value: str = "latency_s") -> DataFrame:
    """One row per label and bound: cumulative count up to ``le`` ('+Inf' last), with sum and count."""
    names = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    rows = histogram(events, labels, bounds, value)
    pairs = F.explode(F.arrays_zip(names.alias("le"), F.col("buckets").alias("n")))
    return rows.select(*labels, "total", F.round("sum", 6).alias("sum"), pairs.alias("p")).select(
        *labels, F.col("p.le").alias("le"), F.col("p.n").alias("cumulative"), "total", "sum"
    )


def histogram_quantile(buckets: Column, bounds: list[float], q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside a bucket.

    A quantile above the last finite bound is that bound; an empty histogram has none.
    """
    uppers = F.array(*[F.lit(float(b)) for b in bounds])

    def between(counts: Column, target: Column, place: Column) -> Column:
        below = F.when(place == 0, F.lit(0)).otherwise(F.get(counts, place - 1))
        lower = F.when(place == 0, F.lit(0.0)).otherwise(F.get(uppers, place - 1))
        share = F.coalesce(F.try_divide(target - below, F.get(counts, place) - below), F.lit(1.0))
        return F.when(place >= len(bounds), F.lit(float(bounds[-1]))).otherwise(
            lower + (F.get(uppers, place) - lower) * share
        )

    def quantile(counts: Column) -> Column:
        target = F.element_at(counts, -1) * F.lit(q)
        found = let(target, lambda t: let(F.size(F.filter(counts, lambda n: n < t)), lambda place: between(counts, t, place)))
        return F.when(F.element_at(counts, -1) > 0, found)

    return let(buckets, quantile)


def _trailing(minutes: DataFrame, keys: list[str], width: int, totals: list[Column]) -> DataFrame:
    """Rows reduced to (keys, minute) summed over the ``width`` minutes that end with ``until``."""
    ends = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.timestamp_micros(F.unix_micros("minute") + (i + 1) * MINUTE_US)
    )
    return minutes.withColumn("until", F.explode(ends)).groupBy(*keys, "until").agg(*totals)


def per_minute(events: DataFrame) -> DataFrame:
    return events.withColumn("minute", F.date_trunc("minute", "ts"))


def latency_quantiles(
    events: DataFrame, bounds: list[float], labels: list[str], width: int = 5, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """Quantiles of the trailing ``width`` minutes per label at each minute with events."""
    n = len(bounds) + 1
    minutes = histogram(per_minute(events), [*labels, "minute"], bounds)
    flat = minutes.select(*labels, "minute", *[F.get("buckets", F.lit(i)).alias(f"b{i}") for i in range(n)])
    summed = _trailing(flat, labels, width, [F.sum(f"b{i}").alias(f"b{i}") for i in range(n)])
    buckets = F.array(*[F.col(f"b{i}") for i in range(n)])
    return summed.select(
        *labels, "until", F.col(f"b{n - 1}").alias("total"),
        *[F.round(histogram_quantile(buckets, bounds, q), 6).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def latency_percentiles(
    events: DataFrame, labels: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000
) -> DataFrame:
    """Percentiles from a mergeable summary of the values instead of fixed buckets; its size is bounded."""
    found = F.percentile_approx("latency_s", list(quantiles), accuracy)
    rows = events.groupBy(*labels).agg(F.count("latency_s").alias("n"), found.alias("p"))
    return rows.select(*labels, "n", *[F.get("p", F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)])


def event_rate(events: DataFrame, labels: list[str], width: int = 1) -> DataFrame:
    """Events per second over the trailing ``width`` minutes."""
    counted = per_minute(events).groupBy(*labels, "minute").agg(F.count("*").alias("n"))
    summed = _trailing(counted, labels, width, [F.sum("n").alias("n")])
    return summed.select(*labels, "until", F.round(F.col("n") / (60.0 * width), 6).alias("rate"))


def hit_ratio(lookups: DataFrame, labels: list[str], width: int = 5) -> DataFrame:
    """Hits, misses and hit ratio (``hit`` is boolean) over the trailing minutes."""
    counted = per_minute(lookups).groupBy(*labels, "minute").agg(
        F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
    summed = _trailing(counted, labels, width, [F.sum("hits").alias("hits"), F.sum("misses").alias("misses")])
    return summed.withColumn("ratio", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 6))


def error_ratio(events: DataFrame, width: int = 1) -> DataFrame:
    """Share of responses with a 5xx status over the trailing minutes."""
    counted = per_minute(events).groupBy("minute").agg(
        F.count_if(F.col("status").startswith("5")).alias("errors"), F.count("*").alias("n")
    )
    summed = _trailing(counted, [], width, [F.sum("errors").alias("errors"), F.sum("n").alias("n")])
    return summed.select("until", "errors", "n", F.round(F.try_divide("errors", "n"), 6).alias("ratio"))


def slowest(events: DataFrame, bounds: list[float] = HTTP_BOUNDS, n: int = 10, width: int = 5) -> DataFrame:
    """The ``n`` endpoints with the highest P95 of the trailing minutes, at each minute."""
    p95 = latency_quantiles(events, bounds, ["endpoint"], width, (0.95,)).filter(F.col("p95").isNotNull())
    return ranked(p95, ["until"], [F.desc("p95"), F.col("endpoint")], n).select("until", "rank", "endpoint", "p95")


def in_flight(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Requests open after each instant at which one started or ended: (ts, open)."""
    steps = starts.select("ts", F.lit(1).alias("step")).unionByName(ends.select("ts", F.lit(-1).alias("step")))
    changes = steps.groupBy("ts").agg(F.sum("step").cast("long").alias("step"))
    return running(changes, [], "ts", F.col("step"), "sum", "open", 10 * MINUTE_US).select("ts", "open")


def request_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests per (method, endpoint, status) and tumbling window; runs on streams too."""
    return (
        events.groupBy(F.window("ts", width), "method", "endpoint", "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "method", "endpoint", "status", "n")
    )


def stage_latency(events: DataFrame, bounds: list[float] = RETRIEVE_BOUNDS) -> DataFrame:
    """Count, mean and quantiles per retrieval stage (each stage timed once)."""
    rows = histogram(events, ["stage"], bounds)
    return rows.select(
        "stage",
        F.col("total").alias("n"),
        F.round(F.try_divide("sum", "total"), 6).alias("mean"),
        *[F.round(histogram_quantile(F.col("buckets"), bounds, q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)],
    )
