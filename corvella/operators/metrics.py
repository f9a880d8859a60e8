"""Request counters and latency histograms, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def request_counter(samples: DataFrame) -> DataFrame:
    return samples.groupBy("method", "endpoint", "status").agg(F.count("*").alias("requests"))


def latency_histogram(samples: DataFrame, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts by bound (le), in one pass over the samples; +Inf counts all."""
    named = {f"b{i}": F.count(F.when(F.col("duration_s") <= b, 1)) for i, b in enumerate(bounds)}
    wide = samples.groupBy("method", "endpoint").agg(*[c.alias(n) for n, c in named.items()], F.count("duration_s").alias("observations"), F.sum("duration_s").alias("total_s"))
    buckets = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("cumulative")))
    return wide.select("method", "endpoint", F.explode(buckets).alias("b"), "observations", "total_s").select("method", "endpoint", "b.le", "b.cumulative", "observations", "total_s")


def exposition(samples: DataFrame, name: str = "http_requests_total") -> DataFrame:
    """The counter as lines of text."""
    labels = F.concat(F.lit('{method="'), "method", F.lit('",endpoint="'), "endpoint", F.lit('",status="'), F.col("status").cast("string"), F.lit('"} '))
    return request_counter(samples).select(F.concat(F.lit(name), labels, F.col("requests").cast("string")).alias("line"))
