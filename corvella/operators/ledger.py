"""The ledger of tasks: what was done, what may run again, what may go."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corvella.config import Settings

DEFAULTS = Settings()
KEYS = ["task_name", "task_args_hash"]


def _seconds(time: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone."""
    return time.cast("timestamp").cast("double")


@pandas_udf(T.StringType())
def _json_text(value: pd.Series) -> pd.Series:
    return value.map(json.dumps, na_action="ignore")


@pandas_udf(T.StringType())
def _json_number(value: pd.Series) -> pd.Series:
    return value.map(lambda x: json.dumps(float(x)), na_action="ignore")


def json_value(value: Column) -> Column:
    """A value as JSON writes it, in ASCII: strings, dates and times in quotes, true and false, numbers, null."""
    kind = F.typeof(value)
    text = (
        F.when(kind.isin("double", "float"), _json_number(value.cast("double")))
        .when(kind.isin("boolean", "tinyint", "smallint", "int", "bigint"), value.cast("string"))
        .otherwise(_json_text(value.cast("string")))
    )
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def args_hash(task_name: Column, args: dict[str, Column]) -> Column:
    """SHA-256 of the arguments and the task's name as JSON with sorted keys and a space after each mark."""
    parts = [F.concat(F.lit(f"{json.dumps(k)}: "), json_value(v)) for k, v in sorted({**args, "task_name": task_name}.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def latest(ledger: DataFrame) -> DataFrame:
    """The newest entry of each task; of equal times the higher execution_id.  Aggregated before the shuffle, so that a task with many entries is no burden."""
    newest = F.max_by(F.struct(*[c for c in ledger.columns if c not in KEYS]), F.struct("created_at", "execution_id"))
    return ledger.groupBy(*KEYS).agg(newest.alias("_r")).select(*[F.col(c) if c in KEYS else F.col(f"_r.{c}").alias(c) for c in ledger.columns])


def should_run(status: Column, started_at: Column, now: Column, limit: int = DEFAULTS.task_seconds) -> Column:
    """Whether a task runs: an unknown or failed one does, a finished one does not, one under way only if it is stuck."""
    age = _seconds(now) - _seconds(started_at)
    stuck = F.coalesce(age > limit + DEFAULTS.task_grace_seconds, F.lit(False))
    return F.when(status.isNull(), F.lit(True)).when(status == "SUCCESS", F.lit(False)).when(status.isin("PENDING", "STARTED", "RETRY"), stuck).otherwise(F.lit(True))


def decisions(requests: DataFrame, ledger: DataFrame, now: Column, limit: int = DEFAULTS.task_seconds) -> DataFrame:
    """``requests`` with the status on record and run."""
    known = latest(ledger).select(*KEYS, "status", "started_at")
    return requests.join(known, KEYS, "left").withColumn("run", should_run(F.col("status"), F.col("started_at"), now, limit))


def updated(ledger: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The ledger after status changes (execution_id, new_status, new_result): STARTED sets the start, SUCCESS and FAILURE the end; a blank result leaves the old."""
    joined = ledger.join(changes, "execution_id", "left")
    status = F.col("new_status")
    return joined.select(
        *[F.col(c) for c in ledger.columns if c not in ("status", "result", "started_at", "completed_at", "updated_at")],
        F.coalesce(status, "status").alias("status"),
        F.coalesce(F.nullif("new_result", F.lit("")), "result").alias("result"),
        F.when(status == "STARTED", now).otherwise(F.col("started_at")).alias("started_at"),
        F.when(status.isin("SUCCESS", "FAILURE"), now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(status.isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*ledger.columns)


def kept(ledger: DataFrame, now: Column, seconds: int = DEFAULTS.retention_seconds) -> DataFrame:
    """The ledger without finished tasks older than the retention time."""
    old = F.coalesce(_seconds(F.col("created_at")) < _seconds(now) - seconds, F.lit(False))
    return ledger.where(~(old & F.col("status").isin("SUCCESS", "FAILURE")))


def status_signal(status: Column, known: Column) -> Column:
    """What a poll is told about a task."""
    return (
        F.when((status == "PENDING") & ~known, F.lit("not_found"))
        .when(status == "SUCCESS", F.lit("completed"))
        .when(status.isin("FAILURE", "REVOKED"), F.lit("failed"))
        .otherwise(F.lit("pending"))
    )


def public_result(result: Column) -> Column:
    """A result map without its internal keys."""
    return F.map_filter(result, lambda k, _: ~k.startswith("_"))


def recorded(ledger: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """The ledger with an entry for each new task (task_name, task_args_hash and more) that has none: PENDING, begun now.  A task given twice is entered once."""
    fresh = tasks.dropDuplicates(KEYS).join(ledger.select(*KEYS), KEYS, "left_anti")
    times = {c: now for c in ("started_at", "created_at") if c in ledger.columns}
    return ledger.unionByName(fresh.withColumns({"status": F.lit("PENDING"), **times}), allowMissingColumns=True).select(*ledger.columns)
