"""Finding statements in the history. ``as_of`` stands in for the current time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.functions.formats import with_unit
from workloom.functions.metrics import TASK_MS_USD
from workloom.sources.workspace import task_cost


def _since(as_of: str, hours: int) -> Column:
    return F.col("start_time") >= F.expr(f"CAST('{as_of}' AS TIMESTAMP_NTZ) - INTERVAL '{int(hours)}' HOUR")


def _top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order, F.col("statement_id")).limit(limit)


def by_ids(history: DataFrame, ids: DataFrame) -> DataFrame:
    """Batched point lookup; ``ids`` has one column statement_id."""
    return history.join(ids, "statement_id", "left_semi")


def recent(history: DataFrame, as_of: str, user: str, hours: int = 24, limit: int = 20,
           status: str | None = None) -> DataFrame:
    out = history.filter(_since(as_of, hours) & (F.col("executed_by") == user))
    if status is not None:
        out = out.filter(F.col("execution_status") == status)
    return _top(out, limit, F.desc("start_time"))


def slow(history: DataFrame, as_of: str, hours: int = 24, min_duration_seconds: float = 60,
         limit: int = 20, user: str | None = None) -> DataFrame:
    out = history.filter(
        _since(as_of, hours)
        & (F.col("total_duration_ms") >= min_duration_seconds * 1000)
        & (F.col("execution_status") == "FINISHED")
    )
    if user is not None:
        out = out.filter(F.col("executed_by") == user)
    return _top(out, limit, F.desc("total_duration_ms"))


def expensive(history: DataFrame, as_of: str, hours: int = 24, min_cost_usd: float = 1.0,
              limit: int = 20, user: str | None = None) -> DataFrame:
    out = history.filter(
        _since(as_of, hours)
        & (F.col("total_task_duration_ms") >= min_cost_usd / TASK_MS_USD)
        & (F.col("execution_status") == "FINISHED")
    )
    if user is not None:
        out = out.filter(F.col("executed_by") == user)
    return _top(out, limit, F.desc("total_task_duration_ms"))


def search_text(history: DataFrame, as_of: str, needle: str, hours: int = 168, limit: int = 20,
                user: str | None = None) -> DataFrame:
    """Literal, case-insensitive substring search."""
    out = history.filter(
        _since(as_of, hours) & F.contains(F.lower("statement_text"), F.lit(needle.lower()))
    )
    if user is not None:
        out = out.filter(F.col("executed_by") == user)
    return _top(out, limit, F.desc("start_time"))


def listing(history: DataFrame) -> DataFrame:
    """Preview rows: 100 characters of text, seconds, cost or N/A, and one display line."""
    cost = task_cost(F.col("total_task_duration_ms"))
    cost_text = F.when(cost > 0, with_unit(cost, 2, "", "$")).otherwise("N/A")
    seconds = with_unit(F.col("total_duration_ms") / 1000, 1, "s")
    preview = F.substring("statement_text", 1, 100)
    return history.select(
        "statement_id", preview.alias("preview"), seconds.alias("duration"), cost_text.alias("cost"),
        F.when(F.length(preview) > 50, F.concat(F.substring(preview, 1, 47), F.lit("...")))
        .otherwise(preview).alias("short_preview"),
        F.concat_ws(
            " | ", "statement_id", "executed_by", seconds, cost_text,
            F.concat(F.substring(preview, 1, 50), F.lit("...")),
        ).alias("display"),
    )


def workspace_candidates(history: DataFrame, as_of: str, hours: int = 168, min_duration_ms: int = 0,
                         limit: int | None = None, users: list[str] | None = None,
                         min_cost_usd: float | None = None, limit_first: bool = False) -> DataFrame:
    """The workspace batch: finished statements that match, all of them unless ``limit`` says how
    many of the longest are wanted.

    ``limit_first`` takes the longest before several users and the cost are looked at, so fewer
    than ``limit`` rows may match; a single user is always part of the scan filter.
    """
    out = history.filter(
        _since(as_of, hours)
        & (F.col("total_duration_ms") >= min_duration_ms)
        & (F.col("execution_status") == "FINISHED")
    )
    if users and len(users) == 1:
        out = out.filter(F.col("executed_by") == users[0])
    if limit is not None and limit_first:
        out = _top(out, limit, F.desc("total_duration_ms"))
    if users and len(users) > 1:
        out = out.filter(F.col("executed_by").isin(*users))
    if min_cost_usd is not None:
        out = out.filter(F.coalesce(task_cost(F.col("total_task_duration_ms")), F.lit(0.0)) >= min_cost_usd)
    if limit is not None and not limit_first:
        out = _top(out, limit, F.desc("total_duration_ms"))
    return out


def finished_flag(history: DataFrame) -> DataFrame:
    """Every statement, with a flag and a note for those that did not finish."""
    done = F.col("execution_status") == "FINISHED"
    return history.withColumn("is_finished", done).withColumn(
        "status_note",
        F.when(~done, F.concat(F.lit("statement status is "), F.col("execution_status"))),
    )
