"""Numbers of the run report, computed from batch metrics and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import percent, safe_div, share_rounded

# Names and text patterns of the report lines.
REPORT_LINES = {
    "total_records": "%,d",
    "total_time": "%.1fs",
    "throughput": "%.1f regs/s",
    "total_inserted": "%,d",
    "total_updated": "%,d",
    "total_batches": "%,d",
}


def report_metrics(metrics: DataFrame) -> DataFrame:
    """All report totals in one aggregation: one row."""
    zero = F.lit(0).cast("long")
    totals = metrics.agg(
        F.coalesce(F.sum("inserted"), zero).alias("total_inserted"),
        F.coalesce(F.sum("updated"), zero).alias("total_updated"),
        F.coalesce(F.max("timestamp"), F.lit(0.0)).alias("total_time"),
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.max_by("total_processed", "batch"), zero).alias("last_total_processed"),
        F.coalesce(F.avg("batch_time_ms"), F.lit(0.0)).alias("mean_batch_time_ms"),
    )
    return totals.withColumn(
        "total_records", F.col("total_inserted") + F.col("total_updated")
    ).withColumn("throughput", safe_div(F.col("total_records"), F.col("total_time")))


def report_lines(report: DataFrame) -> DataFrame:
    """The totals as `(metric, value, text)` rows, formatted for reading."""
    lines = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
            F.format_string(pattern, F.col(name).cast("long" if "d" in pattern else "double")).alias("text"),
        )
        for name, pattern in REPORT_LINES.items()
    ]
    return report.select(F.inline(F.array(*lines)))


def batch_series(metrics: DataFrame) -> DataFrame:
    """Per batch: throughput from its own time, 0 where the time is 0."""
    return metrics.select(
        "batch",
        "inserted",
        "updated",
        "batch_time_ms",
        safe_div(F.col("inserted") + F.col("updated"), F.col("batch_time_ms") / 1000.0).alias(
            "throughput"
        ),
    )


def series_means(series: DataFrame) -> DataFrame:
    """Unweighted means over batches, 0 without batches."""
    return series.agg(
        F.coalesce(F.avg("throughput"), F.lit(0.0)).alias("mean_throughput"),
        F.coalesce(F.avg("batch_time_ms"), F.lit(0.0)).alias("mean_batch_time_ms"),
    )


def error_ratio(counters: DataFrame) -> DataFrame:
    """Rejected rows in percent of the rows read, and the valid share."""
    total = counters.agg(
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"),
    )
    return total.select(
        "valid",
        "invalid",
        percent(F.col("invalid"), F.col("valid") + F.col("invalid")).alias("error_percent"),
        share_rounded(F.col("valid"), F.col("invalid")).alias("valid_percent"),
    )


def reconciliation(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts that must fit together, one column per table.

    `existing` and `principal` must be among the names; the counts are stacked
    and turned into columns, not joined.
    """
    stacked = None
    for name, rows in counts.items():
        one = row_count(rows).withColumn("_table", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.agg(
        *[F.max(F.when(F.col("_table") == name, F.col("rows"))).alias(name) for name in counts]
    ).withColumn("inserted_new", F.col("principal") - F.col("existing"))


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"))


def elapsed(metrics: DataFrame, ts: str, run: str) -> DataFrame:
    """Seconds since the first row of the run; the start is one value per run."""
    starts = metrics.groupBy(run).agg(F.min(ts).alias("_start"))
    return metrics.join(starts, run).select(
        *metrics.columns,
        (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp")))
        .cast("double")
        .__truediv__(F.lit(1e6))
        .alias("elapsed"),
    )


def last_values(metrics: DataFrame, columns: list[str], order: str = "batch") -> DataFrame:
    """The columns of the last batch in one row, 0 without batches."""
    return metrics.agg(
        *[F.coalesce(F.max_by(c, order), F.lit(0).cast(metrics.schema[c].dataType)).alias(c) for c in columns]
    )


def await_conditions(
    snapshots: DataFrame,
    order: str = "elapsed",
    run: str = "run_id",
    arrive: int = 120,
    settle: int = 30,
    give_up: int = 600,
    limit: int = 12,
) -> DataFrame:
    """Per run: when data arrived and how the monitor ended, from its snapshots.

    `arrived` is the first time before `arrive` with rows in staging, else null. The
    monitor ends at the first snapshot before `give_up` with an empty staging table later
    than `settle` (merged) or with `limit` equal counts in a row (stuck), else as timeout.
    """
    before = F.col(order) < give_up
    merged = before & (F.col("staging") == 0) & (F.col(order) > settle)
    stuck = before & F.col("is_stuck")
    ended = (
        stagnation(snapshots, order, run, limit)
        .groupBy(run)
        .agg(
            F.min(F.when((F.col(order) < arrive) & (F.col("staging") > 0), F.col(order))).alias("arrived"),
            F.min(F.when(merged | stuck, F.struct(order, merged.alias("merged")))).alias("_end"),
        )
    )
    return ended.select(
        run,
        "arrived",
        F.col("_end")[order].alias("ended"),
        F.when(F.col("_end").isNull(), F.lit("timeout"))
        .when(F.col("_end.merged"), F.lit("merged"))
        .otherwise(F.lit("stuck"))
        .alias("outcome"),
    )


def stagnation(
    snapshots: DataFrame, order: str = "elapsed", run: str = "run_id", limit: int = 12
) -> DataFrame:
    """Adds `stagnant`, the number of successive snapshots with the same non-zero
    staging count, and `is_stuck` from `limit` on.

    The window is one run of the monitor, one small row per interval.
    """
    by_time = Window.partitionBy(run).orderBy(order)
    same = (F.col("staging") == F.lag("staging").over(by_time)) & (F.col("staging") != 0)
    marked = snapshots.withColumn("_restart", F.when(same, 0).otherwise(1))
    streaks = marked.withColumn(
        "_streak", F.sum("_restart").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = Window.partitionBy(run, "_streak").orderBy(order)
    return (
        streaks.withColumn("stagnant", (F.row_number().over(inside) - 1).cast("long"))
        .withColumn("is_stuck", F.col("stagnant") >= limit)
        .drop("_restart", "_streak")
    )
