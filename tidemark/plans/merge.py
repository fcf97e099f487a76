"""One merge run: pending staged rows into the principal table."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merging
from tidemark.operators.ordering import nth_value
from tidemark.plans.store import CODEC, METRICS_FILES, SNAPSHOTS, Head, Store
from tidemark.schemas import KEY, PRINCIPAL, VALUES

# A date is written anew instead of getting one more folder beyond this many.
MAX_VERSIONS = 8
# Staged keys are broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = "length(account_id) + length(asset_id) + 64"


@dataclass(frozen=True)
class MergeCounts:
    snapshot: int
    inserted: int
    updated: int
    unchanged: int
    superseded: int

    @property
    def staged(self) -> int:
        return self.inserted + self.updated + self.unchanged + self.superseded


def merge_pending(
    store: Store,
    run_ts: dt.datetime | None = None,
    up_to: int | None = None,
    max_rows: int | None = None,
) -> MergeCounts | None:
    """Merges what complete ingest runs have staged and no merge has taken (up to run `up_to`).

    With `max_rows`, the first so many staged rows in the order of `seq`, exactly;
    the next call goes on behind them. Returns None if there is nothing to do.
    """
    if max_rows is not None and max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    spark = store.spark
    started = time.time()
    run_ts = run_ts or dt.datetime.now()
    head = store.head()
    last_commit = store.last_commit()
    last = last_commit if up_to is None else min(up_to, last_commit)
    if last <= head.last_ingest_batch:
        return None
    snapshot = head.snapshot + 1
    stamp = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")

    # 1. What is staged, and one row per key of it. Few keys are written: the join below
    #    sees their real size. Many go from the aggregate into the join, which needs no
    #    other distribution: they are shuffled once.
    last, below = _batch_end(store, head, last, max_rows)
    pending = store.staged_between(head.last_ingest_batch + 1, last).filter(F.col("seq") >= head.merged_below)
    if below is not None:
        pending = pending.filter(F.col("seq") < below)
    collapsed = merging.collapse(pending)
    staged = pending.groupBy("reference_date").agg(F.sum(F.expr(KEY_BYTES)).alias("bytes")).collect()
    small = sum(r["bytes"] for r in staged) <= BROADCAST_BYTES
    if small:
        collapsed_path = store.path("work", merge=snapshot)
        collapsed.write.mode("overwrite").parquet(collapsed_path)
        collapsed = spark.read.parquet(collapsed_path)

    # 2. One join with the target decides about every key. Only the dates that were
    #    staged are read, and of a small staging's target only its keys are shuffled.
    layout = head.layout
    staged_dates = {r["reference_date"] for r in staged}
    read = [(d, v) for d, v in layout if d in staged_dates]
    target = store.partitions(read)
    if not read:
        target = F.broadcast(target)  # no rows: the staged keys need not be shuffled or sorted
    elif small:
        target = target.join(F.broadcast(collapsed.select(*KEY)), KEY, "left_semi")
    _decided(collapsed, target, stamp).write.mode("overwrite").option("compression", CODEC).partitionBy("action").parquet(
        store.path("changes", snapshot=snapshot)
    )
    changes = store.changes_of(snapshot)

    # 3. New folders: dates with updates are rewritten, dates with inserts only
    #    get a folder more.
    per_date = changes.groupBy("reference_date").agg(
        *[
            F.count_if(F.col("action") == a).alias(a)
            for a in (merging.INSERTED, merging.UPDATED, merging.UNCHANGED)
        ],
        F.sum("superseded").alias(merging.SUPERSEDED),
    ).collect()
    folders: dict[object, int] = {}
    for date, _ in layout:
        folders[date] = folders.get(date, 0) + 1
    rewritten = {
        r["reference_date"]
        for r in per_date
        if r["updated"] or (r["inserted"] and folders.get(r["reference_date"], 0) >= MAX_VERSIONS)
    }
    extended = {r["reference_date"] for r in per_date if r["inserted"]} - rewritten
    if rewritten or extended:
        _write_version(store, changes, layout, rewritten, snapshot)

    # 4. The new snapshot, one file, makes everything visible.
    entries = [(d, v) for d, v in layout if d not in rewritten]
    entries += [(d, snapshot) for d in rewritten | extended]
    counts = MergeCounts(
        snapshot,
        *[
            sum(r[a] for r in per_date)
            for a in (merging.INSERTED, merging.UPDATED, merging.UNCHANGED, merging.SUPERSEDED)
        ],
    )
    seconds = time.time() - started
    after = Head(
        snapshot=snapshot,
        last_ingest_batch=last if below is None else last - 1,
        merged_rows=head.merged_rows + counts.staged,
        merged_below=below or 0,
        table_rows=head.table_rows + counts.inserted,
        total_processed=head.total_processed + counts.inserted + counts.updated,
        total_seconds=head.total_seconds + seconds,
        layout=tuple(sorted(entries)),
    )
    _write_metrics(store, counts, after, seconds)
    _write_snapshot(store, after)
    return counts


def merge_all(
    store: Store,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
    up_to: int | None = None,
    max_rows: int | None = None,
) -> list[MergeCounts]:
    """Merges until nothing is pending (up to run `up_to`), at most `max_rows` staged rows at a time."""
    done = []
    while (counts := merge_pending(store, clock(), up_to, max_rows)) is not None:
        done.append(counts)
    return done


def _batch_end(store: Store, head: Head, last: int, max_rows: int | None) -> tuple[int, int | None]:
    """The last run of a merge, and the `seq` before which it ends there (None: after the run)."""
    if max_rows is None:
        return last, None
    runs = store.commits().filter(F.col("ingest_batch").between(head.last_ingest_batch + 1, last))
    run = runs.filter(F.col("total_valid") > head.merged_rows + max_rows).agg(F.min("ingest_batch")).first()[0]
    if run is None:
        return last, None
    # Rows of earlier runs come first; `left` rows of this one follow.
    taken = max(store.commit(run - 1)["total_valid"], head.merged_rows)
    left = max_rows - (taken - head.merged_rows)
    if not left:
        return run - 1, None
    rows = store.staged_between(run, run).filter(F.col("seq") >= head.merged_below)
    return run, nth_value(rows, "seq", left).first()["seq"] + 1


def _decided(collapsed: DataFrame, target: DataFrame, stamp) -> DataFrame:
    """Per staged key the row that the table has after the merge, and the action.

    A new key takes `created_at` from staging, others keep theirs; `updated_at`
    moves with the values only.
    """
    actions = merging.merge_actions(collapsed, target, carried=("updated_at", "created_at"))
    new, same = F.col("action") == merging.INSERTED, F.col("action") == merging.UNCHANGED
    return actions.select(
        *KEY,
        *VALUES,
        F.when(same, F.col("_target_updated_at")).otherwise(stamp).alias("updated_at"),
        F.when(new, F.col("created_at")).otherwise(F.col("_target_created_at")).alias("created_at"),
        "superseded",
        "action",
    )


def _write_version(store: Store, changes: DataFrame, layout, rewritten, snapshot: int) -> None:
    """Changed and new rows, and for rewritten dates the rows that stay as well.

    Rows that stay keep the layout of the files they come from. Changed rows
    are rebalanced by date: small dates share a task, a large one gets several.
    """
    applied = changes.filter(F.col("action").isin(merging.INSERTED, merging.UPDATED))
    path = store.path("principal", version=snapshot)
    new = applied.select(*PRINCIPAL.names).hint("rebalance", "reference_date")
    stay = store.partitions([(d, v) for d, v in layout if d in rewritten]).join(
        changes.filter(F.col("action") == merging.UPDATED).select(*KEY), KEY, "left_anti"
    )
    rows = new.unionByName(stay) if rewritten else new
    rows.write.mode("overwrite").option("compression", CODEC).partitionBy("reference_date").parquet(path)


def _write_snapshot(store: Store, head: Head) -> None:
    shared = (
        head.last_ingest_batch,
        head.table_rows,
        head.total_processed,
        head.total_seconds,
        head.merged_rows,
        head.merged_below,
    )
    rows = [(d, v, *shared) for d, v in head.layout] or [(None, None, *shared)]
    store.spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("overwrite").parquet(
        store.path("snapshots", snapshot=head.snapshot)
    )


def _write_metrics(store: Store, counts: MergeCounts, after: Head, seconds: float) -> None:
    row = {
        "timestamp": after.total_seconds,
        "batch": counts.snapshot,
        "batch_time_ms": seconds * 1000.0,
        "inserted": counts.inserted,
        "updated": counts.updated,
        "total_processed": after.total_processed,
        "unchanged": counts.unchanged,
        "superseded": counts.superseded,
    }
    types = {f.name: f.dataType for f in METRICS_FILES}
    store.spark.range(1).coalesce(1).select(
        *[F.lit(value).cast(types[name]).alias(name) for name, value in row.items()]
    ).write.mode("overwrite").parquet(store.path("metrics", snapshot=counts.snapshot))


def seed_principal(store: Store, records: DataFrame, run_ts: dt.datetime | None = None) -> None:
    """Replaces the principal table by the given records (truncate and load).

    Of several records with one key the greatest by its values stays. Consumed
    ingest runs stay consumed; pending ones stay pending.
    """
    run_ts = run_ts or dt.datetime.now()
    stamp = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    head = store.head()
    snapshot = head.snapshot + 1
    path = store.path("principal", version=snapshot)
    rows = records
    for name in ("updated_at", "created_at"):
        if name not in rows.columns:
            rows = rows.withColumn(name, stamp)
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRINCIPAL])
    others = [name for name in PRINCIPAL.names if name not in KEY]
    shaped = (
        shaped.groupBy(*KEY).agg(F.max(F.struct(*others)).alias("kept")).select(*KEY, "kept.*").select(*PRINCIPAL.names)
    )
    shaped.hint("rebalance", "reference_date").write.mode("overwrite").option("compression", CODEC).partitionBy(
        "reference_date"
    ).parquet(path)
    written = store.spark.read.schema("reference_date date").parquet(path)
    per_date = written.groupBy("reference_date").agg(F.count(F.lit(1)).alias("n")).collect()
    _write_snapshot(
        store,
        replace(
            head,
            snapshot=snapshot,
            table_rows=sum(r["n"] for r in per_date),
            layout=tuple(sorted((r["reference_date"], snapshot) for r in per_date)),
        ),
    )
