"""The keyed merge: collapse, compare, apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEY, VALUES

INSERTED, UPDATED, UNCHANGED, SUPERSEDED = "inserted", "updated", "unchanged", "superseded"


def differs(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe `IS DISTINCT FROM` over pairs of columns."""
    result = F.lit(False)
    for a, b in zip(left, right, strict=True):
        result = result | ~a.eqNullSafe(b)
    return result


def collapse(
    staged: DataFrame, key: list[str] = KEY, values: list[str] = VALUES, order: str = "seq"
) -> DataFrame:
    """One row per key: last values, first `created_at`, number of versions.

    All aggregates are over plain numbers, so this is one hash aggregate with
    map-side combine; a hot key costs one row per map task.
    """
    extra = [F.min_by("created_at", order).alias("created_at")] if "created_at" in staged.columns else []
    return staged.groupBy(*key).agg(
        *[F.max_by(v, order).alias(v) for v in values],
        *extra,
        F.count(F.lit(1)).alias("versions"),
    )


def _staged_names(values: list[str]) -> dict[str, str]:
    return {v: f"_staged_{v}" for v in values}


def inserted_rows(collapsed: DataFrame, target: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Collapsed rows whose key is not in the target."""
    return collapsed.join(target.select(*key), key, "left_anti")


def matched_rows(
    collapsed: DataFrame, target: DataFrame, key: list[str] = KEY, values: list[str] = VALUES
) -> DataFrame:
    """Target rows with the staged values beside them as `_staged_*`, and `changed`.

    An inner join: Spark may broadcast the smaller side whichever it is.
    """
    names = _staged_names(values)
    staged = collapsed.select(
        *key, *[F.col(v).alias(n) for v, n in names.items()], F.col("versions")
    )
    return target.join(staged, key).withColumn(
        "changed", differs([F.col(v) for v in values], [F.col(n) for n in names.values()])
    )


def updated_rows(
    collapsed: DataFrame,
    target: DataFrame,
    run_ts: Column | None = None,
    key: list[str] = KEY,
    values: list[str] = VALUES,
) -> DataFrame:
    """Target rows that change, with their new values (and `updated_at`)."""
    changed = matched_rows(collapsed, target, key, values).filter("changed")
    return changed.select(
        *key,
        *[F.col(n).alias(v) for v, n in _staged_names(values).items()],
        *_stamps(target, run_ts),
    )


def _stamps(target: DataFrame, run_ts: Column | None) -> list[Column]:
    stamps = []
    if "updated_at" in target.columns and run_ts is not None:
        stamps.append(run_ts.alias("updated_at"))
    if "created_at" in target.columns:
        stamps.append(F.col("created_at"))
    return stamps


def merge_actions(
    collapsed: DataFrame,
    target: DataFrame,
    key: list[str] = KEY,
    values: list[str] = VALUES,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Per staged key: `action`, and `superseded`, its older staged versions.

    Columns named in `carried` come from the target as `_target_*`; null for new keys.
    """
    names = {v: f"_target_{v}" for v in values}
    extra = [f"_target_{c}" for c in carried]
    current = target.select(
        *key,
        *[F.col(v).alias(n) for v, n in names.items()],
        *[F.col(c).alias(n) for c, n in zip(carried, extra, strict=True)],
        F.lit(True).alias("_present"),
    )
    changed = differs([F.col(v) for v in values], [F.col(n) for n in names.values()])
    return collapsed.join(current, key, "left").select(
        *collapsed.columns,
        *extra,
        F.when(F.col("_present").isNull(), F.lit(INSERTED))
        .when(changed, F.lit(UPDATED))
        .otherwise(F.lit(UNCHANGED))
        .alias("action"),
        (F.col("versions") - 1).alias("superseded"),
    )


def merge_summary(actions: DataFrame) -> DataFrame:
    """inserted + updated + unchanged + superseded = staged, in one row."""
    return actions.agg(
        F.count_if(F.col("action") == INSERTED).alias("inserted"),
        F.count_if(F.col("action") == UPDATED).alias("updated"),
        F.count_if(F.col("action") == UNCHANGED).alias("unchanged"),
        F.coalesce(F.sum("superseded"), F.lit(0)).cast("long").alias("superseded"),
        F.coalesce(F.sum("versions"), F.lit(0)).cast("long").alias("staged"),
    )


def merge_result(
    collapsed: DataFrame,
    target: DataFrame,
    run_ts: Column,
    key: list[str] = KEY,
    values: list[str] = VALUES,
) -> DataFrame:
    """The whole target after the merge.

    Both sides have one row per key, so the full join has no hot key. The
    collapse already partitions its output by key and is not shuffled again.
    """
    names = _staged_names(values)
    staged = collapsed.select(
        *key,
        *[F.col(v).alias(n) for v, n in names.items()],
        F.col("created_at").alias("_staged_created"),
        F.lit(True).alias("_staged"),
    )
    current = target.withColumn("_present", F.lit(True))
    new = F.col("_present").isNull()
    changed = F.col("_staged").isNotNull() & (
        new | differs([F.col(v) for v in values], [F.col(n) for n in names.values()])
    )
    return current.join(staged, key, "full").select(
        *key,
        *[F.when(changed, F.col(n)).otherwise(F.col(v)).alias(v) for v, n in names.items()],
        F.when(changed, run_ts).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(new, F.col("_staged_created")).otherwise(F.col("created_at")).alias("created_at"),
    )


def merge_into_table(collapsed: DataFrame, table: str, run_ts: Column) -> None:
    """The same merge on a catalog table that supports row-level operations."""
    staged = collapsed.alias("s")
    same_key = F.lit(True)
    for k in KEY:
        same_key = same_key & (F.col(f"{table}.{k}") == F.col(f"s.{k}"))
    changed = differs([F.col(f"{table}.{v}") for v in VALUES], [F.col(f"s.{v}") for v in VALUES])
    values = {v: F.col(f"s.{v}") for v in VALUES}
    (
        staged.mergeInto(table, same_key)
        .whenMatched(changed)
        .update({**values, "updated_at": run_ts})
        .whenNotMatched()
        .insert(
            {
                **{k: F.col(f"s.{k}") for k in KEY},
                **values,
                "updated_at": run_ts,
                "created_at": F.col("s.created_at"),
            }
        )
        .merge()
    )
