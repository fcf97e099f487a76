"""Batch history: what each logical batch of n staged rows did to the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import batch_count, int_div, percent
from tidemark.operators.merging import INSERTED, UNCHANGED, UPDATED, differs
from tidemark.operators.ordering import running_sums, with_batches
from tidemark.schemas import KEY, VALUES

# Versions of one key are compared in spans of this many batches.
SPAN = 4096


def version_actions(
    staged: DataFrame,
    target: DataFrame,
    batch_size: int,
    order: str = "seq",
    key: list[str] = KEY,
    values: list[str] = VALUES,
) -> DataFrame:
    """One row per (key, batch) with the action of that batch on that key.

    The target is version 0 of its keys. A state is the versions of one key in one
    span of SPAN batches, in order; states of a key merge by their first and last
    version alone. So every version is compared with the one before it inside its
    state, and only the first of a later span needs the key's other spans, which
    are one small row each. A key present in every batch has one state per span.
    """
    version = lambda rows: F.struct("batch", *values, F.col(rows).alias("rows"))
    staged_versions = (
        with_batches(staged, order, batch_size)
        .groupBy(*key, "batch")
        .agg(*[F.max_by(v, order).alias(v) for v in values], F.count(F.lit(1)).alias("rows"))
    )
    before = target.select(*key, F.lit(0).cast("long").alias("batch"), *values, F.lit(0).cast("long").alias("rows"))
    states = (
        staged_versions.unionByName(before)
        .groupBy(*key, int_div(F.col("batch"), SPAN).alias("_span"))
        .agg(F.array_sort(F.collect_list(version("rows"))).alias("_versions"))
    )

    def action(new: Column, old: Column) -> Column:
        changed = differs([new[v] for v in values], [old[v] for v in values])
        return F.when(old.isNull(), F.lit(INSERTED)).when(changed, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED))

    def compared(versions: Column, first: Column) -> Column:
        """The versions with their action; `first` is what the first one is compared with."""
        return F.transform(
            versions,
            lambda x, i: F.struct(
                x.alias("version"), action(x, F.when(i == 0, first).otherwise(F.get(versions, i - 1))).alias("action")
            ),
        )

    none = F.lit(None).cast(states.schema["_versions"].dataType.elementType)
    # The first span of a key starts from nothing or from version 0; of later ones all but the first version is known here.
    known = states.select(*key, "_span", F.explode(compared(F.col("_versions"), none)).alias("_x"), F.get("_versions", F.lit(0)).alias("_first"))
    inside = known.where("_span = 0 or _x.version.batch <> _first.batch")
    ends = states.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("_span", F.get("_versions", F.lit(0)).alias("first"), F.element_at("_versions", -1).alias("last"))
            )
        ).alias("_spans")
    )
    heads = ends.where(F.element_at("_spans", -1)["_span"] > 0).select(
        *key,
        F.explode(
            F.transform(
                "_spans",
                lambda x, i: F.struct(
                    x["_span"].alias("span"),
                    x["first"].alias("version"),
                    action(x["first"], F.get("_spans", i - 1)["last"]).alias("action"),
                ),
            )
        ).alias("_x"),
    )
    rows = inside.select(*key, "_x.version", "_x.action").unionByName(
        heads.where("_x.span > 0").select(*key, "_x.version", "_x.action")
    )
    return rows.where("version.batch > 0").select(
        *key, "version.batch", *[F.col("version")[v].alias(v) for v in values], "version.rows", "action"
    )


def batch_metrics(actions: DataFrame) -> DataFrame:
    """Per batch: rows, inserted, updated and the running totals."""
    per_batch = actions.groupBy("batch").agg(
        F.count_if(F.col("action") == INSERTED).alias("inserted"),
        F.count_if(F.col("action") == UPDATED).alias("updated"),
        F.sum("rows").alias("rows"),
    )
    return running_sums(
        per_batch,
        "batch",
        {
            "total_inserted": F.col("inserted"),
            "total_updated": F.col("updated"),
            "total_processed": F.col("inserted") + F.col("updated"),
            "total_rows": F.col("rows"),
        },
    )


def batch_progress(per_batch: DataFrame, pending: DataFrame, batch_size: int) -> DataFrame:
    """Percent done and number of batches; `pending` is one row with `rows`."""
    whole = pending.select("rows").scalar()
    return per_batch.select(
        *per_batch.columns,
        percent(F.col("total_rows"), whole).alias("percent_done"),
        batch_count(whole, batch_size).alias("batches"),
    )
