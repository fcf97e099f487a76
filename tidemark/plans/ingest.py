"""One ingest run: files to staged and rejected rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from tidemark.functions.rules import DEFAULT_RULES, Rule
from tidemark.operators.appending import bucket_of, file_lengths, file_states, manifest, not_landed, plain_path, unfinished
from tidemark.operators.dedup import (
    mark_repeats,
    possible_repeats,
    repeated_pieces,
    with_digest_in,
)
from tidemark.operators.routing import (
    DUPLICATE_REASON,
    FIELDS,
    REJECTED,
    STAGED,
    explain,
    flag,
    typed,
)
from tidemark.plans.store import CODEC, COMMITS, RunExists, Store
from tidemark.schemas import STAGING
from tidemark.sources.footers import footers, scan_mixed

# A file list is broadcast up to this many bytes of paths; see `unfinished`.
BROADCAST_BYTES = 64 << 20
# A run takes at most so many files, and files of at most so many sets of column types.
RUN_FILES, RUN_SHAPES = 100_000, 200
# Rows repeat each other if the file has the same values for them; the stored decimals may be coarser.
DUPLICATE_KEY = ["source_file", *FIELDS]


def ingest_files(
    store: Store,
    rows: DataFrame,
    batch_id: str | None = None,
    run_ts: dt.datetime | None = None,
    rules: list[Rule] = DEFAULT_RULES,
    hash_text: str = "decimal",
    check_duplicates: bool = True,
) -> int:
    """Lands the rows of a scan and returns the number of the ingest run.

    `rows` holds the five input columns with `source_file`, `file_time` and
    `row_number`. Rows of a file that an earlier run has landed are left out, so
    a repeated run adds nothing. Raises RunExists if another writer commits a run
    of the same number first; nothing is landed then.
    """
    spark = store.spark
    batch_id = batch_id or str(uuid.uuid4())
    run_ts = run_ts or dt.datetime.now()
    last = store.last_commit()
    before = store.commit(last)
    next_seq = before["next_seq"]
    batch, attempt = last + 1, uuid.uuid4().hex[:12]
    work = {"ingest_batch": batch, "attempt": attempt}

    # 1. The files of this run, written first: the broadcast below may then rely
    #    on their real number, and the data is not needed for it. Of the ledger,
    #    only the buckets of these files are read.
    files_path = store.path("work", **work, step="files")
    file_lengths(rows).write.mode("overwrite").parquet(files_path)
    files = spark.read.parquet(files_path)
    buckets = [r["bucket"] for r in files.select("bucket").distinct().collect()]
    store.write_ledger(manifest(files, store.ledger(buckets), next_seq), batch, attempt)
    listed = store.ledger_of(batch, attempt, buckets).drop("ingest_batch", "attempt")
    size = listed.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.length("source_file") + 64), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.col("file_start") + F.col("file_rows")), F.lit(next_seq)).alias("next_seq"),
    ).first()

    # 2. Repeats inside a file, also of rows that an earlier run took from it when it
    #    was shorter. There are usually none, and then the large pass below has no
    #    shuffle at all.
    checked = flag(unfinished(rows, listed, small=size["bytes"] <= BROADCAST_BYTES), rules, hash_text)
    repeats = _repeats(store, checked, work) if check_duplicates else None
    if repeats is None:
        marked = not_landed(checked).withColumn("is_repeat", F.lit(False))
    else:
        marked = mark_repeats(not_landed(checked), repeats, DUPLICATE_KEY, "row_number")

    # 3. One pass over the data lands good and bad rows together and counts them.
    #    The write has no shuffle behind it, so every task counts once.
    landed_path = store.path("landed", **work)
    counted = Observation(f"landed {batch} {attempt}")
    staged = F.col("outcome") == STAGED
    repeated = ~staged & (F.col("error_reason") == DUPLICATE_REASON)
    _landed(marked, rules, batch_id, run_ts).observe(
        counted,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(staged).alias("valid"),
        F.count_if(repeated).alias("duplicate"),
    ).write.mode("overwrite").option("compression", CODEC).partitionBy("outcome").parquet(landed_path)

    # 4. The counters, in one row: the commit.
    row = _commit_row(store, counted.get, batch_id, size, before).withColumn("attempt", F.lit(attempt))
    commit_path = store.path("work", **work, step="commit")
    row.coalesce(1).write.mode("overwrite").partitionBy("attempt").parquet(commit_path)
    try:
        store.publish(commit_path, batch)
    except RunExists:
        store.give_up(batch, attempt)
        raise
    return batch


NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def ingest_listed(
    store: Store,
    listed: DataFrame,
    max_attempts: int = 3,
    run_ts: dt.datetime | None = None,
    **options,
) -> int | None:
    """Lands the readable files of a list (column `path`), except those given up.

    A pass over the footers comes first, and its result is a table. Files that are
    missing or unreadable are all noted and tried again with the next list; after
    `max_attempts` failures they are left out. The others are read with the types
    they have. With a column `file_time`, files that the ledger has with that time
    are not opened.

    The files are landed in the order of their times and names, by runs of at most
    `RUN_FILES` files and `RUN_SHAPES` sets of column types; the names of about one
    run are on the driver, which needs them to plan the scan. Returns the number of
    the last run, or None.
    """
    spark, run_ts = store.spark, run_ts or dt.datetime.now()
    states = file_states(store.attempts(), max_attempts)
    tried = states.select(F.col("source_file").alias("path"), "status")
    names = listed.select("path").distinct()
    if "file_time" in listed.columns:
        buckets = [r[0] for r in listed.select(bucket_of("path")).distinct().collect()]
        landed = store.ledger(buckets).select(plain_path("source_file").alias("path"), "file_time").distinct()
        known = listed.select("path", "file_time", plain_path("path").alias("_plain"))
        same = (known["_plain"] == landed["path"]) & (known["file_time"] == landed["file_time"])
        names = known.join(landed, same, "left_anti").select("path").distinct()
    again = tried.where("status = 'retry'").select("path")
    names = names.unionByName(again).distinct().join(tried.where("status = 'dead'"), "path", "left_anti")
    work = {"list": uuid.uuid4().hex[:12]}
    found_path = store.path("work", **work, step="footers")
    footers(names.repartition(spark.sparkContext.defaultParallelism)).write.parquet(found_path)
    found = spark.read.parquet(found_path)
    good = found.filter("error is null")
    size = found.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad")).first()
    if size["bad"]:
        failed = found.filter("error is not null")
        store.record_attempts(failed.select(F.col("path").alias("source_file"), F.lit(False).alias("ok"), "error"), run_ts)
    batch = None
    before = spark.conf.get(NANOS_AS_LONG)
    spark.conf.set(NANOS_AS_LONG, "true")
    try:
        for shapes in _runs(store, good, size["good"], work):
            batch = ingest_files(store, scan_mixed(spark, shapes), run_ts=run_ts, **options)
    finally:
        spark.conf.set(NANOS_AS_LONG, before)
    recovered = good.join(again, "path", "left_semi").select(F.col("path").alias("source_file"), F.lit(True).alias("ok"), "error")
    if batch is not None and not recovered.isEmpty():
        store.record_attempts(recovered, run_ts)
    return batch


def _runs(store: Store, good: DataFrame, count: int, work: dict) -> Iterator[dict[str, list[str]]]:
    """The files of one run after another, in the order of time and name: per shape its paths.

    A long list is cut into ranges by Spark, each of about one run; one is read at a time.
    """
    order = ["file_time", "path"]
    parts = -(-count // RUN_FILES)
    if parts > 1:
        path = store.path("work", **work, step="ranges")
        ranged = good.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
        ranged.write.partitionBy("part").parquet(path)
        good = store.spark.read.schema("path string, file_time timestamp, shape string, part int").parquet(path)
    for part in range(parts):
        shapes: dict[str, list[str]] = {}
        files = 0
        rows = good.filter(F.col("part") == part) if parts > 1 else good
        for row in rows.select(*order, "shape").orderBy(*order).collect():
            if files == RUN_FILES or (row["shape"] not in shapes and len(shapes) == RUN_SHAPES):
                yield shapes
                shapes, files = {}, 0
            shapes.setdefault(row["shape"], []).append(row["path"])
            files += 1
        if shapes:
            yield shapes


def _repeats(store: Store, checked: DataFrame, work: dict) -> DataFrame | None:
    """Pieces with repeats, or None. Both steps are written, so that the next
    one knows whether its smaller side may be broadcast."""
    good = checked.filter("is_valid").select(*DUPLICATE_KEY, "row_number")
    digests_path = store.path("work", **work, step="digests")
    possible_repeats(good, DUPLICATE_KEY).write.mode("overwrite").parquet(digests_path)
    digests = store.spark.read.parquet(digests_path)
    if digests.isEmpty():
        return None
    narrowed = with_digest_in(good, digests, DUPLICATE_KEY)
    pieces_path = store.path("work", **work, step="pieces")
    repeated_pieces(narrowed, DUPLICATE_KEY, "row_number").write.mode("overwrite").parquet(pieces_path)
    return store.spark.read.parquet(pieces_path)


def _landed(marked: DataFrame, rules: list[Rule], batch_id: str, run_ts: dt.datetime) -> DataFrame:
    explained = explain(marked, rules, rejected="(not is_valid or is_repeat)")
    good = F.col("is_valid") & ~F.col("is_repeat")
    routed = typed(explained).withColumns(
        {
            "outcome": F.when(good, F.lit(STAGED)).otherwise(F.lit(REJECTED)),
            "error_reason": F.when(F.col("is_repeat"), F.lit(DUPLICATE_REASON)).otherwise(
                F.col("error_reason")
            ),
            "batch_id": F.lit(batch_id),
            "created_at": F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz"),
        }
    )
    # A rejected row lives in its payload; its typed columns stay empty.
    kept = {"batch_id", "source_file", "row_number", "created_at", "seq"}
    return routed.select(
        *[
            F.col(name) if name in kept else F.when(good, F.col(name)).alias(name)
            for name in STAGING.names
        ],
        "payload",
        "error_reason",
        "outcome",
    )


def _commit_row(store: Store, counted: dict, batch_id: str, size: Row, before: Row) -> DataFrame:
    rows, valid, duplicate = (counted.get(n) or 0 for n in ("rows", "valid", "duplicate"))
    values = {
        "batch_id": batch_id,
        "files": size["files"],
        "rows": rows,
        "valid": valid,
        "invalid": rows - valid - duplicate,
        "duplicate": duplicate,
        "next_seq": size["next_seq"],
        "total_valid": before["total_valid"] + valid,
        "total_rejected": before["total_rejected"] + rows - valid,
    }
    types = {f.name: f.dataType for f in COMMITS}
    return store.spark.range(1).select(*[F.lit(v).cast(types[n]).alias(n) for n, v in values.items()])
