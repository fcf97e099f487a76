"""Command line: `python -m tidemark <command> --root <folder> ...`.

`--master` is for local runs; on a cluster the launcher names the master.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import datasets, reporting
from tidemark.plans.ingest import ingest_listed
from tidemark.plans.merge import merge_all, seed_principal
from tidemark.plans.store import Store
from tidemark.session import build_session
from tidemark.sources import files
from tidemark.sources.notifications import notified_files
from tidemark.streaming import queries as streams


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--master", help="Spark master for local runs, e.g. local[8]")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        sub.add_argument("--root", required=True, help="folder of the tables")
        return sub

    ingest = command("ingest", "land Parquet files in staging")
    ingest.add_argument("--input", help="folder with Parquet files")
    ingest.add_argument("--notifications", help="text files, one notification per line")
    ingest.add_argument("--max-attempts", type=int, default=3)
    ingest.add_argument("--hash-text", choices=["decimal", "repr"], default="decimal")

    follow = command("follow", "land new files as they arrive")
    follow.add_argument("--input", required=True)
    follow.add_argument("--checkpoint", required=True)
    follow.add_argument("--every", help="interval, e.g. '5 seconds'; without it: drain and stop")
    follow.add_argument("--max-files", type=int, default=100_000, help="files per micro-batch")
    follow.add_argument("--max-bytes", help="bytes per micro-batch, e.g. 500g")
    follow.add_argument("--hash-text", choices=["decimal", "repr"], default="decimal")

    merge = command("merge", "merge staging into the principal table")
    merge.add_argument("--continuous", action="store_true", help="keep merging new ingest runs")
    merge.add_argument("--checkpoint", help="needed for --continuous")
    merge.add_argument("--delay", type=float, default=0.5, help="seconds between merges")
    merge.add_argument("--max-runs", type=int, help="ingest runs per merge of --continuous")
    merge.add_argument("--batch-size", type=int, help="staged rows per merge; all without it")
    merge.add_argument("--max-iterations", type=int, default=0, help="stop after so many merges")
    merge.add_argument("--metrics-csv", help="folder for the metrics as CSV")

    seed = command("seed", "replace the principal table by unique random records")
    seed.add_argument("--records", type=int, default=100_000)

    generate = command("generate", "write input files")
    generate.add_argument("--files", type=int, default=10)
    generate.add_argument("--records-per-file", type=int, default=5000)
    generate.add_argument("--days", type=int, default=30)
    generate.add_argument("--output", required=True)
    generate.add_argument("--control", help="folder for the control CSV")
    generate.add_argument("--unique", action="store_true", help="no key twice in all files")

    changes = command("changes", "write a change set against the principal table as input files")
    changes.add_argument("--ingestion-size", type=int, default=10_000)
    changes.add_argument("--update-ratio", type=int, default=60)
    changes.add_argument("--records-per-file", type=int, default=5000)
    changes.add_argument("--seed", type=int, help="default: another one for every snapshot")
    changes.add_argument("--output", required=True)

    report = command("report", "print the totals of all merges")
    report.add_argument("--metrics-csv", help="read the metrics from CSV instead")

    command("status", "print table counts, ingest runs and merge runs")

    command("purge", "delete consumed staging rows and replaced versions")
    return top


def _today() -> str:
    return f"date'{dt.date.today().isoformat()}'"


def _ingest(spark, store, args) -> None:
    if bool(args.input) == bool(args.notifications):
        raise SystemExit("give either --input or --notifications")
    if args.input:
        listed = files.listed_files(spark, args.input).select(F.col("source_file").alias("path"), "file_time")
    else:
        messages = spark.read.text(args.notifications).withColumnRenamed("value", "body")
        listed = notified_files(messages).select(F.col("source_file").alias("path"))
    batch = ingest_listed(store, listed, args.max_attempts, hash_text=args.hash_text)
    if batch is None:
        print("nothing to land")
    else:
        store.commits().filter(F.col("ingest_batch") == batch).show(truncate=False)


def _follow(spark, store, args) -> None:
    streams.ingest_stream(
        store, args.input, args.checkpoint, args.every, args.max_files, args.max_bytes, hash_text=args.hash_text
    ).awaitTermination()


def _merge(spark, store, args) -> None:
    before = store.last_snapshot()
    if args.continuous:
        if not args.checkpoint:
            raise SystemExit("--continuous needs --checkpoint")
        query = streams.merge_stream(store, args.checkpoint, f"{args.delay} seconds", args.max_runs, args.batch_size)
        if args.max_iterations:
            streams.await_batches(query, args.max_iterations, timeout=float("inf"))
        else:
            query.awaitTermination()
    else:
        merged = merge_all(store, max_rows=args.batch_size)
        print(*merged or ["staging is empty"], sep="\n")
    if args.metrics_csv:
        files.write_metrics_csv(store.metrics().where(F.col("snapshot") > before), args.metrics_csv)


def _seed(spark, store, args) -> None:
    attempts = spark.range(3 * args.records)
    seed_principal(store, datasets.unique_records(attempts, "id", args.records, _today()))
    print(store.counts())


def _generate(spark, store, args) -> None:
    if args.unique:
        records = datasets.allocated_records(
            spark, args.files, args.records_per_file, _today(), days_back=args.days
        )
    else:
        rows = spark.range(args.files * args.records_per_file)
        records = datasets.allocate_files(
            datasets.random_records(rows, "id", _today(), days_back=args.days).withColumnRenamed("id", "position"),
            args.records_per_file,
        )
    stamped = records.withColumn("reference_date", F.col("reference_date").cast("timestamp_ntz"))
    files.write_allocated(stamped, args.output)
    if args.control:
        files.write_control_csv(
            records.withColumn("source_file", F.concat(F.lit("file_number="), "file_number")), args.control
        )


def _changes(spark, store, args) -> None:
    seed = store.last_snapshot() + 1 if args.seed is None else args.seed
    attempts = spark.range(10 * args.ingestion_size)
    candidates = datasets.random_records(attempts, "id", _today(), seed=seed)
    made = datasets.change_set(
        store.principal(), candidates, args.ingestion_size, args.update_ratio, seed=seed
    )
    stamped = made.withColumn("reference_date", F.col("reference_date").cast("timestamp_ntz"))
    files.write_records(stamped, args.output, args.records_per_file)


def _report(spark, store, args) -> None:
    metrics = files.read_metrics_csv(spark, args.metrics_csv) if args.metrics_csv else store.metrics()
    reporting.report_lines(reporting.report_metrics(metrics)).show(truncate=False)
    reporting.series_means(reporting.batch_series(metrics)).show(truncate=False)


def _status(spark, store, args) -> None:
    print(store.counts())
    store.commits().orderBy(F.desc("ingest_batch")).show(10, truncate=False)
    store.metrics().orderBy(F.desc("snapshot")).show(10, truncate=False)
    store.attempts().show(10, truncate=False)


def _purge(spark, store, args) -> None:
    print("ingest runs:", store.purge_consumed())
    print("versions:", store.purge_versions())


COMMANDS = {
    "ingest": _ingest,
    "follow": _follow,
    "merge": _merge,
    "seed": _seed,
    "generate": _generate,
    "changes": _changes,
    "report": _report,
    "status": _status,
    "purge": _purge,
}


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    COMMANDS[args.command](spark, Store(spark, args.root), args)


def main() -> None:
    args = parser().parse_args()
    spark = build_session(master=args.master)
    try:
        run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
