"""The folders of one deployment and what is visible in them.

    landed/ingest_batch=<n>/attempt=<a>/outcome=<staged|rejected>/   rows of one ingest run
    ledger/bucket=<b>/ingest_batch=<n>/attempt=<a>/      one row per file of the run, by a hash of its name
    commits/ingest_batch=<n>/attempt=<a>/                one row: the run is complete
    changes/snapshot=<r>/action=<inserted|updated|unchanged>/   what merge r decided per key
    principal/version=<r>/reference_date=<d>/            rows written by merge r
    attempts/                                            files that could not be read
    snapshots/snapshot=<r>/                              which versions make up the table
    metrics/snapshot=<r>/                                counters of merge r

A run becomes visible through the last, single-file write (a commit or a
snapshot), so a lost executor or driver leaves no half-visible run. Attempts at
an ingest run have folders of their own, and a commit is written aside and moved
to its place, which fails if there is one: of two writers with one number the
second fails, and only the folders its commit names are read. A repeated merge
overwrites what its failed attempt left behind.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.routing import REJECTED, STAGED

# Of the tables of rows. Hashes in hexadecimal need a codec that codes symbols, too.
CODEC = "zstd"

LANDED = T.StructType(
    schemas.STAGING.fields
    + [f for f in schemas.ERROR.fields if f.name in ("payload", "error_reason")]
    + [
        T.StructField("ingest_batch", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("file_time", T.TimestampType()),
        T.StructField("file_rows", T.LongType()),
        T.StructField("first_new", T.LongType()),
        T.StructField("file_start", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("ingest_batch", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("files", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("valid", T.LongType()),
        T.StructField("invalid", T.LongType()),
        T.StructField("duplicate", T.LongType()),
        T.StructField("next_seq", T.LongType()),
        T.StructField("total_valid", T.LongType()),
        T.StructField("total_rejected", T.LongType()),
        T.StructField("ingest_batch", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)

# One row per partition folder of the table; the other columns say the same in
# every row. An empty table has one row without a date.
SNAPSHOTS = T.StructType(
    [
        T.StructField("reference_date", T.DateType()),
        T.StructField("version", T.LongType()),
        T.StructField("last_ingest_batch", T.LongType()),
        T.StructField("table_rows", T.LongType()),
        T.StructField("total_processed", T.LongType()),
        T.StructField("total_seconds", T.DoubleType()),
        T.StructField("merged_rows", T.LongType()),
        T.StructField("merged_below", T.LongType()),
    ]
)

CHANGES = T.StructType(
    schemas.PRINCIPAL.fields
    + [
        T.StructField("superseded", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("snapshot", T.LongType()),
    ]
)


class RunExists(RuntimeError):
    """Another writer has committed a run of this number."""


@dataclass(frozen=True)
class Head:
    """The current snapshot.

    All staged rows up to run `last_ingest_batch` are merged, and of the run after
    it those with a `seq` under `merged_below`: `merged_rows` staged rows in all.
    """

    snapshot: int = 0
    last_ingest_batch: int = 0
    table_rows: int = 0
    total_processed: int = 0
    total_seconds: float = 0.0
    merged_rows: int = 0
    merged_below: int = 0
    layout: tuple[tuple[dt.date, int], ...] = ()

PRINCIPAL_FILES = T.StructType(
    [f for f in schemas.PRINCIPAL.fields if f.name != "reference_date"]
    + [T.StructField("version", T.LongType()), T.StructField("reference_date", T.DateType())]
)

METRICS_FILES = T.StructType(
    schemas.METRICS.fields
    + [
        T.StructField("unchanged", T.LongType()),
        T.StructField("superseded", T.LongType()),
        T.StructField("snapshot", T.LongType()),
    ]
)


def _staged(landed: DataFrame) -> DataFrame:
    good = landed.filter(F.col("outcome") == STAGED)
    return good.select(*schemas.STAGING.names, "ingest_batch")


ATTEMPTS = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
    ]
)


class Store:
    """Paths and readers below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._newest: dict[str, int] = {}
        self._contents: dict[str, object] = {}

    def path(self, table: str, **partition: object) -> str:
        parts = [f"{name}={value}" for name, value in partition.items()]
        return "/".join([self.root, table, *parts])

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def exists(self, path: str) -> bool:
        fs, hadoop_path = self._hadoop(path)
        return fs.exists(hadoop_path)

    def make(self, path: str) -> None:
        fs, hadoop_path = self._hadoop(path)
        fs.mkdirs(hadoop_path)

    def move(self, path: str, target: str) -> bool:
        """Moves a folder to a new name; False if there is none."""
        fs, hadoop_path = self._hadoop(path)
        if not fs.exists(hadoop_path):
            return False
        if not fs.rename(hadoop_path, self._hadoop(target)[1]):
            raise OSError(f"{path} was not moved to {target}")
        return True

    def drop(self, path: str) -> None:
        fs, hadoop_path = self._hadoop(path)
        fs.delete(hadoop_path, True)

    def drop_all(self, pattern: str) -> list[str]:
        """Deletes what a path pattern matches, in one listing; returns the paths."""
        fs, hadoop_path = self._hadoop(pattern)
        found = [status.getPath() for status in fs.globStatus(hadoop_path) or ()]
        for path in found:
            fs.delete(path, True)
        return [path.toString() for path in found]

    def names(self, folder: str) -> list[str]:
        """Names below a folder."""
        fs, hadoop_path = self._hadoop(folder)
        return [status.getPath().getName() for status in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """A table folder, or an empty frame before its first write."""
        path = self.path(table)
        if not self.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def newest(self, table: str, partition: str) -> int:
        """The highest complete number of a table that is numbered from 1.

        Looks for success markers, doubling the step and then halving it: a few
        file checks however long the history is, and no Spark job.
        """

        def complete(n: int) -> bool:
            return self.exists(f"{self.path(table, **{partition: n})}/_SUCCESS")

        low = self._newest.get(table, 0)
        if low and not complete(low):
            low = 0
            self._contents.clear()
        step = 1
        while complete(low + step):
            low, step = low + step, step * 2
        while step > 1:
            step //= 2
            if complete(low + step):
                low += step
        self._newest[table] = low
        return low

    # ---- ingest side -------------------------------------------------------

    def commits(self) -> DataFrame:
        return self.read("commits", COMMITS)

    def commit(self, batch: int) -> Row:
        """The commit of a complete run; totals of 0 before the first."""
        if not batch:
            return Row(next_seq=0, total_valid=0, total_rejected=0)
        path = self.path("commits", ingest_batch=batch)
        if path not in self._contents:
            self._contents[path] = self.spark.read.schema(COMMITS).parquet(path).first()
        return self._contents[path]

    def last_commit(self) -> int:
        """Number of the last complete ingest run."""
        return self.newest("commits", "ingest_batch")

    def publish(self, written: str, batch: int) -> None:
        """Moves a written commit to its place; raises RunExists if the run has one."""
        jvm = self.spark.sparkContext._jvm
        target = self.path("commits", ingest_batch=batch)
        self.make(self.path("commits"))
        fs, hadoop_path = self._hadoop(target)
        source = fs.makeQualified(self._hadoop(written)[1])
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            context.rename(source, fs.makeQualified(hadoop_path), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName() or self.exists(f"{target}/_SUCCESS"):
                raise RunExists(f"ingest run {batch} was committed by another writer") from None
            raise

    def committed(self) -> DataFrame:
        """(ingest_batch, attempt) of complete runs."""
        return self.commits().filter(F.col("ingest_batch") <= self.last_commit()).select("ingest_batch", "attempt")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """Files of complete runs; of the given buckets only, other folders are not even listed."""
        if buckets is None:
            rows = self.read("ledger", LEDGER)
        else:
            rows = self._ledger_folders([self.path("ledger", bucket=b) for b in buckets])
        return rows.join(self.committed(), ["ingest_batch", "attempt"], "left_semi")

    def ledger_of(self, batch: int, attempt: str, buckets: list[int]) -> DataFrame:
        """The files of one attempt, complete or not."""
        return self._ledger_folders([self.path("ledger", bucket=b, ingest_batch=batch, attempt=attempt) for b in buckets])

    def _ledger_folders(self, paths: list[str]) -> DataFrame:
        paths = [p for p in paths if self.exists(p)]
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).option("basePath", self.path("ledger")).parquet(*paths)

    def write_ledger(self, files: DataFrame, batch: int, attempt: str) -> None:
        numbered = files.withColumns({"ingest_batch": F.lit(batch).cast("long"), "attempt": F.lit(attempt)})
        numbered.write.mode("append").partitionBy("bucket", "ingest_batch", "attempt").parquet(self.path("ledger"))

    def give_up(self, batch: int, attempt: str) -> None:
        """Deletes what an attempt has landed."""
        self.drop(self.path("landed", ingest_batch=batch, attempt=attempt))
        self.drop_all(f"{self.path('ledger')}/bucket=*/ingest_batch={batch}/attempt={attempt}")

    def _landed_folders(self, first: int, last: int) -> list[str]:
        """Folders of the committed attempts."""
        found = []
        for n in range(first, last + 1):
            for name in self.names(self.path("commits", ingest_batch=n)):
                if name.startswith("attempt="):
                    found.append(f"{self.path('landed', ingest_batch=n)}/{name}")
        return [p for p in found if self.exists(p)]

    def _landed_between(self, first: int, last: int) -> DataFrame:
        paths = self._landed_folders(first, last)
        if not paths:
            return self.spark.createDataFrame([], LANDED).drop("attempt")
        return self.spark.read.schema(LANDED).option("basePath", self.path("landed")).parquet(*paths).drop("attempt")

    def landed(self) -> DataFrame:
        return self._landed_between(1, self.last_commit())

    def staging(self) -> DataFrame:
        """All good rows that were ever staged and not purged."""
        return _staged(self.landed())

    def staged_between(self, first: int, last: int) -> DataFrame:
        """Good rows of the given runs; folders of other runs are not even listed."""
        return _staged(self._landed_between(first, last))

    def pending(self) -> DataFrame:
        """Staged rows that no merge has taken yet."""
        head = self.head()
        rows = self.staged_between(head.last_ingest_batch + 1, self.last_commit())
        return rows.filter(F.col("seq") >= head.merged_below)

    def errors(self) -> DataFrame:
        return (
            self.landed()
            .filter(F.col("outcome") == REJECTED)
            .select(*schemas.ERROR.names, "ingest_batch")
        )

    def attempts(self) -> DataFrame:
        """Failed reads, one row each."""
        return self.read("attempts", ATTEMPTS)

    def record_attempts(self, files: DataFrame, at: dt.datetime) -> None:
        """Appends (source_file, ok, error); `ok` notes that a file could be read after all."""
        stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        files.select("source_file", "ok", "error", stamp.alias("at")).write.mode("append").parquet(self.path("attempts"))

    # ---- merge side --------------------------------------------------------

    def head(self) -> Head:
        snapshot = self.newest("snapshots", "snapshot")
        if not snapshot:
            return Head()
        path = self.path("snapshots", snapshot=snapshot)
        if path not in self._contents:
            rows = self.spark.read.schema(SNAPSHOTS).parquet(path).collect()
            layout = sorted((r["reference_date"], r["version"]) for r in rows if r["reference_date"])
            first = rows[0].asDict()
            shared = {n: first[n] for n in SNAPSHOTS.names if n not in ("reference_date", "version")}
            if shared["merged_rows"] is None:  # written before merges could end inside a run
                shared |= {"merged_rows": self.commit(shared["last_ingest_batch"])["total_valid"], "merged_below": 0}
            self._contents[path] = Head(snapshot=snapshot, layout=tuple(layout), **shared)
        return self._contents[path]

    def last_snapshot(self) -> int:
        return self.head().snapshot

    def last_merged(self) -> int:
        return self.head().last_ingest_batch

    def layout(self) -> list[tuple]:
        """(date, version) pairs of the current table: one per partition folder."""
        return list(self.head().layout)

    def partitions(self, layout: list[tuple]) -> DataFrame:
        """The principal rows stored in the given partition folders."""
        if not layout:
            return self.spark.createDataFrame([], schemas.PRINCIPAL)
        paths = [self.path("principal", version=v, reference_date=d) for d, v in layout]
        return (
            self.spark.read.schema(PRINCIPAL_FILES)
            .option("basePath", self.path("principal"))
            .parquet(*paths)
            .select(*schemas.PRINCIPAL.names)
        )

    def principal(self) -> DataFrame:
        return self.partitions(self.layout())

    def changes(self) -> DataFrame:
        """Per merged key and snapshot: the action taken."""
        return self.read("changes", CHANGES).filter(F.col("snapshot") <= self.last_snapshot())

    def changes_of(self, snapshot: int) -> DataFrame:
        """The decisions of one merge, complete or not."""
        path = self.path("changes", snapshot=snapshot)
        return self.spark.read.schema(CHANGES).option("basePath", self.path("changes")).parquet(path)

    def metrics(self) -> DataFrame:
        return self.read("metrics", METRICS_FILES).filter(F.col("snapshot") <= self.last_snapshot())

    def counts(self) -> dict[str, int]:
        """Staging, principal and error counts, from the last commit and the snapshot."""
        head = self.head()
        newest = self.commit(self.last_commit())
        return {
            "staging": newest["total_valid"] - head.merged_rows,
            "principal": head.table_rows,
            "errors": newest["total_rejected"],
        }

    # ---- retention ---------------------------------------------------------

    def purge_consumed(self) -> list[int]:
        """Deletes staged rows of merged runs. Their errors stay, and so does the
        ledger, which keeps the files from being taken again."""
        merged = self.last_merged()
        runs = sorted(int(name.split("=")[1]) for name in self.names(self.path("landed")) if "=" in name)
        return [
            n for n in runs if n <= merged and self.drop_all(f"{self.path('landed', ingest_batch=n)}/attempt=*/outcome={STAGED}")
        ]

    def purge_versions(self) -> list[int]:
        """Deletes principal versions that the current snapshot does not use."""
        used = {v for _, v in self.layout()}
        unused = [v for v in range(1, self.last_snapshot() + 1) if v not in used]
        for version in unused:
            self.drop(self.path("principal", version=version))
        return unused
