"""The ingest and the merge as streaming queries.

Both keep their data in the store, so the streams hold no state of their own:
the checkpoint remembers which files were seen, the ledger which rows landed.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.ingest import ingest_listed
from tidemark.plans.merge import merge_all
from tidemark.plans.store import COMMITS, Store
from tidemark.sources.files import new_files


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Drains what is there and stops, or runs at the given interval."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return trigger.start()


def ingest_stream(
    store: Store,
    input_path: str,
    checkpoint: str,
    every: str | None = None,
    max_files: int | None = 100_000,
    max_bytes: str | None = None,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
    **options,
) -> StreamingQuery:
    """Lands new Parquet files; one micro-batch is one ingest run.

    A micro-batch that is replayed after its commit finds its rows in the
    ledger and adds nothing. An error stops the query; the next start replays.
    """

    def land(listed: DataFrame, epoch: int) -> None:
        ingest_listed(store, listed, run_ts=clock(), **options)

    names = new_files(store.spark, input_path, max_files, max_bytes)
    return _started(names.writeStream.foreachBatch(land), checkpoint, every)


def merge_stream(
    store: Store,
    checkpoint: str,
    every: str | None = None,
    max_runs: int | None = None,
    max_rows: int | None = None,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
) -> StreamingQuery:
    """Merges whenever ingest runs are committed.

    The commit folder is the stream: one small file per run. What is merged
    follows from the snapshot, so a replay has nothing left to merge. With `max_rows`,
    one micro-batch is as many merges of at most so many staged rows as it takes.
    """
    store.make(store.path("commits"))  # a stream may start before the first run
    reader = store.spark.readStream.schema(COMMITS).option("recursiveFileLookup", "false")
    if max_runs:
        reader = reader.option("maxFilesPerTrigger", max_runs)

    def merge(commits: DataFrame, epoch: int) -> None:
        last = commits.agg({"ingest_batch": "max"}).first()[0]
        if last is not None:
            merge_all(store, clock, last, max_rows)

    writer = reader.parquet(store.path("commits")).writeStream.foreachBatch(merge)
    return _started(writer, checkpoint, every)


def await_batches(query: StreamingQuery, count: int, timeout: float, poll: float = 0.2) -> bool:
    """Waits until `count` micro-batches with input are done, then stops.

    Raises what the query failed with.
    """
    end = time.monotonic() + timeout
    done: set[int] = set()
    while time.monotonic() < end:
        active = query.isActive
        done |= {p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0}
        if len(done) >= count:
            stop_gracefully(query)
            return True
        if not active:
            break
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()
    return False


def stop_gracefully(query: StreamingQuery, timeout: float = 60.0, poll: float = 0.1) -> None:
    """Stops between two micro-batches; the next start resumes at the checkpoint."""
    end = time.monotonic() + timeout
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(poll)
    query.stop()
