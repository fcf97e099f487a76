"""Ingest and merge runs on a store: golden case, replays, duplicates, retention."""

import datetime as dt
import json
import os
from decimal import Decimal

import golden
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.appending import file_states
from tidemark.plans.ingest import ingest_files, ingest_listed
from tidemark.plans.merge import merge_all, merge_pending, seed_principal
from tidemark.plans.store import RunExists, Store
from tidemark.sources.files import listed_files, scan, scan_nanoseconds
from tidemark.streaming.queries import await_batches, ingest_stream, merge_stream

T0 = dt.datetime(2025, 2, 1, 12, 0, 0)
T1 = dt.datetime(2025, 2, 2, 12, 0, 0)


def principal(store):
    return {
        (r.account_id, r.asset_id, r.reference_date): (r.quantity, r.amount, r.created_at, r.updated_at)
        for r in store.principal().collect()
    }


def test_golden_case(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seed_principal(store, golden.frame(spark, golden.SEED), T0)
    golden.write(spark, golden.FILE, tmp_path / "in")

    assert ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T1) == 1
    commit = store.commits().first()
    assert (commit.rows, commit.valid, commit.invalid, commit.duplicate) == (24, 20, 4, 0)
    errors = {r.row_number: r for r in store.errors().collect()}
    assert {n: r.error_reason for n, r in errors.items()} == {
        20: "quantity is invalid: -100.0",
        21: "account_id is empty",
        22: "asset_id is empty",
        23: "amount is invalid: -500.0",
    }
    assert json.loads(errors[20].payload) == {
        "account_id": "ACC006",
        "asset_id": "INVL1",
        "reference_date": "2025-01-15 00:00:00",
        "quantity": -100.0,
        "amount": 5000.0,
    }

    counts = merge_pending(store, T1)
    assert (counts.inserted, counts.updated, counts.unchanged, counts.superseded) == (17, 3, 0, 0)
    rows = principal(store)
    assert len(rows) == 20
    assert rows["ACC001", "PETR4", dt.date(2025, 1, 15)] == (
        Decimal("1500.0000"),
        Decimal("37500.00"),
        T0,
        T1,
    )
    assert rows["ACC005", "ITUB4", dt.date(2025, 1, 15)][2:] == (T1, T1)
    assert store.pending().count() == 0
    assert merge_pending(store) is None


def test_same_file_again_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE, tmp_path / "in")
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T0)
    merge_pending(store, T0)
    store.purge_consumed()
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T1)
    assert store.pending().count() == 0
    assert store.errors().count() == 4
    again = merge_pending(store, T1)
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 0)
    assert len(principal(store)) == 20


def test_same_content_in_another_file_is_unchanged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE, tmp_path / "a")
    golden.write(spark, golden.FILE, tmp_path / "b")
    ingest_files(store, scan(spark, str(tmp_path / "a")), run_ts=T0)
    merge_pending(store, T0)
    before = principal(store)
    ingest_files(store, scan(spark, str(tmp_path / "b")), run_ts=T1)
    counts = merge_pending(store, T1)
    assert (counts.inserted, counts.updated, counts.unchanged) == (0, 0, 20)
    assert principal(store) == before


def test_duplicate_rows_of_a_file_are_rejected(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = golden.FILE[0]
    golden.write(spark, [row, golden.FILE[1], row, row], tmp_path / "in")
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T0)
    commit = store.commits().first()
    assert (commit.valid, commit.invalid, commit.duplicate) == (2, 0, 2)
    assert sorted(r.row_number for r in store.errors().collect()) == [2, 3]
    assert {r.error_reason for r in store.errors().collect()} == {"duplicate record in file"}


@pytest.mark.parametrize("limit", [1 << 30, -1])
def test_grown_file_repeats_a_row_of_an_earlier_run(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr("tidemark.plans.ingest.BROADCAST_BYTES", limit)
    store, path = Store(spark, str(tmp_path / "store")), tmp_path / "in" / "grows.parquet"
    path.parent.mkdir()

    def write(rows):
        names = ["account_id", "asset_id", "reference_date", "quantity", "amount"]
        pq.write_table(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), path)

    write(golden.FILE[:4])
    ingest_files(store, scan(spark, str(path.parent)), run_ts=T0)
    write([*golden.FILE[:4], golden.FILE[1], golden.FILE[5], golden.FILE[5]])
    ingest_files(store, scan(spark, str(path.parent)), run_ts=T1)
    second = store.commit(2)
    assert (second.rows, second.valid, second.invalid, second.duplicate) == (3, 1, 0, 2)
    assert sorted(r.row_number for r in store.errors().collect()) == [4, 6]
    assert sorted(r.row_number for r in store.staging().collect()) == [0, 1, 2, 3, 5]
    # Without a new row nothing is read for repeats, and nothing lands.
    ingest_files(store, scan(spark, str(path.parent)), run_ts=T1)
    assert store.commit(3).rows == 0


@pytest.mark.parametrize("files, shapes, runs", [(2, 200, 4), (100, 1, 3), (100, 200, 1)])
def test_long_lists_are_landed_by_runs(spark, tmp_path, monkeypatch, files, shapes, runs):
    """Runs hold so many files and shapes at most, follow the times of the files and leave none out."""
    monkeypatch.setattr("tidemark.plans.ingest.RUN_FILES", files)
    monkeypatch.setattr("tidemark.plans.ingest.RUN_SHAPES", shapes)
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(7):
        quantity = pa.array([n + 1], pa.int32() if 2 <= n < 4 else pa.float64())
        columns = {"account_id": ["A"], "asset_id": ["X"], "reference_date": [golden.DAY], "quantity": quantity, "amount": [1.0]}
        pq.write_table(pa.table(columns), folder / f"{9 - n}.parquet")
        os.utime(folder / f"{9 - n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    (folder / "bad.parquet").write_bytes(b"PAR1")
    store = Store(spark, str(tmp_path / "store"))
    listed = listed_files(spark, str(folder)).select(F.col("source_file").alias("path"))
    last = ingest_listed(store, listed, run_ts=T0)
    assert last == store.last_commit() >= runs and (files == 2 or last == runs)
    assert store.commits().agg(F.sum("files"), F.max("files") <= files).first() == (7, True)
    assert [int(r.quantity) for r in store.staging().orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert [r.ok for r in store.attempts().collect()] == [False]
    merge_pending(store, T1)
    assert [int(r.quantity) for r in store.principal().collect()] == [7]


def test_rows_that_round_alike_are_no_duplicates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    key = ("A", "B", golden.DAY)
    golden.write(spark, [(*key, 1.00001, 2.0), (*key, 1.00002, 2.0), (*key, 1.00001, 2.0), (*key, 1.00001, 2.001)], tmp_path / "in")
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T0)
    commit = store.commits().first()
    assert (commit.valid, commit.invalid, commit.duplicate) == (3, 0, 1)
    assert [r.row_number for r in store.errors().collect()] == [2]
    assert {(r.quantity, r.amount) for r in store.staging().collect()} == {(Decimal("1.0000"), Decimal("2.00"))}


def test_last_staged_row_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    key = ("A", "B", golden.DAY)
    golden.write(spark, [(*key, 1.0, 1.0), (*key, 3.0, 3.0), (*key, 2.0, 2.0)], tmp_path / "a")
    golden.write(spark, [(*key, 5.0, 5.0)], tmp_path / "b")
    ingest_files(store, scan(spark, str(tmp_path / "a")), run_ts=T0)
    ingest_files(store, scan(spark, str(tmp_path / "b")), run_ts=T1)
    counts = merge_pending(store, T1)
    assert (counts.inserted, counts.superseded) == (1, 3)
    assert principal(store) == {
        ("A", "B", dt.date(2025, 1, 15)): (Decimal("5.0000"), Decimal("5.00"), T0, T1)
    }


def test_failed_run_is_invisible_and_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE, tmp_path / "in")
    rows = scan(spark, str(tmp_path / "in"))
    # What a run leaves behind that dies before its commit.
    golden.write(spark, golden.FILE, tmp_path / "other")
    ingest_files(store, rows, run_ts=T0)
    store.drop(store.path("commits", ingest_batch=1))
    assert store.pending().count() == 0 and store.errors().count() == 0
    assert ingest_files(store, rows, run_ts=T0) == 1
    assert store.pending().count() == 20

    merge_pending(store, T0)
    done = principal(store)
    store.drop(store.path("snapshots", snapshot=1))
    assert principal(store) == {}
    merge_pending(store, T0)
    assert principal(store) == done


def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch):
    """A second writer commits the same number while the first one is at work."""
    golden.write(spark, golden.FILE[:10], tmp_path / "a")
    golden.write(spark, golden.FILE[10:], tmp_path / "b")
    first, second = (Store(spark, str(tmp_path / "store")) for _ in "ab")
    publish = Store.publish

    def late(store, written, batch):
        if store is first and second.last_commit() == 0:
            assert ingest_files(second, scan(spark, str(tmp_path / "b")), run_ts=T0) == 1
        publish(store, written, batch)

    monkeypatch.setattr(Store, "publish", late)
    with pytest.raises(RunExists):
        ingest_files(first, scan(spark, str(tmp_path / "a")), run_ts=T0)
    assert (first.staging().count(), first.errors().count(), first.ledger().count()) == (10, 4, 1)
    assert ingest_files(first, scan(spark, str(tmp_path / "a")), run_ts=T0) == 2
    assert (first.staging().count(), first.errors().count()) == (20, 4)
    assert first.commits().agg(F.sum("valid")).first()[0] == 20 == first.commit(2).total_valid


def test_ledger_reads_the_buckets_of_the_run_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n in range(3):
        golden.write(spark, golden.FILE[:2], tmp_path / f"{n}")
        ingest_files(store, scan(spark, str(tmp_path / f"{n}")), run_ts=T0)
    rows = store.ledger().collect()
    assert len(rows) == 3 and all(r.file_rows == 2 and r.first_new == 0 for r in rows)
    one = store.ledger([rows[0].bucket])
    assert {r.bucket for r in one.collect()} == {rows[0].bucket}
    assert all(f"bucket={rows[0].bucket}/" in f for f in one.inputFiles() if "/ledger/" in f)
    assert store.ledger([]).count() == 0


def test_appended_and_rewritten_dates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.merge.MAX_VERSIONS", 2)
    store = Store(spark, str(tmp_path / "store"))
    for n in range(4):
        golden.write(spark, [(f"A{n}", "X", golden.DAY, 1.0, 1.0)], tmp_path / f"{n}")
        ingest_files(store, scan(spark, str(tmp_path / f"{n}")), run_ts=T0)
        merge_pending(store, T0)
    assert len(principal(store)) == 4
    # Two folders, then one rewrite, then one folder more.
    assert [v for _, v in store.layout()] == [3, 4]
    assert store.purge_versions() == [1, 2]
    assert len(principal(store)) == 4
    assert store.metrics().agg(F.max("total_processed")).first()[0] == 4


@pytest.mark.parametrize("limit", [-1, 1 << 30])
@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_merges_of_so_many_rows(spark, tmp_path, monkeypatch, size, limit):
    """Batches that end inside a run, at its end and behind all runs, with rejected rows between."""
    monkeypatch.setattr("tidemark.plans.merge.BROADCAST_BYTES", limit)
    key = [("A", "X", golden.DAY), ("B", "Y", golden.DAY)]
    runs = [
        [(*key[0], 1.0, 1.0), ("", "X", golden.DAY, 1.0, 1.0), (*key[1], 1.0, 1.0)],
        [(*key[0], 2.0, 1.0), (*key[1], 1.0, 1.0), (*key[0], 3.0, 1.0), ("C", "Z", golden.DAY, 5.0, 5.0)],
        [("", "", golden.DAY, 1.0, 1.0)],
        [(*key[0], 3.0, 1.0)],
    ]
    store = Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate(runs):
        golden.write(spark, rows, tmp_path / f"{n}")
        ingest_files(store, scan(spark, str(tmp_path / f"{n}")), run_ts=T0)
    good = [r for rows in runs for r in rows if r[0]]
    state, pending = {}, len(good)
    for at in range(0, len(good), size):
        batch = good[at : at + size]
        last = {r[:3]: r[3:] for r in batch}
        inserted = sum(k not in state for k in last)
        updated = sum(k in state and state[k] != v for k, v in last.items())
        assert store.pending().count() == store.counts()["staging"] == pending
        counts = merge_pending(store, T1, max_rows=size)
        assert (counts.inserted, counts.updated, counts.staged) == (inserted, updated, len(batch))
        pending -= len(batch)
        state |= last
    assert merge_all(store, lambda: T1, max_rows=size) == []
    assert store.last_merged() == len(runs) and store.pending().count() == 0
    assert {k: tuple(map(float, v[:2])) for k, v in principal(store).items()} == {
        (a, b, dt.date.fromisoformat(str(d)[:10])): v for (a, b, d), v in state.items()
    }
    with pytest.raises(ValueError):
        merge_pending(store, T1, max_rows=0)


def test_many_staged_keys_are_shuffled_once(spark, tmp_path, monkeypatch):
    from tidemark.plans import merge

    decided, plans = merge._decided, []

    def noted(*frames):
        found = decided(*frames)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(merge, "_decided", noted)
    monkeypatch.setattr(merge, "BROADCAST_BYTES", 0)
    store = Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate((golden.SEED, golden.FILE)):
        golden.write(spark, rows, tmp_path / f"in{n}")
        ingest_files(store, scan(spark, str(tmp_path / f"in{n}")), run_ts=T1)
        counts = merge_pending(store, T1)
        assert not store.exists(store.path("work", merge=counts.snapshot))
    assert (counts.inserted, counts.updated, counts.unchanged, counts.superseded) == (17, 3, 0, 0)
    # The aggregate's shuffle, and in the second merge that of the target.
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [1, 2]


def test_large_manifest_path_gives_the_same_rows(spark, tmp_path, monkeypatch):
    golden.write(spark, golden.FILE, tmp_path / "in")
    golden.write(spark, golden.FILE[::-1], tmp_path / "in")
    landed = []
    for name, limit in (("a", 1 << 30), ("b", -1)):
        monkeypatch.setattr("tidemark.plans.ingest.BROADCAST_BYTES", limit)
        store = Store(spark, str(tmp_path / name))
        ingest_files(store, scan(spark, str(tmp_path / "in")), batch_id="x", run_ts=T0)
        landed.append(sorted(map(str, store.landed().collect())))
    assert len(landed[0]) == 48
    assert landed[0] == landed[1]


def test_streams_equal_batch_and_resume(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def drain():
        ingest_stream(
            store, str(tmp_path / "in"), str(tmp_path / "cp1"), max_files=1, clock=lambda: T0
        ).awaitTermination(120)
        merge_stream(store, str(tmp_path / "cp2"), clock=lambda: T0).awaitTermination(120)

    golden.write(spark, golden.FILE[:10], tmp_path / "in")
    drain()
    golden.write(spark, golden.FILE[10:], tmp_path / "in")
    drain()
    first = principal(store)
    assert len(first) == 20
    assert store.errors().count() == 4
    drain()
    assert principal(store) == first
    # A lost checkpoint reads every file again; the ledger keeps the rows out.
    ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "cp3")).awaitTermination(120)
    assert store.pending().count() == 0


def test_merge_starts_before_any_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    merge_stream(store, str(tmp_path / "cp"), clock=lambda: T0).awaitTermination(120)
    assert store.last_snapshot() == 0 and store.last_commit() == 0
    golden.write(spark, golden.FILE, tmp_path / "in")
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T0)
    merge_stream(store, str(tmp_path / "cp"), clock=lambda: T0).awaitTermination(120)
    assert len(principal(store)) == 20


def test_failed_merge_raises(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE, tmp_path / "in")
    ingest_files(store, scan(spark, str(tmp_path / "in")), run_ts=T0)
    for part in (tmp_path / "store" / "landed").rglob("*.parquet"):
        part.write_bytes(b"PAR1 no parquet file PAR1")
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    query = merge_stream(store, str(tmp_path / "cp"), every="0 seconds")
    with pytest.raises(StreamingQueryException):
        await_batches(query, 1, timeout=120)
    assert store.last_snapshot() == 0


def test_seed_keeps_one_row_per_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = golden.SEED[0]
    seed_principal(store, golden.frame(spark, [row, row, (*row[:3], 7.0, 9.0)]), T0)
    assert len(principal(store)) == store.principal().count() == 1


def test_bad_files_do_not_stop_good_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE, tmp_path / "in")
    bad = [tmp_path / "in" / "bad x[1].parquet", tmp_path / "in" / "worse.parquet"]
    for path in bad:
        path.write_bytes(b"PAR1 no parquet file PAR1")
    listed = listed_files(spark, str(tmp_path / "in")).select(F.col("source_file").alias("path"), "file_time")
    gone = spark.createDataFrame([(f"file:{tmp_path}/gone.parquet", None)], listed.schema)
    assert ingest_listed(store, listed.unionByName(gone), run_ts=T0) == 1
    assert (store.commits().first().valid, store.commits().first().invalid) == (20, 4)
    assert store.attempts().count() == 3
    # Nothing new is listed: only the failed files are tried again, and then given up.
    for attempt in (2, 3, 3):
        assert ingest_listed(store, listed.unionByName(gone), run_ts=T1) is None
        assert store.attempts().count() == 3 * attempt
    assert {(r.source_file.split("/")[-1], r.status) for r in file_states(store.attempts()).collect()} == {
        ("bad x[1].parquet", "dead"), ("worse.parquet", "dead"), ("gone.parquet", "dead")
    }


def test_file_that_becomes_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    golden.write(spark, golden.FILE[:5], tmp_path / "in")
    (tmp_path / "in" / "late.parquet").write_bytes(b"PAR1")
    cp = str(tmp_path / "cp")
    ingest_stream(store, str(tmp_path / "in"), cp).awaitTermination(120)
    assert store.commits().first().valid == 5
    golden.write(spark, golden.FILE[5:20], tmp_path / "made")
    (tmp_path / "in" / "late.parquet").write_bytes(next((tmp_path / "made").glob("*.parquet")).read_bytes())
    golden.write(spark, golden.FILE[20:], tmp_path / "in")
    ingest_stream(store, str(tmp_path / "in"), cp).awaitTermination(120)
    assert (store.staging().count(), store.errors().count()) == (20, 4)
    assert [r.status for r in file_states(store.attempts()).collect()] == ["done"]


def test_files_with_other_types(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stamps = pd.to_datetime(["2025-01-15 10:20:30.123456789"])
    keys = {"account_id": pa.array(["A"]), "asset_id": pa.array(["X"])}
    made = {
        "int": (pa.array(stamps.as_unit("us")), pa.array([3]), pa.array([4])),
        "decimal": (pa.array(stamps.as_unit("ms")), pa.array([Decimal("1.25")]), pa.array([Decimal("2.50")])),
        "nanos": (pa.array(stamps.as_unit("ns")), pa.array([1.5]), pa.array([2.5])),
        "date": (pa.array([dt.date(2025, 1, 15)]), pa.array([1.0], pa.float32()), pa.array([2], pa.int32())),
        "missing": (pa.array(stamps.as_unit("us")), pa.array([1.0]), None),
    }
    for name, (date, quantity, amount) in made.items():
        columns = keys | {"reference_date": date, "quantity": quantity, "amount": amount}
        pq.write_table(pa.table({n: c for n, c in columns.items() if c is not None}), folder / f"{name}.parquet", version="2.6")
    store = Store(spark, str(tmp_path / "store"))
    listed = listed_files(spark, str(folder)).select(F.col("source_file").alias("path"))
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong")
    assert ingest_listed(store, listed, run_ts=T0) == 1
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == before
    rows = {r.source_file.split("/")[-1]: (r.reference_date, r.quantity, r.amount) for r in store.staging().collect()}
    day = dt.date(2025, 1, 15)
    assert rows == {
        "int.parquet": (day, Decimal("3.0000"), Decimal("4.00")),
        "decimal.parquet": (day, Decimal("1.2500"), Decimal("2.50")),
        "nanos.parquet": (day, Decimal("1.5000"), Decimal("2.50")),
        "date.parquet": (day, Decimal("1.0000"), Decimal("2.00")),
    }
    assert [r.source_file.split("/")[-1] for r in store.errors().collect()] == ["missing.parquet"]


def test_newest_number(spark, tmp_path):
    for last in (0, 1, 2, 3, 7, 8, 13):
        store = Store(spark, str(tmp_path / f"{last}"))
        for n in range(1, last + 1):
            folder = tmp_path / f"{last}" / "commits" / f"ingest_batch={n}"
            folder.mkdir(parents=True)
            (folder / "_SUCCESS").touch()
            if n == last // 2:
                assert store.newest("commits", "ingest_batch") == n
        assert store.newest("commits", "ingest_batch") == last
        assert store.newest("commits", "ingest_batch") == last


def test_file_with_nanoseconds(spark, tmp_path):
    stamps = pd.to_datetime(["2025-01-15 10:20:30.123456789", None]).as_unit("ns")
    frame = pd.DataFrame(
        {"account_id": ["A", "B"], "asset_id": ["X", "Y"], "reference_date": stamps, "quantity": 1.0, "amount": 2.0}
    )
    pq.write_table(pa.Table.from_pandas(frame), str(tmp_path / "n.parquet"), version="2.6")
    rows = scan_nanoseconds(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [r.reference_date for r in rows] == [dt.datetime(2025, 1, 15, 10, 20, 30, 123456), None]
