"""Operators against brute force, with the pieces and ranges made tiny so that
every boundary is crossed."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import appending, datasets, dedup, history, merging, ordering, reporting, spacing
from tidemark.schemas import KEY
from tidemark.sources import notifications

KEY2 = ["account_id", "asset_id"]


def staged_rows(n, seed, hot=0.4):
    """`n` rows of which a large share belongs to one key."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        key = ("H", "H") if rnd.random() < hot else (f"A{rnd.randrange(6)}", f"B{rnd.randrange(3)}")
        rows.append((*key, rnd.randrange(3), rnd.randrange(2), seq))
    return rows


SCHEMA = "account_id string, asset_id string, quantity int, amount int, seq long"


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_running_sums_and_positions(spark, width):
    rnd = random.Random(1)
    orders = rnd.sample(range(1000), 200)
    data = [(o, rnd.randrange(5), f"g{rnd.randrange(2)}") for o in orders]
    rows = spark.createDataFrame(data, "o long, v int, g string")
    found = {
        (r.o, r.s)
        for r in ordering.running_sums(rows, "o", {"s": F.col("v")}, ["g"], width).collect()
    }
    totals, wanted = Counter(), set()
    for o, v, g in sorted(data):
        totals[g] += v
        wanted.add((o, totals[g]))
    assert found == wanted
    batches = {r.o: (r.position, r.batch) for r in ordering.with_batches(rows, "o", 30, width).collect()}
    assert batches == {o: (i + 1, i // 30 + 1) for i, o in enumerate(sorted(orders))}


@pytest.mark.parametrize("count", [0, 1, 333, 500, 501])
def test_sample_has_exactly_the_wanted_rows(spark, count, monkeypatch):
    monkeypatch.setattr(ordering, "SAMPLE_BITS", 3)
    rows = spark.range(500).withColumnRenamed("id", "k")
    found = ordering.sample_rows(rows, ["k"], count, seed=5)
    again = ordering.sample_rows(rows.repartition(3), ["k"], count, seed=5)
    kept = sorted(r.k for r in found.collect())
    assert len(set(kept)) == len(kept) == min(count, 500)
    assert kept == sorted(r.k for r in again.collect())


def test_first_rows_and_hash_order(spark):
    rows = spark.range(100)
    assert [r.id for r in ordering.first_rows(rows, "id", 3).collect()] == [0, 1, 2]
    mixed = [r.id for r in ordering.hash_order(rows, ["id"]).collect()]
    assert sorted(mixed) == list(range(100)) and mixed != list(range(100))


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_repeats_of_a_hot_group(spark, bits, monkeypatch):
    monkeypatch.setattr(dedup, "PIECE_BITS", bits)
    rnd = random.Random(2)
    data = [("f", "hot" if rnd.random() < 0.5 else f"h{rnd.randrange(40)}", n) for n in range(120)]
    data += [("g", "hot", 500), ("g", "once", 501)]
    rows = spark.createDataFrame(data, "f string, h string, n long")
    digests = dedup.possible_repeats(rows, ["f", "h"])
    narrowed = dedup.with_digest_in(rows, digests, ["f", "h"])
    pieces = dedup.repeated_pieces(narrowed, ["f", "h"], "n")
    marked = dedup.mark_repeats(rows, pieces, ["f", "h"], "n").collect()
    firsts = {}
    for f, h, n in data:
        firsts[f, h] = min(n, firsts.get((f, h), n))
    assert len(marked) == len(data)
    assert {r.n for r in marked if r.is_repeat} == {n for f, h, n in data if n != firsts[f, h]}


def test_first_last_distinct(spark):
    rows = spark.createDataFrame(staged_rows(200, 3), SCHEMA)
    last, first = {}, {}
    for a, b, q, m, s in staged_rows(200, 3):
        last[a, b] = (q, m)
        first.setdefault((a, b), (q, m))
    values = ["quantity", "amount"]
    for make, wanted in ((dedup.last_per_key, last), (dedup.first_per_key, first)):
        assert {(r[0], r[1]): (r[2], r[3]) for r in make(rows, KEY2, values, "seq").collect()} == wanted
    assert {tuple(r) for r in dedup.distinct_keys(rows, KEY2).collect()} == set(last)


def merged_by_hand(staged, target, size):
    """Row by row in batches, the last row of a key in a batch counts."""
    state, log = dict(target), []
    for start in range(0, len(staged), size):
        batch = staged[start : start + size]
        final = {(a, b): (q, m) for a, b, q, m, _ in batch}
        actions = Counter()
        for key, values in final.items():
            if key not in state:
                actions["inserted"] += 1
            elif state[key] != values:
                actions["updated"] += 1
            state[key] = values
        log.append((len(log) + 1, actions["inserted"], actions["updated"], len(batch)))
    return state, log


@pytest.mark.parametrize("span", [2, 3, 4096])
def test_batch_history(spark, span, monkeypatch):
    monkeypatch.setattr(history, "SPAN", span)
    data = staged_rows(300, 4)
    target = {("H", "H"): (1, 1), ("A1", "B1"): (0, 0), ("X", "X"): (9, 9)}
    staged = spark.createDataFrame(data, SCHEMA)
    current = spark.createDataFrame(
        [(*k, *v) for k, v in target.items()],
        "account_id string, asset_id string, quantity int, amount int",
    )
    actions = history.version_actions(staged, current, 10, key=KEY2)
    metrics = history.batch_metrics(actions)
    state, log = merged_by_hand(data, target, 10)
    found = sorted(metrics.collect(), key=lambda r: r.batch)
    assert [(r.batch, r.inserted, r.updated, r.rows) for r in found] == log
    assert found[-1].total_rows == 300
    assert found[-1].total_processed == sum(i + u for _, i, u, _ in log)
    progress = history.batch_progress(metrics, reporting.row_count(staged), 10).collect()
    assert {(r.batch, r.percent_done, r.batches) for r in progress} == {
        (n, 100.0 * n * 10 / 300, 30) for n in range(1, 31)
    }


def merge_frames(spark, seed):
    day = dt.date(2024, 1, 1)
    stamp = dt.datetime(2024, 5, 1)
    data = [
        (a, b, day, q, m, s, stamp + dt.timedelta(seconds=s)) for a, b, q, m, s in staged_rows(80, seed)
    ]
    schema = (
        "account_id string, asset_id string, reference_date date, quantity int, amount int, "
        "seq long, created_at timestamp_ntz"
    )
    target = [("A0", "B0", day, 0, 0, stamp, stamp), ("A1", "B1", day, 1, 1, stamp, stamp), ("X", "X", day, 7, 7, stamp, stamp)]
    return (
        spark.createDataFrame(data, schema),
        spark.createDataFrame(
            target,
            "account_id string, asset_id string, reference_date date, quantity int, amount int, "
            "updated_at timestamp_ntz, created_at timestamp_ntz",
        ),
    )


@pytest.mark.parametrize("seed", [5, 6])
def test_merge_parts_fit_together(spark, seed):
    staged, target = merge_frames(spark, seed)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    collapsed = merging.collapse(staged)
    result = merging.merge_result(collapsed, target, now)
    rows = {tuple(r[:3]): r for r in result.collect()}
    inserted = {tuple(r[:3]): r for r in merging.inserted_rows(collapsed, target).collect()}
    updated = {tuple(r[:3]): r for r in merging.updated_rows(collapsed, target, now).collect()}
    old = {tuple(r[:3]): r for r in target.collect()}
    assert set(rows) == set(old) | set(inserted)
    for key, row in rows.items():
        if key in inserted:
            assert (row.quantity, row.amount) == (inserted[key].quantity, inserted[key].amount)
            assert row.created_at == inserted[key].created_at
        elif key in updated:
            assert (row.quantity, row.updated_at) == (updated[key].quantity, dt.datetime(2024, 6, 1))
            assert row.created_at == old[key].created_at
        else:
            assert tuple(row) == tuple(old[key])
    summary = merging.merge_summary(merging.merge_actions(collapsed, target)).first()
    assert summary.inserted == len(inserted) and summary.updated == len(updated)
    assert summary.inserted + summary.updated + summary.unchanged + summary.superseded == summary.staged == 80
    # A second merge of the same rows changes nothing.
    again = merging.merge_result(collapsed, result, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.values()}


def test_change_test_is_null_safe(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, 1), (None, None)], "a int, b int")
    found = [r[0] for r in pairs.select(merging.differs([F.col("a")], [F.col("b")])).collect()]
    assert found == [False, True, True, True, False]


def test_merge_into_needs_a_table_with_row_operations(spark, tmp_path):
    staged, target = merge_frames(spark, 7)
    spark.sql("drop table if exists plain")
    target.write.option("path", str(tmp_path / "plain")).saveAsTable("plain")
    with pytest.raises(Exception, match="TABLE_OPERATION"):
        merging.merge_into_table(merging.collapse(staged), "plain", F.lit("2025-01-01").cast("timestamp_ntz"))
    spark.sql("drop table plain")


def test_appending(spark):
    rows = spark.createDataFrame([("f", n) for n in range(6)] + [("g", 0)], "source_file string, row_number long")
    known = rows.filter("source_file = 'f' and row_number < 4")
    left = appending.not_yet_present(rows, known).collect()
    assert {tuple(r) for r in left} == {("f", 4), ("f", 5), ("g", 0)}
    files = rows.select("source_file").distinct()
    marks = {tuple(r) for r in appending.high_water_marks(files, known).collect()}
    assert marks == {("f", 3), ("g", -1)}
    attempts = spark.createDataFrame(
        [("a", False), ("a", True), ("b", False), ("b", False), ("b", False), ("c", False)],
        "source_file string, ok boolean",
    )
    states = appending.file_states(attempts)
    assert {(r.source_file, r.status) for r in states.collect()} == {("a", "done"), ("b", "dead"), ("c", "retry")}
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source_file string")
    assert {r[0] for r in appending.files_to_try(listed, states).collect()} == {"c", "d"}


def test_data_sets(spark):
    anchor = "date'2025-01-31'"
    keys = datasets.key_space(spark, 3, anchor)
    rows = keys.collect()
    assert len({tuple(r[1:]) for r in rows}) == 3 * 20 * 31
    assert rows[0].reference_date == dt.date(2025, 1, 31) and rows[0].account_id == "ACC001"
    by_table = datasets.account_keys(spark.range(3), "id", anchor)
    assert {tuple(r) for r in by_table.collect()} == {tuple(r) for r in rows}

    records = datasets.allocated_records(spark, 3, 100, anchor, accounts=1)
    assert {r["count"] for r in records.groupBy("file_number").count().collect()} == {100}
    assert records.select(*KEY).distinct().count() == 300
    with pytest.raises(ValueError, match="requested 700"):
        datasets.allocated_records(spark, 7, 100, anchor, accounts=1)

    unique = datasets.unique_records(spark.range(900), "id", 300, anchor, accounts=2)
    assert unique.count() == unique.select(*KEY).distinct().count() == 300
    assert unique.filter("quantity < 10 or quantity > 10000 or amount < 100 or amount > 1000000").isEmpty()
    few = datasets.unique_records(spark.range(9000), "id", 10_000, anchor, accounts=1)
    assert few.count() == 620

    existing = unique.select(*KEY)
    changes = datasets.change_set(existing, keys.select(*KEY), 200, 60)
    kinds = {r.kind: r["count"] for r in changes.groupBy("kind").count().collect()}
    assert kinds == {"update": 120, "insert": 80}
    updates = changes.filter("kind = 'update'").select(*KEY)
    inserts = changes.filter("kind = 'insert'").select(*KEY)
    assert updates.exceptAll(existing).isEmpty()
    assert inserts.intersect(existing).isEmpty()


def test_stagnation_counts_equal_non_zero_snapshots(spark):
    counts = [0, 0, 5, 5, 5, 4, 4, 0, 0, 4]
    rows = spark.createDataFrame([(1, 5 * i, c) for i, c in enumerate(counts)], "run_id int, elapsed long, staging long")
    found = [tuple(r) for r in reporting.stagnation(rows, limit=2).orderBy("elapsed").select("stagnant", "is_stuck").collect()]
    assert [s for s, _ in found] == [0, 0, 0, 1, 2, 0, 1, 0, 0, 0]
    assert [i for i, (_, stuck) in enumerate(found) if stuck] == [4]


def test_report_of_no_batches_is_zero(spark):
    empty = spark.createDataFrame(
        [], "timestamp double, batch long, batch_time_ms double, inserted long, updated long, total_processed long"
    )
    row = reporting.report_metrics(empty).first()
    assert (row.total_records, row.throughput, row.total_batches, row.last_total_processed) == (0, 0.0, 0, 0)
    assert tuple(reporting.series_means(reporting.batch_series(empty)).first()) == (0.0, 0.0)


def test_notifications(spark):
    event = '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"k.parquet"}}}]}'
    quoted = event.replace('"', '\\"')
    bodies = {
        "plain": event,
        "envelope": f'{{"Type":"Notification","Message":"{quoted}"}}',
        "message is no json": '{"Type":"Notification","Message":"{oops","Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"body.parquet"}}}]}',
        "message is no text": '{"Type":"Notification","Message":{"Records":[]},"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"body.parquet"}}}]}',
        "other type": f'{{"Type":"Other","Message":"{quoted}"}}',
        "no bucket": '{"Records":[{"s3":{"bucket":{},"object":{"key":"k.parquet"}}}]}',
        "empty key": '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":""}}}]}',
        "other suffix": '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"k.csv"}}}]}',
        "two": '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"1.parquet"}}},{"s3":{"bucket":{"name":"c"},"object":{"key":"2.parquet"}}}]}',
        "not json": "{",
    }
    rows = spark.createDataFrame(list(bodies.items()), "kind string, body string")
    found = defaultdict(list)
    for r in notifications.notified_files(rows).collect():
        found[r.kind].append(r.source_file)
    assert dict(found) == {
        "plain": ["s3://b/k.parquet"],
        "envelope": ["s3://b/k.parquet"],
        "message is no json": ["s3://b/body.parquet"],
        "message is no text": ["s3://b/body.parquet"],
        "two": ["s3://b/1.parquet", "s3://c/2.parquet"],
    }


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_spaced_rows(spark, block, monkeypatch):
    monkeypatch.setattr(spacing, "BLOCK", block)
    rnd = random.Random(block)
    base = dt.datetime(2024, 3, 1)
    data = [(r, base + dt.timedelta(seconds=round(rnd.random() * 90, 1) + 400 * (rnd.random() < 0.1)), n) for r in "ab" for n in range(150)]
    data += [("c", base, 1), ("c", base, 0), ("d", None, 5), ("a", dt.datetime(1969, 12, 31), 6)]
    rows = spark.createDataFrame(data, "run string, ts timestamp, n long")
    wanted = set()
    for run in "abcd":
        last = None
        for t, n in sorted((t, n) for r, t, n in data if r == run and t):
            if last is None or t - last >= dt.timedelta(seconds=2.5):
                wanted.add((run, t, n))
                last = t
    assert {tuple(r) for r in spacing.spaced(rows.repartition(3), "ts", 2.5, "n", "run").collect()} == wanted
    assert spacing.spaced(rows.limit(0), "ts", 2.5, "n").count() == 0


@pytest.mark.parametrize(("block", "times", "cells"), [(1, 1, 4), (3, 5, 8), (8, 10, 50), (4096, 30, 4096), (4096, 200, 7)])
def test_spaced_rows_of_dense_times(spark, block, times, cells, monkeypatch):
    for name, value in {"BLOCK": block, "TIMES": times, "CELLS": cells}.items():
        monkeypatch.setattr(spacing, name, value)
    rnd = random.Random(times)
    base = dt.datetime(2024, 3, 1)
    # Run a: dense throughout; b: rows at the start of intervals only; c: dense, empty and thin stretches; null: few.
    seconds = [("a", rnd.random() * 30) for _ in range(700)]
    seconds += [("b", 2.5 * rnd.randrange(40) + rnd.random() / 4) for _ in range(300)]
    seconds += [("c", x + y) for x, n in ((0, 200), (60, 9), (500, 150)) for y in (rnd.random() * 12 for _ in range(n))]
    seconds += [(None, rnd.random() * 20) for _ in range(20)]
    data = [(r, base + dt.timedelta(seconds=round(s, 2)), n) for n, (r, s) in enumerate(seconds)]
    rows = spark.createDataFrame(data, "run string, ts timestamp, n long").repartition(3)
    wanted = set()
    for run in ("a", "b", "c", None):
        last = None
        for t, n in sorted((t, n) for r, t, n in data if r == run):
            if last is None or t - last >= dt.timedelta(seconds=2.5):
                wanted.add((run, t, n))
                last = t
    assert {tuple(r) for r in spacing.spaced(rows, "ts", 2.5, "n", "run").collect()} == wanted
    held = rows.selectExpr("run", "unix_micros(ts) as at").distinct()
    # A slice ends with the cell that fills it.
    cell = held.groupBy("run", F.expr(f"floor(at / {2_500_000 * block})"), F.expr(f"pmod(at, 2500000) * {cells} div 2500000")).count()
    largest = spacing.slices(held, 2_500_000).groupBy(*spacing.GROUP).count().agg({"count": "max"}).first()[0]
    assert largest < times + cell.agg({"count": "max"}).first()[0]


def test_await_conditions(spark):
    runs = {
        "merged": [0, 5, 5, 3, 2, 1, 1, 0, 0],
        "early": [0, 0, 0, 7, 7, 7, 7, 9],
        "never": [0] * 3,
        "late": [0] * 4 + [1] * 9,
        "out": [n + 1 for n in range(9)],
    }
    rows = [(r, 5 * i, n) for r, counts in runs.items() for i, n in enumerate(counts)]
    found = reporting.await_conditions(spark.createDataFrame(rows, "run_id string, elapsed long, staging long"), settle=10, arrive=20, give_up=45, limit=3)
    assert {r.run_id: (r.arrived, r.ended, r.outcome) for r in found.collect()} == {
        "merged": (5, 35, "merged"),
        "early": (15, 30, "stuck"),
        "never": (None, None, "timeout"),
        "late": (None, 15, "merged"),
        "out": (0, None, "timeout"),
    }


def test_last_values(spark):
    rows = spark.createDataFrame([(2, 5, None), (1, 9, 3.0), (3, 7, 2.0)], "batch long, total long, ms double")
    assert tuple(reporting.last_values(rows, ["total", "ms"]).first()) == (7, 2.0)
    assert tuple(reporting.last_values(rows.limit(0), ["total", "ms"]).first()) == (0, 0.0)


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_nth_value_equals_sorting(spark, width):
    values = sorted(random.Random(3).sample(range(200), 40))
    rows = spark.createDataFrame([(v,) for v in values], "seq long").repartition(3)
    for n in (1, 2, 20, 40):
        assert ordering.nth_value(rows, "seq", n, width).collect() == [(values[n - 1],)]
    for n in (0, 41):
        assert ordering.nth_value(rows, "seq", n, width).collect() == []
