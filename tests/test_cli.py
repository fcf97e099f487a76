"""The commands one after the other, as an operator would use them."""

import json

from tidemark.__main__ import parser, run
from tidemark.plans.store import Store
from tidemark.sources.files import read_control_csv, read_metrics_csv


def test_commands(spark, tmp_path, capsys):
    def call(*words):
        run(spark, parser().parse_args(list(map(str, words))))
        return capsys.readouterr().out

    root = tmp_path / "root"
    store = Store(spark, str(root))
    call("seed", "--root", root, "--records", 300)
    assert store.principal().count() == 300

    call("changes", "--root", root, "--ingestion-size", 100, "--output", tmp_path / "changes")
    call("ingest", "--root", root, "--input", tmp_path / "changes")
    assert store.pending().count() == 100
    call("merge", "--root", root, "--metrics-csv", tmp_path / "csv")
    metrics = read_metrics_csv(spark, str(tmp_path / "csv")).collect()
    assert [(m.inserted, m.updated, m.total_processed) for m in metrics] == [(40, 60, 100)]
    assert store.principal().count() == 340

    call(
        "generate", "--root", root, "--files", 3, "--records-per-file", 50, "--unique",
        "--output", tmp_path / "made", "--control", tmp_path / "control",
    )
    control = read_control_csv(spark, str(tmp_path / "control"))
    assert control.select("account_id", "asset_id", "reference_date").distinct().count() == 150

    # Two of the three files arrive by notification, the third by the stream.
    parts = sorted(str(p) for p in (tmp_path / "made").rglob("*.parquet"))
    keep = [p for p in parts if "file_number=2" not in p]
    lines = [
        json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": p}}}]}) for p in keep
    ]
    (tmp_path / "messages.txt").write_text("\n".join(lines))
    from tidemark import __main__ as cli

    original = cli.notified_files
    try:
        # The bucket of a local test is the file system itself.
        cli.notified_files = lambda m: original(m).selectExpr("concat('file:', key) as source_file")
        call("ingest", "--root", root, "--notifications", tmp_path / "messages.txt")
    finally:
        cli.notified_files = original
    assert store.pending().count() == 100
    call("follow", "--root", root, "--input", tmp_path / "made", "--checkpoint", tmp_path / "cp")
    assert store.pending().count() == 150
    call(
        "merge", "--root", root, "--continuous", "--checkpoint", tmp_path / "cp2",
        "--delay", 0.1, "--max-iterations", 1,
    )
    assert store.pending().count() == 0
    call("merge", "--root", root, "--metrics-csv", tmp_path / "csv")
    assert [m.total_processed for m in read_metrics_csv(spark, str(tmp_path / "csv")).collect()] == [100]
    assert "total_records" in call("report", "--root", root)
    assert "principal" in call("status", "--root", root)
    assert "ingest runs: [1, 2, 3]" in call("purge", "--root", root)
