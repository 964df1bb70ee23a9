"""The takeoff series, settings, logging, benchmark scenarios and the command line."""

import json
import logging
import math

import pytest

from flightlake import benchmark, cli
from flightlake import settings as S
from flightlake.sources import takeoff

IDS = {n: i for i, n in enumerate(takeoff.NAMES, 1)}


def test_takeoff_series(spark):
    points = takeoff.takeoff_series(spark, IDS, 120.0, 2)
    rows = {(r["timestamp_ns"], r["parameter_id"]): r["value"] for r in points.collect()}
    assert len(rows) == 2410 and max(t for t, _ in rows) == 120_000_000_000
    end, baro, n1 = 120_000_000_000, IDS["BaroAltitude"], IDS["Engine1_N1"]
    assert rows[0, baro] == 0 and rows[end, baro] == pytest.approx(9200)
    assert rows[0, n1] == 35 and rows[end, n1] == pytest.approx(88)
    assert min(v for (_, p), v in rows.items() if p == baro) == 0
    # At 45.5 s the profile, and the noise between the anchors at 42 and 48 s, by hand.
    def noise(k):
        x = (takeoff.NAMES.index("BaroAltitude") * 99991 + k * 7368787 + 1234577) % (2**31 - 1)
        return x * x % (2**31 - 1) * 48271 % (2**31 - 1) * 2 / (2**31 - 1) - 1

    left, right = noise(7), noise(8)
    spread = [noise(k) for k in range(20)]
    assert min(spread) < -0.5 and max(spread) > 0.5
    b, r = 45.5 / 6 - 7, 0.5 / 35
    expected = 900 + 2900 * r * r * (3 - 2 * r) + (left + (right - left) * b * b * (3 - 2 * b)) * 70
    assert rows[45_500_000_000, baro] == pytest.approx(expected)


def test_takeoff_limits(spark):
    assert takeoff.takeoff_series(spark, IDS, 0.5, 4).count() == 30  # 0, 0.25 and 0.5 s
    with pytest.raises(ValueError):
        takeoff.takeoff_series(spark, IDS, 0.0, 4)
    with pytest.raises(ValueError, match="IAS"):
        takeoff.takeoff_series(spark, {n: i for n, i in IDS.items() if n != "IAS"})


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\nHZ=4\nSTORAGE__FLUSH_MAX_ROWS='7'\nOTHER=1\n")
    got = S.load({"STORAGE__COMPACTION_MIN_TABLES": "9", "hz": "16", "INGEST__OVERFLOW_POLICY": "block"}, tmp_path / ".env")
    assert (got.hz, got.storage.flush_max_rows, got.storage.compaction_min_tables, got.ingest.overflow_policy) == (16, 7, 9, "block")
    assert S.load({}, tmp_path / "none") == S.Settings(S.DEFAULTS) != got and S.load({}, tmp_path / "none").ingest.batch_max_ms == 50
    with pytest.raises(AttributeError):
        got.other
    with pytest.raises(ValueError):
        S.load({"STORAGE__COMPACTION_MIN_TABLES": "1"}, tmp_path / "none")
    with pytest.raises(ValueError):
        S.load({"HZ": "fast"}, tmp_path / "none")


def test_logging(tmp_path):
    folder = S.set_up_logging(S.load({"DATA_DIR": str(tmp_path)}, tmp_path / "none"))
    logging.getLogger("flightlake.test").debug("quiet")
    logging.getLogger("flightlake.test").error("loud")
    assert "quiet" in (folder / "debug.log").read_text() and "quiet" not in (folder / "error.log").read_text()
    assert "loud" in (folder / "error.log").read_text()


def test_dataset_and_specs(spark):
    rows = benchmark.dataset(spark, 42, 64, 16, 8).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["row"], []).append(r["parameter_id"])
    assert len(sizes) == 64 and all(6 <= len(v) <= 10 and len(set(v)) == len(v) for v in sizes.values())
    assert {r["row"] for r in benchmark.dataset(spark, 42, 8, 2, 8).collect()} == set(range(8))
    assert len(benchmark.specs(128, 32, False)) == 12 and len(benchmark.specs(128, 32, True)) == 8
    assert benchmark.inclusive_percentile([1, 2, 3, 10], 0.5) == 2.5 and math.isclose(benchmark.inclusive_percentile([1, 2, 3, 10], 0.95), 8.95)
    assert benchmark.inclusive_percentile([], 0.5) == 0.0


def test_scenarios(spark, tmp_path):
    root = f"file://{tmp_path}"
    data = benchmark.dataset(spark, 1, 48, 8, 4).cache()
    n = data.count()
    one = benchmark.ingest_only(spark, root, data, 48)
    assert one["flush_count"] == 1 and one["bytes_written"] > 0
    asked = benchmark.queries(spark, root, data, 48, benchmark.specs(48, 8, False)[:3])
    assert asked["queries"] == 3 and asked["files_pruned"] > 0
    both = benchmark.mixed_read_write(spark, root, data, 48, benchmark.specs(48, 8, False)[:2], batches=2)
    assert both["failures"] == [] and both["queries"] == 2
    often = benchmark.frequent_flush_compact(spark, root, data, 48, batches=4, min_runs=2)
    assert often["compaction_count"] == 3 and often["live_points"] == n
    assert benchmark.cold_recovery_startup(spark, root, data, 48)["quarantined_runs"] == 0
    swept = benchmark.sweep(spark, root, data, 48, benchmark.specs(48, 8, False)[:2], [32, 64])
    assert swept["selected_block_max_points"] in (32, 64) and all(c["compaction_rewrite_bytes"] > 0 for c in swept["candidates"])
    data.unpersist()


def test_capture_and_selection(spark, tmp_path):
    got = benchmark.capture(spark, f"file://{tmp_path}", count=16, pool=8, per_frame=8, files=2)
    assert got["points_stored"] == got["points_expected"] == 128 and got["loss_rate"] == 0
    base = {"bytes_per_point": 9.0, "compaction_duration_ms": 1.0, "compaction_rewrite_bytes": 1}
    rows = [(128, 100.0, 5.0), (256, 95.0, 3.0), (512, 80.0, 1.0)]
    assert benchmark.select_block_size(spark, [{"block_max_points": b, "ingest_rows_per_sec": r, "narrow_latency_p95_ms": p} | base for b, r, p in rows]) == 256
    with pytest.raises(ValueError):
        benchmark.select_block_size(spark, [])
    assert json.loads(benchmark.report(got, tmp_path / "a" / "b.json")) == json.loads((tmp_path / "a" / "b.json").read_text())


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DATA_DIR", str(tmp_path / "data"))
    flt = tmp_path / "flt.json"
    entry = {"description": "", "unit": "u", "word": 1, "minor_frames": [1, 3], "hz": 2, "type": "float"}
    flt.write_text(json.dumps({"major_frame_sec": 1, "minor_frames": 4, "description": "", "layout": [entry | {"name": n, "parameter_id": i} for n, i in IDS.items()]}))
    store = ["--store", f"file://{tmp_path}/store"]
    assert cli.main([*store, "ingest", "--duration", "2", "--hz", "4", "--flt-file", str(flt), "--print-stats"]) == 0
    capsys.readouterr()
    assert cli.main([*store, "query", "--start-ts-ns", "0", "--end-ts-ns", "1000000000", "--parameter-ids", "1"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["plot-flight-live", "--samples-per-second", "1", "--flt-file", str(flt)]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 121 * 10 + 10
    assert cli.main(["plot-flight-demo", "--target-seconds", "2", "--flt-file", str(flt)]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 9 * 10 + 10
    assert cli.main(["printer", "--duration", "1", "--hz", "4", "--stress", "--flt-file", str(flt)]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 40

    window = ["--start-ts-ns", "0", "--end-ts-ns", "2000000000"]
    assert cli.main([*store, "aggregate", *window, "--parameter-ids", "1,77", "--output-csv", str(tmp_path / "a.csv")]) == 0
    lines = (tmp_path / "a.csv").read_bytes().split(b"\r\n")
    assert lines[0] == b"start_ts_ns,end_ts_ns,parameter_id,count,min,max,avg" and lines[1].startswith(b"0,2000000000,1,4,") and lines[2] == b"0,2000000000,77,0,,,"
    capsys.readouterr()
    assert cli.main([*store, "plot-flight", "--target-seconds", "5", "--flt-file", str(flt)]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 4 * 10 + 10
    assert cli.main([*store, "compact"]) == 0 and capsys.readouterr().out == "False\n"
    with pytest.raises(ValueError):
        cli.main([*store, "plot-flight", "--target-seconds", "0", "--flt-file", str(flt)])


def test_ids_of_the_command_line():
    assert cli.parse_ids(" ") is None and cli.parse_ids(",") == set() and cli.parse_ids("3, 1,3") == {1, 3}
    with pytest.raises(ValueError):
        cli.parse_ids("1,x")


def test_benchmark_commands(spark, tmp_path, capsys):
    report = tmp_path / "out" / "report.json"
    small = ["--parameter-pool", "4", "--output-json", str(report), "--block-max-points", "16"]
    assert cli.main(["benchmark", "--rows", "16", "--points-per-row", "2", "--sweep", "16", *small]) == 0
    assert "sweep: 16 points a block" in capsys.readouterr().out and json.loads(report.read_text())["narrow_query"]["queries"] == 12
    assert cli.main(["benchmark-capture", "--frames", "8", "--points-per-frame", "4", "--batch-max-rows", "4", *small]) == 0
    assert capsys.readouterr().out.startswith("8 frames: ") and json.loads(report.read_text())["loss_rate"] == 0
    assert cli.main(["benchmark-scale", "--rows", "8", "--parameter-pools", "4", "--output-json", str(report)]) == 0
    assert capsys.readouterr().out.startswith("pool 4: ingest ")
