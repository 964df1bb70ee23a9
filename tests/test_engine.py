"""The engine against literal expectations and against a model of last-write-wins."""

import json
import math
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlake import queries
from flightlake import settings as S
from flightlake.operators import batches
from flightlake.operators import points as P
from flightlake.operators import sequences as Q
from flightlake.plans.store import ManifestConflict, RunStore, StoreClosed
from flightlake.sources import export, layout
from flightlake.streaming import ingest

POINTS = "timestamp_ns long, parameter_id long, value double"


def df(spark, rows):
    """Points with their place in the list as arrival order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], POINTS + ", ordinal long")


def keyed(frame):
    return [tuple(r) for r in P.in_key_order(frame).collect()]


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, f"file://{tmp_path}/store", min_runs=3)


def test_newest_wins_over_runs(spark, store):
    store.append(df(spark, [(100, 1, 1.0), (100, 2, 2.0), (110, 1, 11.0)]))
    store.append(df(spark, [(100, 1, 10.0), (105, 3, 3.0)]))
    store.append(df(spark, [(100, 1, 100.0), (90, 4, 4.0), (105, 3, 30.0)]))
    assert keyed(store.query_range(0, 200)) == [(90, 4, 4.0), (100, 1, 100.0), (100, 2, 2.0), (105, 3, 30.0), (110, 1, 11.0)]
    assert keyed(store.query_range(95, 106, [1, 3])) == [(100, 1, 100.0), (105, 3, 30.0)]
    assert keyed(store.query_range(95, 106, [])) == [] and keyed(store.query_range(106, 95)) == []
    got = [tuple(r)[2:] for r in store.aggregate_range(95, 111, [1, 3, 9]).orderBy("parameter_id").collect()]
    assert got == [(1, 2, 11.0, 100.0, 55.5), (3, 1, 30.0, 30.0, 30.0), (9, 0, None, None, None)]


def test_last_write_wins_inside_a_run(spark, store):
    store.append(df(spark, [(100, 1, float(i)) for i in range(50)]))
    assert keyed(store.query_range(0, 200)) == [(100, 1, 49.0)]


def test_pruning_opens_one_run(spark, store):
    for t, i in ((10, 1), (20, 2), (30, 3)):
        store.append(df(spark, [(t, i, float(i))]))
    assert keyed(store.query_range(15, 25, [2])) == [(20, 2, 2.0)]
    assert (store.stats["files_considered"], store.stats["files_pruned"], store.stats["files_opened"]) == (3, 2, 1)


def test_filters_reach_the_scan(spark, store):
    for _ in range(2):  # runs that overlap, so their points are merged
        store.append(df(spark, [(10, 1, 1.0), (20, 2, 2.0)]))
    plan = store.query_range(0, 15, [1, 2])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp_ns,0)" in plan and "In(parameter_id, [1,2])" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_compaction_and_old_readers(spark, store):
    for rows in ([(100, 1, 1.0), (100, 2, 2.0)], [(100, 1, 10.0), (110, 3, 3.0)], [(90, 4, 4.0)], [(110, 3, 30.0), (120, 5, 5.0)]):
        store.append(df(spark, rows))
    want, old = keyed(store.query_range(0, 200)), store.query_range(0, 200)
    assert store.compact() and not store.compact()
    assert want == keyed(store.query_range(0, 200)) == keyed(old) == [(90, 4, 4.0), (100, 1, 10.0), (100, 2, 2.0), (110, 3, 30.0), (120, 5, 5.0)]
    runs = store.manifest()["runs"]
    assert [r["run_id"] for r in runs] == [5] and runs[0]["rows_count"] == 4
    assert store.vacuum() == [] and len(store.vacuum(retention_s=0)) == 4 and keyed(store.query_range(0, 200)) == want


def test_store_follows_a_model(spark, store):
    rng, model = random.Random(5), {}
    for step in range(6):
        rows = [(rng.randrange(20), rng.randrange(4), float(rng.randrange(1000))) for _ in range(30)]
        store.append(df(spark, rows))
        model |= {r[:2]: r[2] for r in rows}
        if step == 3:
            store.compact()
    assert keyed(store.query_range(0, 20)) == [(*k, v) for k, v in sorted(model.items())]


def test_closed_bad_ids_and_idempotent_batches(spark, store):
    with pytest.raises(ValueError):
        store.append(df(spark, [(1, 1 << 32, 1.0)]))
    assert not store.append(df(spark, [(1, 1, 1.0)]).limit(0))
    assert store.append(df(spark, [(1, 1, 1.0)]), batch_id=4) and not store.append(df(spark, [(1, 1, 2.0)]), batch_id=4)
    assert keyed(store.query_range(0, 9)) == [(1, 1, 1.0)]
    store.close()
    store.close()
    with pytest.raises(StoreClosed):
        store.query_range(0, 1)
    with pytest.raises(ValueError):
        RunStore(spark, store.root, min_runs=1)


def test_recovery(spark, store, tmp_path):
    store.append(df(spark, [(1, 1, 1.0)]))
    store.append(df(spark, [(2, 1, 2.0)]))
    home = tmp_path / "store"
    (home / "runs" / "run_id=99" / "write=x1").mkdir(parents=True)
    (home / "runs" / ".staged-x").mkdir()
    store.recover()
    assert sorted(p.name for p in (home / "quarantine").iterdir() if not p.name.endswith(".crc")) == ["run_id=99-write=x1.orphan", "staged-x.orphan"]
    newest = max(home.glob("manifest/v*.json"))
    newest.write_text("{bad json")
    for crc in home.glob("manifest/.*.crc"):
        crc.unlink()
    assert keyed(store.query_range(0, 9)) == [(1, 1, 1.0)]  # the version before
    for p in home.glob("manifest/v*.json"):
        p.write_text("{bad json")
    assert len(store.recover()["runs"]) == 2 and store.stats["manifest_rebuild_count"] == 1
    assert keyed(store.query_range(0, 9)) == [(1, 1, 1.0), (2, 1, 2.0)]


def test_nan_rules(spark):
    nan = float("nan")
    rows = df(spark, [(1, 1, nan), (2, 1, 5.0), (1, 2, 3.0), (2, 2, nan), (3, 2, 1.0)])
    a, b = P.aggregate_points(rows, 0, 9).orderBy("parameter_id").collect()
    assert math.isnan(a["min"]) and math.isnan(a["max"]) and (b["min"], b["max"]) == (1.0, 3.0) and math.isnan(b["avg"])


def test_frames_normalise_and_gaps(spark):
    good = {"IAS": ("1", "123.4"), "TAS": ("2", "456.7")}
    rows = [("10", 1.25, good), ("12", 1.5, {}), ("oops", 1.75, {"a": ("oops", "nan?")}), ("13", None, {"a": ("7", "1"), "b": ("oops", "2")}), ("13", 1700000000.125, {"a": ("-1", "1")})]
    frames = spark.createDataFrame([(i, "s", *r) for i, r in enumerate(rows)], "at int, source string, seq string, ts_monotonic double, values map<string, struct<parameter_id: string, value: string>>")
    from pyspark.sql import functions as F

    got = [(r["timestamp_ns"], [tuple(c) for c in r["columns"]]) for r in P.normalise_frames(frames, F.lit(42.5)).orderBy("at").collect()]
    assert got == [(1_250_000_000, [(1, 123.4), (2, 456.7)]), (42_500_000_000, [(7, 1.0)])]
    assert tuple(Q.sequence_gaps(frames, "source", "at").first()) == ("s", 2, 13)


def test_blocks_and_batches(spark):
    rows = spark.createDataFrame([(1, t) for t in (100, 100, 110, 120, 130)] + [(2, t) for t in (100, 100, 100, 101)], "run_id int, timestamp_ns long")
    got = {tuple(r)[:2]: r["block_id"] for r in Q.assign_blocks(rows, 2).collect()}
    assert got == {(1, 100): 0, (1, 110): 1, (1, 120): 1, (1, 130): 2, (2, 100): 0, (2, 101): 1}
    frames = spark.createDataFrame([("s", i, n) for i, n in enumerate((3, 3, 5, 1, 1, 1))], "source string, at int, n int")
    fold = [r["batch_id"] for r in Q.ingest_batches(frames, "source", "at", "n", 3, 6).orderBy("at").collect()]
    assert fold == [0, 0, 1, 1, 2, 2]


def test_layout(spark, tmp_path):
    entry = {"name": "IAS", "description": "", "parameter_id": 1, "unit": "kt", "word": 1, "minor_frames": [1, 1, 4, 4], "hz": 4, "type": "float"}
    data = {"major_frame_sec": 1, "minor_frames": 4, "description": "x", "layout": [entry]}

    def load(d):
        (tmp_path / "f.json").write_text(json.dumps(d))
        return layout.read_layout(spark, str(tmp_path / "f.json"))

    from pyspark.sql import functions as F

    assert load(data).select(layout.ticks(F.col("minor_frames"), F.col("minor_frame_count"), 8).alias("t")).first()["t"] == [1, 7]
    assert load(data | {"layout": []}).count() == 0
    for bad in (data | {"extra": 1}, data | {"layout": [entry | {"x": 1}]}, data | {"layout": {}}, {"major_frame_sec": 1}):
        with pytest.raises((TypeError, KeyError)):
            load(bad)
    with pytest.raises(Exception, match="within 1"):
        load(data | {"layout": [entry | {"minor_frames": [5]}]}).select(layout.ticks(F.col("minor_frames"), F.col("minor_frame_count"), 8)).collect()
    frames = layout.generate_frames(spark, load(data), 80, 8).collect()
    assert {r["tick"] for r in frames} == {1, 7} and all(0 <= r["value"] <= 1000 for r in frames)


def test_csv(spark, tmp_path):
    export.write_points_csv(df(spark, [(101, 1, -3.25), (100, 2, 10.5)]), tmp_path / "p.csv")
    assert (tmp_path / "p.csv").read_bytes() == b"timestamp_ns,parameter_id,value\r\n100,2,10.5\r\n101,1,-3.25\r\n"
    agg = P.aggregate_points(df(spark, [(100, 1, 1.0), (110, 1, 3.0)]), 100, 120, [1, 3])
    assert sorted(export.lines(agg)) == ["100,120,1,2,1.0,3.0,2.0", "100,120,3,0,,,"]


def test_streaming_ingest_restarts_without_repeats(spark, store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    frame = lambda seq, ts, v: json.dumps({"seq": seq, "ts_monotonic": ts, "values": v})
    (source / "a.json").write_text(frame("0", 1.0, {"IAS": {"parameter_id": "1", "value": "5"}}) + "\n" + frame("1", 1.25, {}) + "\n")
    seen = []
    for name in (None, "b.json"):
        if name:
            (source / name).write_text(frame("2", 1.5, {"IAS": {"parameter_id": "1", "value": "6"}}) + "\n")
        q = ingest.ingest(ingest.read_frames(spark, str(source)), store, str(tmp_path / "cp"), seen.append)
        q.awaitTermination(60)
        assert q.exception() is None
    assert keyed(store.query_range(0, 10**10)) == [(1_000_000_000, 1, 5.0), (1_500_000_000, 1, 6.0)]
    assert [s["frames_in"] for s in seen] == [2, 1] and store.manifest()["last_seq"] == 2
    for name, seqs in (("c.json", ("4", "6", "x")), ("d.json", ("7",))):  # a gap between batches, one inside, none
        (source / name).write_text("".join(frame(s, 2.0, {}) + "\n" for s in seqs))
        ingest.ingest(ingest.read_frames(spark, str(source)), store, str(tmp_path / "cp"), seen.append).awaitTermination(60)
    assert [s["seq_gaps"] for s in seen] == [0, 0, 2, 0] and store.manifest()["last_seq"] == 7


def test_gaps_in_order(spark):
    for seqs in ([], ["5"], ["1", "2", "3"], ["3", "1", "1", "2", "oops", None, "9", "9", "10"], ["-1", "0", "4"]):
        frames = spark.createDataFrame([("s", s) for s in seqs], "source string, seq string")
        got = Q.gaps_in_order(frames).first()
        numbers = sorted(int(s) for s in seqs if s and s != "oops")
        want = sum(b != a + 1 for a, b in zip(numbers, numbers[1:]))
        assert tuple(got) == (want, min(numbers, default=None), max(numbers, default=None))


def test_blocks_of_runs(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/blocks", min_runs=2, block_points=4)
    store.append(df(spark, [(t, p, 1.0) for t in range(10) for p in (1, 2)]).coalesce(1))
    blocks = store.inspect(1)
    assert sum(b["point_count"] for b in blocks) == 20 and all(b["point_count"] <= 4 for b in blocks)
    got = store.block_counters(0, 2, [1])
    assert got["files_opened"] == 1 and got["blocks_pruned"] > 0 and 4 <= got["points_decoded"] < 20
    assert store.block_counters(50, 60)["files_pruned"] == 1 and store.block_counters(0, 60, [])["blocks_scanned"] == 0
    m = store.manifest()
    store._commit(m, runs=[m["runs"][0] | {"point_count": 21}])
    with pytest.raises(ValueError, match="point_count"):
        store.inspect(1)


def test_blocks_cost_no_call_each(spark, tmp_path, monkeypatch):
    """Calls to the JVM grow with files, not with blocks; empty stores and files without points have no blocks."""
    rows, calls = spark.range(3000).selectExpr("id timestamp_ns", "id % 3 parameter_id", "1.0D value"), {}
    send = type(spark.sparkContext._gateway._gateway_client).send_command
    for points in (1000, 10):
        store = RunStore(spark, f"file://{tmp_path}/each{points}", min_runs=2, block_points=points)
        assert store.blocks().count() == 0
        store.append(rows.coalesce(1))
        store.append(rows.filter("id = 7").coalesce(1))
        count = []
        with monkeypatch.context() as patch:
            patch.setattr(type(spark.sparkContext._gateway._gateway_client), "send_command", lambda *a, **k: count.append(1) or send(*a, **k))
            blocks = store.inspect(1)
        calls[points] = len(count)
        assert [(b["block"], b["point_count"]) for b in blocks] == [(i, points) for i in range(3000 // points)]
        assert [(b["min_timestamp_ns"], b["max_timestamp_ns"]) for b in blocks] == [(i * points, i * points + points - 1) for i in range(3000 // points)]
        assert {(b["min_parameter_id"], b["max_parameter_id"]) for b in blocks} == {(0, 2)} and all(b["bytes"] > 0 for b in blocks)
        assert sorted(tuple(r) for r in store.blocks().select("run_id", "block", "point_count").collect()) == [*((1, i, points) for i in range(3000 // points)), (2, 0, 1)]
    assert calls[10] < calls[1000] + 50, calls


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.queries()) <= set(e.queries())


def test_contract_without_corpus_operators(tmp_path):
    """In a copy of the repository without them, and with a folder that only holds leftovers."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "flightlake", tmp_path / "flightlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, flightlake.queries as q; assert set(e.queries()) == set(q.queries()) and set(e.oracle_sql()) == set(q.oracle_sql())"
    for leftovers in (False, True):
        if leftovers:
            (tmp_path / "flightlake/llm/__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_gaps_in_order_query_reads_all_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    frames = queries._gap_frames(spark, "/root/testdata/sf0.001")
    assert frames.count() == events.count() and frames.filter("seq = 'oops'").count() == events.filter("event_id % 11 = 0").count() > 0


def test_fold_query_closes_by_rows_and_by_points(spark):
    path = "/root/testdata/sf0.001"
    sizes, want = {}, {}
    for r in spark.read.parquet(f"{path}/lineitem.parquet").groupBy("l_orderkey").count().orderBy("l_orderkey").collect():
        sizes.setdefault(r["l_orderkey"] % 64, []).append(r["count"])
    closed = set()
    for source, every in sizes.items():
        batch = rows = points = 0
        for n in every:
            rows, points = rows + 1, points + n
            want[source, batch] = rows
            if rows >= queries.FOLD_ROWS or points >= queries.FOLD_POINTS:
                closed.add("points" if points >= queries.FOLD_POINTS else "rows")
                batch, rows, points = batch + 1, 0, 0
    got = {(r["source"], r["batch_id"]): r["rows"] for r in queries.QUERIES["batch_fold_limits"](spark, path).collect()}
    assert got == want and closed == {"rows", "points"}


def test_a_crash_before_the_commit_loses_nothing(spark, store, monkeypatch):
    store.append(df(spark, [(1, 1, 1.0)]))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.append(df(spark, [(2, 1, 111.0)]))
    assert store.append(df(spark, [(2, 1, 2.0), (3, 1, 3.0)])) and store.manifest()["runs"][-1]["point_count"] == 2
    assert keyed(store.query_range(0, 9)) == [(1, 1, 1.0), (2, 1, 2.0), (3, 1, 3.0)]
    assert len(store._run_folders()) == 3
    store.recover()
    assert store.stats["quarantined_runs"] == 1 and len(store._run_folders()) == 2 and keyed(store.query_range(0, 9))[1] == (2, 1, 2.0)


def test_writers_meet(spark, store):
    other = RunStore(spark, store.root, min_runs=2)
    held = store.manifest()
    assert other.append(df(spark, [(1, 1, 1.0)]))
    with pytest.raises(ManifestConflict):
        store._commit(held, last_seq=3)
    # The first look at the manifest is stale: the run moves to the next id and the batch is committed on top.
    looks = [held]
    real = store.manifest
    store.manifest = lambda: looks.pop() if looks else real()
    assert store.append(df(spark, [(1, 1, 2.0)]), batch_id=1) and store.stats["commit_conflicts"] == 1
    store.manifest = real
    assert [r["run_id"] for r in store.manifest()["runs"]] == [1, 2] and keyed(store.query_range(0, 9)) == [(1, 1, 2.0)]
    looks = [held]
    store.manifest = lambda: looks.pop() if looks else real()
    assert not store.append(df(spark, [(1, 1, 9.0)]), batch_id=1)  # another writer has committed this batch
    store.manifest = real
    assert keyed(store.query_range(0, 9)) == [(1, 1, 2.0)] and len(store._run_folders()) == 2
    looks = [other.manifest() | {"version": 1}]
    other.manifest = lambda: looks[0]
    assert not other.compact() and keyed(store.query_range(0, 9)) == [(1, 1, 2.0)]


def test_a_root_without_a_scheme(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/plain/", min_runs=2)
    assert store.append(df(spark, [(1, 1, 1.0)])) and store.append(df(spark, [(1, 1, 2.0)])) and store.compact()
    assert keyed(RunStore(spark, f"{tmp_path}/plain").query_range(0, 9)) == [(1, 1, 2.0)] and store.inspect(3)[0]["point_count"] == 1


def test_commit_after_broken_manifests(spark, store, tmp_path):
    store.append(df(spark, [(1, 1, 1.0)]))
    (tmp_path / "store/manifest/v2.json").write_text("{bad json")
    assert store.append(df(spark, [(2, 1, 2.0)])) and store.manifest()["version"] == 3
    assert keyed(store.query_range(0, 9)) == [(1, 1, 1.0), (2, 1, 2.0)]


def test_vacuum_keeps_what_manifests_name(spark, store, tmp_path):
    for t in range(4):
        store.append(df(spark, [(t, 1, float(t))]))
    store.compact()
    assert store.vacuum() == [] and len(store._versions()) == 5
    assert len(store.vacuum(keep_versions=2, retention_s=0)) == 0 and store._versions() == [4, 5]  # the fourth names the old runs
    assert len(store.vacuum(retention_s=0)) == 4 and store._versions() == [5]
    (tmp_path / "store/manifest/v6.json").write_text("{bad json")
    assert store.vacuum(retention_s=0) == [] and keyed(store.query_range(0, 9)) == [(t, 1, float(t)) for t in range(4)]


def test_widths_and_nulls_are_refused(spark, store):
    wide = spark.createDataFrame([(1, 1, 1.0, 1 << 40)], POINTS + ", ordinal long")
    for bad in (wide, df(spark, [(1, None, 1.0)]), df(spark, [(1, -1, 1.0)]), wide.withColumn("ordinal", wide["ordinal"] * -1)):
        with pytest.raises(ValueError):
            store.append(bad)
    assert store.manifest()["runs"] == [] and store._run_folders() == {}
    with pytest.raises(Exception, match="too large"):
        P.newest_wins(spark.createDataFrame([(1, 1, 1.0, 1 << 41, 1), (1, 1, 2.0, 0, 2)], POINTS + ", ordinal long, run_id long")).collect()


def test_order_and_counters(spark, store):
    store.append(df(spark, [(t, p, 1.0) for t in (5, 3, 4) for p in (2, 1)]).repartition(4))
    seen = store.query_range(0, 9)
    assert [tuple(r)[:2] for r in seen.collect()] == [(t, p) for t in (3, 4, 5) for p in (1, 2)]
    assert seen._jdf.queryExecution().toString().count("Exchange rangepartitioning") <= 2
    frame, watch = store.observed_range(0, 5)
    assert frame.count() == 4 and store.note(watch) == 4 == store.stats["points_returned"]
    assert store.stats["flush_bytes"] == store.stats["bytes_written"] > 0 and store.manifest()["runs"][0]["rows_count"] == 3
    store.recover()
    assert store.stats["recovery_ms"] > 0


def test_a_time_that_is_no_number_drops_its_frame(spark):
    nan = float("nan")
    frames = spark.createDataFrame([(str(i), t, {"a": ("1", "2")}) for i, t in enumerate((nan, 1e300, -float("inf"), 2.0))], "seq string, ts_monotonic double, values map<string, struct<parameter_id: string, value: string>>")
    assert [r["timestamp_ns"] for r in P.normalise_frames(frames).collect()] == [2_000_000_000]
    got = ingest.commit_batch(None, frames, 0)
    assert (got["frames_in"], got["rows_out"], got["points_out"], got["dropped_frames"], got["seq_gaps"]) == (4, 1, 1, 3, 0)


def test_arrival_decides_between_equal_keys_and_gaps(spark, store):
    from pyspark.sql import functions as F

    values = lambda v: {"a": ("1", str(v))}
    rows = [("10", 1.0, values(1), 3), ("10", 1.0, values(2), 4), ("9", 1.0, values(3), 5), (None, 1.0, values(4), 6), ("oops", 1.0, values(5), 2), (None, 2.0, None, 1)]
    schema = "seq string, ts_monotonic double, values map<string, struct<parameter_id: string, value: string>>, arrival_block long"
    frames = spark.createDataFrame(rows, schema).repartition(4).withColumns({"arrival_time": F.lit(0), "arrival_file": F.lit("f")})
    got = ingest.commit_batch(store, frames, 0)
    assert (got["seq_gaps"], store.manifest()["last_seq"], got["dropped_frames"]) == (2, 9, 0)
    assert keyed(store.query_range(0, 10**10)) == [(1_000_000_000, 1, 4.0)]
    line = ingest.Statistics().line(got, 2.0)
    assert "frames_in=6 (+3.0/s)" in line and "seq_gaps=2" in line


def test_gaps_at_the_ends_of_bigint(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    frames = spark.createDataFrame([(i, "s", str(x)) for i, x in enumerate((top - 1, top, low, low + 1))], "at int, source string, seq string")
    assert tuple(Q.sequence_gaps(frames, "source", "at").first()) == ("s", 1, low + 1)
    assert Q.gaps_in_order(frames).first()["seq_gaps"] == 1


def plain_batches(rows, limits):
    """(batch of each row) of (rows, size, time), one after the other."""
    out, batch, r, s, began = [], 0, 0, 0, None
    for n, size, t in rows:
        if began is not None and limits.age > 0 and t - began >= limits.age:
            batch, r, s, began = batch + 1, 0, 0, None
        out.append(batch)
        began = t if began is None else began
        r, s = r + n, s + size
        if (limits.rows > 0 and r >= limits.rows) or (limits.size > 0 and s >= limits.size):
            batch, r, s, began = batch + 1, 0, 0, None
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 5)), max_size=60), st.integers(0, 6), st.integers(0, 15), st.integers(0, 12), st.integers(1, 9))
def test_batches_in_buckets_match_one_pass(steps, max_rows, max_size, max_age, width):
    limits, t, rows = batches.Limits(max_rows, max_size, max_age), 0, []
    for n, size, dt in steps:
        t += dt
        rows.append((n, size, t))
    got, begin, batch = [], batches.Open(), 0
    for k in range(0, len(rows), width):
        bucket = batches.Bucket(*(np.array(x, np.int64) for x in zip(*rows[k : k + width])), limits)
        numbers = bucket.numbers(begin)
        got += (numbers + batch).tolist()
        begin, closed = batches.follow(batches.summary(bucket), begin, limits)
        batch += closed
    assert got == plain_batches(rows, limits)


def test_long_streams_are_cut(spark, monkeypatch):
    from flightlake.operators import ranges

    monkeypatch.setattr(batches, "BUCKET_ROWS", 40)
    monkeypatch.setattr(ranges, "BUCKET_ROWS", 40)
    rng = random.Random(3)
    rows = [(s, i * i + i, rng.randrange(4)) for s in ("a", None, "hot") for i in range(300 if s == "hot" else 20)]
    frame = spark.createDataFrame(rows, "s string, o long, n long").repartition(5)
    limits = batches.Limits(7, 9, 0)
    got = {(r["s"], r["o"]): r["b"] for r in batches.greedy_groups(frame, "s", "o", "n", limits, "b").collect()}
    for s in ("a", None, "hot"):
        own = [(o, n) for t, o, n in rows if t == s]
        assert [got[s, o] for o, _ in own] == plain_batches([(1, n, 0) for _, n in own], limits)
    before = {(r["s"], r["o"]): r["p"] for r in ranges.with_previous(frame, ["s"], ["o"], "n", "p").collect()}
    place = {(r["s"], r["o"]): r["k"] for r in ranges.with_row_number(frame, ["s"], ["o"], "k").collect()}
    for s in ("a", None, "hot"):
        own = [(o, n) for t, o, n in rows if t == s]
        assert [before[s, o] for o, _ in own] == [None, *[n for _, n in own[:-1]]]
        assert [place[s, o] for o, _ in own] == list(range(1, len(own) + 1))
    sizes = frame.withColumn("b", ranges.bucket_of(frame, "o", 40)).groupBy("b").count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 120
    assert batches.greedy_groups(frame.limit(0), "s", "o", "n", limits).count() == 0


def test_blocks_of_a_long_run(spark):
    from pyspark.sql import functions as F

    points = spark.range(1_000_000).select(F.lit(1).alias("run_id"), F.col("id").alias("timestamp_ns"))
    got = Q.assign_blocks(points, 256).groupBy("block_id").count().agg(F.count(F.lit(1)), F.max("count"), F.max("block_id")).first()
    assert tuple(got) == (3907, 256, 3906)


def test_plot_of_ten_parameters(spark):
    from flightlake.plans import plot

    ids = {"IAS": (200, 220), "TAS": (210, 225), "BaroAltitude": (0, 5000), "RadioAltitude": (50, 4800), "VerticalSpeed": (-500, 1500), "PitchAngle": (-3, 5), "RollAngle": (-10, 15), "YawAngle": (2, 8), "Engine1_N1": (70, 92), "GroundSpeed": (205, 230)}
    named = spark.createDataFrame([(k * 1_000_000_000, n, float(v)) for n, vs in ids.items() for k, v in enumerate(vs)], "timestamp_ns long, name string, value double")
    got = {}
    for r in plot.scaled_series(named, 1.0).orderBy("seconds").collect():
        got.setdefault(r["name"], []).append(r["display_y"])
    assert len(got) == 10 and got["BaroAltitude"] == [0.0, 10_000.0] and got["IAS"] == pytest.approx([1300.0, 2433.333333333333]) and got["Engine1_N1"] == [8500.0, 9700.0]
    guides = {}
    for r in plot.guides(named, 1.0).orderBy("band", "fraction").collect():
        guides.setdefault(r["title"], []).append((r["series"], r["fraction"], r["tick_value"], r["label"]))
    assert set(guides) == {"Altitude", "Speed", "VSpeed", "Attitude", "Engine N1"}
    assert guides["Speed"] == [("IAS\nTAS\nGround speed", 0.0, 200.0, "200"), ("IAS\nTAS\nGround speed", 0.5, 215.0, "215")]
    assert guides["Altitude"] == [("", 0.0, 0.0, "0"), ("", 0.5, 250.0, "250")]
    flat = named.filter("name <> 'GroundSpeed'").withColumn("value", named["value"] * 0 + 1e12)
    assert [r["fraction"] for r in plot.guides(flat, 1.0).filter("band = 'speed'").collect()] == [0.5]  # 1e12 and half more are nearly equal
    with pytest.raises(ValueError, match="positive"):
        plot.check(named, list(ids), 0, list(ids))
    with pytest.raises(ValueError, match="Mach"):
        plot.check(named, list(ids), 1.0, ["Mach"])
    with pytest.raises(ValueError, match="points"):
        plot.check(named.limit(0), list(ids), 1.0, [])
    with pytest.raises(ValueError, match="altitude"):
        plot.check(named.filter("name = 'IAS'"), list(ids), 1.0, [])


def test_broken_aggregates_are_found(spark):
    schema = "parameter_id long, count long, min double, max double, avg double"
    rows = [(1, 0, None, None, None), (2, 1, 1.0, 1.0, 1.0), (3, 0, 1.0, None, None), (4, 2, None, 1.0, 1.0), (5, -1, None, None, None)]
    assert sorted(r["parameter_id"] for r in P.broken_aggregates(spark.createDataFrame(rows, schema)).collect()) == [3, 4, 5]
    assert P.broken_aggregates(P.aggregate_points(df(spark, [(1, 1, 1.0)]), 0, 9, [1, 2])).isEmpty()


def test_replay_follows_queue_and_flush_limits(spark, store):
    frames = layout.whole_frames(spark, queries._layout(spark), 40, 8)
    conf = lambda **k: S.Settings(S.DEFAULTS | k)
    got = ingest.replay(store, frames, conf(storage__flush_max_rows=10, ingest__batch_max_ms=0, ingest__batch_max_rows=5))
    filled = frames.filter("size(values) > 0").count()
    assert got["frames_in"] == 40 and got["rows_out"] == filled and got["dropped_frames"] == 0 and len(store.manifest()["runs"]) == -(-filled // 10)
    assert store.query_range(0, 1 << 62).count() == got["points_out"]
    few = RunStore(spark, store.root + "2")
    got = ingest.replay(few, frames, conf(ingest__queue_max_frames=1))
    assert (got["frames_in"], got["dropped_frames"]) == (5, 35)


def test_runs_apart_need_no_merge(spark, store, monkeypatch):
    from flightlake.plans import store as module

    store.append(df(spark, [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 3.0)]))
    store.append(df(spark, [(3, 1, 4.0), (4, 1, 5.0)]))
    assert [r["unique"] for r in store.manifest()["runs"]] == [True, True]
    for small in (module.SMALL_READ, 0):
        monkeypatch.setattr(module, "SMALL_READ", small)
        plan = store.query_range(0, 9)
        assert "Aggregate" not in plan._jdf.queryExecution().toString() and keyed(plan) == [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 3.0), (3, 1, 4.0), (4, 1, 5.0)]
    store.append(df(spark, [(4, 1, 6.0), (4, 1, 7.0)]))
    assert store.manifest()["runs"][2]["unique"] is False
    for small in (1 << 20, 0):
        monkeypatch.setattr(module, "SMALL_READ", small)
        assert [tuple(r) for r in store.query_range(0, 9).collect()][-2:] == [(3, 1, 4.0), (4, 1, 7.0)]
        assert store.aggregate_range(0, 9).orderBy("parameter_id").first()["max"] == 7.0
