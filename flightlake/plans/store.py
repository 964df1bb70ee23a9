"""A store of immutable sorted Parquet runs under versioned manifests.

``runs/run_id=N/write=x...`` (N in 20 digits) holds a run: every attempt to write one has a
folder of its own, and only what a manifest names is ever read, so what a crash leaves
behind is never taken for a run. ``manifest/v{M}.json`` is what a commit made visible; it appears whole, by a
rename that fails if the name is taken, so two writers cannot both commit a version, and the
later one tries again on top of the other. Compaction writes a new run, commits, and leaves
the old runs to ``vacuum``, so readers of older manifests lose nothing. All files go through
Hadoop's file system, so any store that Spark reads and that renames atomically will do.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from flightlake.operators import points as P
from flightlake.schemas import MAX_PARAMETER_ID, VERSIONED, VERSIONED_COLUMNS

#: Input that the optimiser knows to be no larger than this is sorted by one task, without sampling it for ranges first;
#: so are runs that a query reads if their files are no larger in all.
SMALL_BYTES, SMALL_READ = 16 << 20, 4 << 20
#: Times that a commit is tried again after another writer's.
ATTEMPTS = 20
#: ``vacuum`` spares what is younger: runs of writers at work, and manifests that readers may hold.
RETENTION_SECONDS = 3600.0


class StoreClosed(RuntimeError):
    pass


class ManifestConflict(RuntimeError):
    """Another writer has published a manifest since this one's was read."""


def _may_hold(zone: dict, start_ns: int, end_ns: int, ids: list[int] | None) -> bool:
    """A run's or block's zone map does not rule it out; ``ids`` is sorted."""
    if zone["max_timestamp_ns"] < start_ns or zone["min_timestamp_ns"] >= end_ns:
        return False
    if ids is None:
        return True
    at = bisect_left(ids, zone["min_parameter_id"])
    return at < len(ids) and ids[at] <= zone["max_parameter_id"]


def _numbered(run_id: int) -> str:
    """Names sort as ids do."""
    return f"run_id={run_id:020d}"


def _folder(run: dict) -> str:
    return run.get("folder", f"run_id={run['run_id']}")


#: What a footer says of a block (row group).
BLOCK = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("point_count", pa.int64()), ("bytes", pa.int64()),
    *((f"{f}_{k}", pa.int64()) for k in ("timestamp_ns", "parameter_id") for f in ("min", "max")),
])


def _footer_blocks(name: str, footer: bytes) -> pa.Table:
    """The blocks that hold points of the file that ends in ``footer``; no call to the JVM for any of them."""
    said, rows = pq.read_metadata(pa.BufferReader(footer)), []
    names = said.schema.names
    ranged = [names.index(k) for k in ("timestamp_ns", "parameter_id")]
    for at in range(said.num_row_groups):
        block = said.row_group(at)
        if not block.num_rows:
            continue
        columns = [block.column(j) for j in range(len(names))]
        ranges = [x for j in ranged for s in [columns[j].statistics] for x in ((s.min, s.max) if s is not None and s.has_min_max else (None, None))]
        rows.append((name, at, block.num_rows, sum(c.total_compressed_size for c in columns), *ranges))
    return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * len(BLOCK), BLOCK)], schema=BLOCK)


class RunStore:
    """Append, query, aggregate, compact and recover; counters of the session in ``stats``."""

    def __init__(self, spark: SparkSession, root: str, min_runs: int = 4, block_points: int | None = None):
        """``block_points`` bounds the points of a row group; without it, Parquet's own size holds."""
        if min_runs < 2:
            raise ValueError("compaction needs at least two runs")
        if block_points is not None and block_points < 1:
            raise ValueError("a block holds at least one point")
        self.spark, self.root, self.min_runs, self.closed, self.block_points = spark, root.rstrip("/"), min_runs, False, block_points
        counters = (
            "files_considered", "files_pruned", "files_opened", "points_returned", "flush_count", "flush_points", "flush_bytes", "bytes_written",
            "compaction_count", "compaction_points", "compaction_bytes", "commit_conflicts", "recovery_ms", "quarantined_runs", "manifest_rebuild_count",
        )
        self.stats = dict.fromkeys(counters, 0)
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("runs", "manifest", "quarantine"):
            self._fs.mkdirs(self._path(d))

    # files
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, folder: str) -> list:
        return sorted(self._fs.listStatus(self._path(folder)), key=lambda s: s.getPath().getName())

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._list(folder)]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> None:
        """A whole file or none; raises ``ManifestConflict`` if it exists."""
        temp = f"manifest/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temp), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self._jvm.java.lang.reflect.Array.set(none, 0, kind.getEnumConstants()[0])  # NONE: never over an existing file
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(self._path(temp)), self._fs.makeQualified(self._path(name)), none)
        except Py4JJavaError as e:
            self._fs.delete(self._path(temp), False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise ManifestConflict(name) from None
            raise

    # manifests
    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def _load(self, version: int) -> dict | None:
        """The manifest of a version, None if it is broken or gone."""
        try:
            return self._valid(json.loads(self._read(f"manifest/v{version}.json")))
        except (ValueError, KeyError, TypeError):
            return None
        except Py4JJavaError as e:
            if "FileNotFoundException" in e.java_exception.getClass().getName() or "ChecksumException" in e.java_exception.getClass().getName():
                return None
            raise

    def manifest(self) -> dict:
        """The newest valid manifest; with none, an empty one."""
        versions = self._versions()
        for v in reversed(versions):
            if (m := self._load(v)) is not None:
                return m
        return {"version": max(versions, default=0), "next_run_id": 1, "runs": [], "batch_ids": [], "last_seq": None}

    @staticmethod
    def _valid(m: dict) -> dict:
        ids = [r["run_id"] for r in m["runs"]]
        if ids != sorted(set(ids)) or (ids and m["next_run_id"] <= ids[-1]):
            raise ValueError("run ids must rise and stay below next_run_id")
        if len({_folder(r) for r in m["runs"]}) < len(ids):
            raise ValueError("two runs name one folder")
        for r in m["runs"]:
            if r["run_id"] <= 0 or r["point_count"] <= 0 or r["rows_count"] <= 0 or r["min_timestamp_ns"] > r["max_timestamp_ns"] or r["min_parameter_id"] > r["max_parameter_id"]:
                raise ValueError(f"run {r['run_id']} has impossible statistics")
        return m

    def _commit(self, m: dict, **changes) -> dict:
        """Publishes the successor of ``m``; broken versions after it are passed over, a valid one is a conflict."""
        later = [v for v in self._versions() if v > m["version"]]
        if any(self._load(v) is not None for v in later):
            raise ManifestConflict(f"after version {m['version']}")
        new = self._valid(m | changes | {"version": max([m["version"], *later]) + 1})
        self._publish(f"manifest/v{new['version']}.json", json.dumps(new, sort_keys=True))
        return new

    def _open(self) -> None:
        if self.closed:
            raise StoreClosed("the store is closed")

    # writes
    def _write_run(self, run_id: int, df: DataFrame) -> dict | None:
        """Writes a run in a folder of its own, nothing reads it yet; None for no points.

        Counts and ranges are gathered as the points pass, so the run is not read again. A
        timestamp lies whole in one file, sorted by key, and counts as a row where it begins.
        """
        if not 0 < run_id < 1 << (63 - P.ORDINAL_BITS):
            raise ValueError(f"a version has no room for run {run_id}")
        folder = f"{_numbered(run_id)}/write=x{uuid.uuid4().hex}"
        columns = df.select("timestamp_ns", "parameter_id", "value", "ordinal")
        small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
        placed = columns.coalesce(1) if small else columns.repartitionByRange("timestamp_ns")
        key, seen = ["timestamp_ns", "parameter_id", "ordinal"], Observation()
        row = Window.partitionBy("timestamp_ns").orderBy(*key[1:])
        # 1 where a row begins, 2 where a key is repeated; only sorting neighbours are compared.
        kind = F.when(F.row_number().over(row) == 1, 1).when(F.lag("parameter_id").over(row) == F.col("parameter_id"), 2).otherwise(0)
        ranges = [f(c).alias(f"{n}_{c}") for c in key for n, f in (("min", F.min), ("max", F.max))]
        missing = F.count(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in ("timestamp_ns", "parameter_id", "value", "ordinal")]) == 1, 1))
        ordered = placed.sortWithinPartitions(*key).withColumn("kind", kind)
        counts = [F.count(F.lit(1)).alias("point_count"), *[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in ((1, "rows_count"), (2, "repeats"))], missing.alias("missing")]
        watched = ordered.observe(seen, *counts, *ranges).drop("kind")
        watched.write.options(**self._block_options()).parquet(f"{self.root}/runs/{folder}")
        s = dict(seen.get)
        wrong = None
        if s.get("point_count"):
            if s["missing"]:
                wrong = "points must not hold nulls"
            elif s["min_parameter_id"] < 0 or s["max_parameter_id"] > MAX_PARAMETER_ID:
                wrong = "parameter ids must fit unsigned 32 bits"
            elif s["min_ordinal"] < 0 or s["max_ordinal"] >= 1 << P.ORDINAL_BITS:
                wrong = f"ordinals must fit unsigned {P.ORDINAL_BITS} bits"
        if wrong or not s.get("point_count"):
            self._drop(folder)
            if wrong:
                raise ValueError(wrong)
            return None
        size = self._fs.getContentSummary(self._path(f"runs/{folder}")).getLength()
        self.stats["bytes_written"] += size
        kept = ("point_count", "rows_count", "min_timestamp_ns", "max_timestamp_ns", "min_parameter_id", "max_parameter_id")
        return {"run_id": run_id, "folder": folder, "unique": s["repeats"] == 0, "size_bytes": size} | {k: s[k] for k in kept}

    def _drop(self, folder: str) -> None:
        """Deletes an attempt, and the folder of its id if that is empty then."""
        self._fs.delete(self._path(f"runs/{folder}"), True)
        parent = folder.split("/")[0]
        if parent != folder and self._fs.exists(self._path(f"runs/{parent}")) and not self._names(f"runs/{parent}"):
            self._fs.delete(self._path(f"runs/{parent}"), False)

    def _block_options(self) -> dict[str, str]:
        return {} if self.block_points is None else {"parquet.block.row.count.limit": str(self.block_points)}

    def _move(self, run: dict, run_id: int) -> dict:
        """The run under another id."""
        moved = run | {"run_id": run_id, "folder": f"{_numbered(run_id)}/{run['folder'].split('/')[1]}"}
        self._fs.mkdirs(self._path(f"runs/{_numbered(run_id)}"))
        if not self._fs.rename(self._path(f"runs/{run['folder']}"), self._path(f"runs/{moved['folder']}")):
            raise OSError(f"cannot rename {run['folder']} to {moved['folder']}")
        return moved

    def append(self, points: DataFrame, batch_id: int | None = None, last_seq: int | None = None) -> bool:
        """Writes one run and commits it; no points, no run. A batch id that is already committed is skipped.

        ``ordinal`` gives arrival order for points of one key; without it key repeats have no order to keep.
        """
        self._open()
        if "ordinal" not in points.columns:
            points = points.withColumn("ordinal", F.lit(0).cast("long"))
        run = written = None
        for attempt in range(ATTEMPTS):
            m = self.manifest()
            if batch_id is not None and m["batch_ids"] and batch_id <= m["batch_ids"][-1]:
                if run is not None:
                    self._drop(run["folder"])
                return False
            if written is None:
                run, written = self._write_run(m["next_run_id"], points), True
            elif run is not None and run["run_id"] != m["next_run_id"]:
                run = self._move(run, m["next_run_id"])
            if run is None and batch_id is None:
                return False
            changes = {"batch_ids": m["batch_ids"] if batch_id is None else [batch_id], "last_seq": m["last_seq"] if last_seq is None else last_seq}
            if run is not None:  # else a batch of empty frames moves the sequence on
                changes |= {"runs": [*m["runs"], run], "next_run_id": run["run_id"] + 1}
            try:
                self._commit(m, **changes)
                break
            except ManifestConflict:
                self.stats["commit_conflicts"] += 1
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(0.01 * 2 ** min(attempt, 6))
        if run is None:
            return False
        self.stats["flush_count"] += 1
        self.stats["flush_points"] += run["point_count"]
        self.stats["flush_bytes"] += run["size_bytes"]
        return True

    # reads
    def _points(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], VERSIONED)
        paths = [f"{self.root}/runs/{_folder(r)}" for r in runs]
        return self.spark.read.schema(VERSIONED).option("basePath", f"{self.root}/runs").parquet(*paths).select(*VERSIONED_COLUMNS)

    def _hit(self, start_ns: int, end_ns: int, ids: list[int] | None) -> list[dict]:
        """Runs that the manifest's zone maps do not rule out."""
        self._open()
        runs = self.manifest()["runs"]
        hit = [r for r in runs if _may_hold(r, start_ns, end_ns, ids)]
        self.stats["files_considered"] += len(runs)
        self.stats["files_pruned"] += len(runs) - len(hit)
        self.stats["files_opened"] += len(hit)
        return hit

    def scan(self, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> DataFrame:
        """Versioned points of the runs that may hold some of the range."""
        return self._points(self._hit(start_ns, end_ns, None if ids is None else sorted(set(ids))))

    def _newest(self, start_ns: int, end_ns: int, ids: Iterable[int] | None, ordered: bool) -> DataFrame:
        ids = None if ids is None else sorted(set(ids))
        hit = self._hit(start_ns, end_ns, ids)
        kept = P.filter_parameters(self._points(hit).filter(P.in_time(start_ns, end_ns)), ids)
        small = sum(r.get("size_bytes", SMALL_READ + 1) for r in hit) <= SMALL_READ
        if small:  # one task then serves the merge and the order
            kept = kept.coalesce(1)
        spans = sorted((r["min_timestamp_ns"], r["max_timestamp_ns"]) for r in hit)
        apart = all(r.get("unique") for r in hit) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        if not apart:  # else no key stands twice in these runs
            kept = P.newest_wins(kept if small or not ordered else kept.repartitionByRange("timestamp_ns", "parameter_id"))
        return P.in_key_order(kept) if ordered else kept.select(*P.POINT_COLUMNS)

    def query_range(self, start_ns: int, end_ns: int, ids: Iterable[int] | None = None, ordered: bool = True) -> DataFrame:
        """Points of ``[start, end)``, newest wins, in order of (timestamp, parameter)."""
        return self._newest(start_ns, end_ns, ids, ordered)

    def observed_range(self, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> tuple[DataFrame, Observation]:
        """``query_range`` and an observation of ``points_returned``; ``note`` adds it to the counters once the frame has run."""
        seen = Observation()
        return self.query_range(start_ns, end_ns, ids).observe(seen, F.count(F.lit(1)).alias("points_returned")), seen

    def note(self, seen: Observation) -> int:
        n = seen.get["points_returned"]
        self.stats["points_returned"] += n
        return n

    def aggregate_range(self, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> DataFrame:
        return P.aggregate_points(self._newest(start_ns, end_ns, ids, ordered=False), start_ns, end_ns, ids)

    # footers
    def _footer(self, file, length: int) -> bytes:
        """A Parquet file's end from its footer on: two reads, however many blocks it has."""
        stream, read = self._fs.open(file), self._jvm.org.apache.commons.io.IOUtils.toByteArray
        try:
            stream.seek(length - 8)
            size = int.from_bytes(bytes(read(stream, 8))[:4], "little") + 8
            stream.seek(length - size)
            return bytes(read(stream, size))
        finally:
            stream.close()

    def _blocks(self, run: dict) -> pa.Table:
        """The blocks of a run in columns; see ``inspect``. One footer is held at a time."""
        files = [(s.getPath(), s.getLen()) for s in self._list(f"runs/{_folder(run)}")]
        parts = [_footer_blocks(f.getName(), self._footer(f, n)) for f, n in files if f.getName().endswith(".parquet")]
        out = pa.concat_tables([BLOCK.empty_table(), *parts])
        read = {"point_count": sum(out["point_count"].to_pylist())}
        for k in ("timestamp_ns", "parameter_id"):
            for name, f in ((f"min_{k}", min), (f"max_{k}", max)):  # a block without a range makes the run's unknown
                read[name] = None if out[name].null_count else f(out[name].to_pylist(), default=None)
        if wrong := sorted(k for k, v in read.items() if run[k] != v):
            raise ValueError(f"run {run['run_id']}: footers and manifest differ in {', '.join(wrong)}")
        return out

    def inspect(self, run_id: int) -> list[dict]:
        """The blocks (row groups) of a run from its files' footers; no data is read.

        Raises if the footers' count or ranges differ from what the manifest says of the run.
        """
        self._open()
        return self._blocks({r["run_id"]: r for r in self.manifest()["runs"]}[run_id]).to_pylist()

    def blocks(self) -> DataFrame:
        """The blocks of all runs as ``inspect`` gives them, with their ``run_id``; the driver holds some 140 bytes a block."""
        self._open()
        found = [BLOCK.insert(0, pa.field("run_id", pa.int64())).empty_table()]
        for run in self.manifest()["runs"]:
            blocks = self._blocks(run)
            found.append(blocks.add_column(0, "run_id", pa.array([run["run_id"]] * blocks.num_rows, pa.int64())))
        return self.spark.createDataFrame(pa.concat_tables(found).combine_chunks())  # Spark stops at an empty chunk

    def block_counters(self, start_ns: int, end_ns: int, ids: Iterable[int] | None = None) -> dict[str, int]:
        """What a query reads, from manifest and footers: files and blocks considered and ruled out, points in blocks scanned."""
        self._open()
        ids = None if ids is None else sorted(set(ids))
        runs = self.manifest()["runs"]
        hit = [r for r in runs if _may_hold(r, start_ns, end_ns, ids)]
        considered, read = 0, []
        for r in hit:
            blocks = self._blocks(r)
            considered += blocks.num_rows
            read += [b["point_count"] for b in blocks.to_pylist() if _may_hold(b, start_ns, end_ns, ids)]
        return {
            "files_considered": len(runs), "files_pruned": len(runs) - len(hit), "files_opened": len(hit), "blocks_considered": considered,
            "blocks_pruned": considered - len(read), "blocks_scanned": len(read), "points_decoded": sum(read),
        }

    # maintenance
    def compact(self) -> bool:
        """With at least ``min_runs`` runs: all become one newest-wins run; True if it ran.

        If another writer commits meanwhile, the new run is dropped and nothing changes.
        """
        self._open()
        m = self.manifest()
        if len(m["runs"]) < self.min_runs:
            return False
        # Ranges of time first: the aggregate and the sorted files then share one exchange.
        every = self._points(m["runs"])
        small = sum(r.get("size_bytes", SMALL_BYTES) for r in m["runs"]) <= SMALL_BYTES
        merged = P.newest_wins(every if small else every.repartitionByRange("timestamp_ns")).withColumn("ordinal", F.lit(0).cast("long"))
        run = self._write_run(m["next_run_id"], merged)
        try:
            self._commit(m, runs=[run], next_run_id=run["run_id"] + 1)
        except ManifestConflict:
            self.stats["commit_conflicts"] += 1
            self._drop(run["folder"])
            return False
        self.stats["compaction_count"] += 1
        self.stats["compaction_points"] += run["point_count"]
        self.stats["compaction_bytes"] += run["size_bytes"]
        return True

    def _run_folders(self) -> dict[str, float]:
        """Folders of runs and of attempts on disk, with the seconds since each changed."""
        out, now = {}, time.time()
        for s in self._list("runs"):
            name = s.getPath().getName()
            inner = [t for t in self._list(f"runs/{name}") if t.getPath().getName().startswith("write=")] if s.isDirectory() else []
            for t in inner:
                out[f"{name}/{t.getPath().getName()}"] = now - t.getModificationTime() / 1e3
            if not inner:
                out[name] = now - s.getModificationTime() / 1e3
        return out

    def vacuum(self, keep_versions: int = 1, retention_s: float = RETENTION_SECONDS) -> list[str]:
        """Deletes manifests beyond the newest ``keep_versions`` valid ones, then the runs that none of the rest names.

        What is younger than ``retention_s`` stays: readers may hold such a manifest, and a writer may yet commit such a run.
        """
        self._open()
        now, ages = time.time(), {}
        for s in self._list("manifest"):
            name = s.getPath().getName()
            if name.startswith("v") and name.endswith(".json") and name[1:-5].isdigit():
                ages[int(name[1:-5])] = now - s.getModificationTime() / 1e3
        valid = {v: m for v in sorted(ages) if (m := self._load(v)) is not None}
        kept = {*list(valid)[-keep_versions:], *(v for v, age in ages.items() if age < retention_s)}
        if not valid:
            return []
        for v in sorted(set(ages) - kept):
            self._fs.delete(self._path(f"manifest/v{v}.json"), False)
        named = {_folder(r) for v in kept if v in valid for r in valid[v]["runs"]}
        gone = [n for n, age in self._run_folders().items() if n not in named and age >= retention_s]
        for n in gone:
            self._drop(n)
        return gone

    def recover(self, min_age_s: float = 0.0) -> dict:
        """Quarantines folders that no valid manifest names and that did not change for ``min_age_s``.

        With no valid manifest but runs on disk, one is rebuilt from these: of several
        attempts at one run the last changed counts, unreadable ones are set aside.
        """
        self._open()
        began, m, folders = time.perf_counter(), self.manifest(), self._run_folders()
        valid = [x for v in self._versions() if (x := self._load(v)) is not None]
        runs: dict[int, list[str]] = {}
        for name in sorted(folders, key=folders.get, reverse=True):  # the last changed comes last
            head = name.split("/")[0]
            if head.startswith("run_id=") and head[7:].isdigit():
                runs.setdefault(int(head[7:]), []).append(name)
        if not valid and runs:
            stats = []
            for i, names in sorted(runs.items()):
                for name in reversed(names):
                    own = {"run_id": i, "folder": name}
                    try:
                        points = self._points([own])
                        found = P.run_catalog(points).withColumn("run_id", F.lit(i).cast("long")).first().asDict()
                        own |= found | {"rows_count": points.agg(F.countDistinct("timestamp_ns")).first()[0], "unique": False}
                        stats.append(own)
                        break
                    except Exception:  # noqa: BLE001  any unreadable run is set aside
                        self._quarantine(name, "invalid")
            m = self._commit(m, runs=stats, next_run_id=max(runs) + 1)
            valid = [m]
            self.stats["manifest_rebuild_count"] += 1
        named = {_folder(r) for x in valid for r in x["runs"]}
        for name, age in folders.items():
            if name not in named and age >= min_age_s:
                self._quarantine(name, "orphan")
        self.stats["recovery_ms"] = round((time.perf_counter() - began) * 1e3, 3)
        return m

    def _quarantine(self, name: str, reason: str) -> None:
        if self._fs.exists(self._path(f"runs/{name}")):
            target = f"quarantine/{name.lstrip('.').replace('/', '-')}.{reason}"
            if not self._fs.rename(self._path(f"runs/{name}"), self._path(target)):
                raise OSError(f"cannot move {name} to {target}")
            self.stats["quarantined_runs"] += 1

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> RunStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
