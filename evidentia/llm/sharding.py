"""Shards by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as they come: each task writes its rows as a small immutable Parquet file. Compaction
sorts the files into tiers by size, each tier ``fanout`` times the one below, and rewrites a tier that holds
enough runs into files of about the target size, without a shuffle: partitions of one scan are joined. Files are
never changed. A version is a small manifest with what it adds and removes; every ``full_every`` versions it lists
all files. It is written under a temporary name and renamed to the next version, which fails if another writer
was first; that writer's change is then taken in and the commit tried anew, and a merge whose runs are gone is
dropped and planned anew. Files of superseded versions stay, so readers keep what they have opened, until
``expire`` deletes what only older versions name, and files that no version names (of jobs that died).

Schema: columns are known by name, and by their order among equal names. An arrival may lack columns (they read as
null) and may bring new ones (older rows read as null). A number type that the store's holds without loss is
stored as that; any other change of type is refused before anything is written. Names that Parquet would mix up
are stored under names of their own.

Defined cases: an empty arrival adds a version without rows; nulls and repeated rows are kept as they are; a table
of no rows reads back with its columns; files of the target size are never rewritten.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_json_string

_WHOLE = ["byte", "short", "integer", "long"]


def _holds(kept: DataType, new: DataType) -> bool:
    """Whether every value of ``new`` is one of ``kept``."""
    a, b = kept.typeName(), new.typeName()
    return kept == new or b == "void" or (a in _WHOLE and b in _WHOLE[: _WHOLE.index(a)]) or (
        a == "double" and b in ("float", "byte", "short", "integer")
    )


class ShardStore:
    def __init__(
        self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, min_runs: int = 4, base_bytes: int = 1 << 20,
        full_every: int = 20
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.min_runs, self.base, self.full_every = target_bytes, fanout, min_runs, base_bytes, full_every
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))
        self._fs.mkdirs(self._at("data"))

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    # Manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        return max(self.versions(), default=0)

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._at("manifests", f"v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, fields and files of a version, put together from the last full list and the changes since."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "fields": None, "files": []}
        steps = [self._load(version)]
        while "files" not in steps[-1]:
            steps.append(self._load(steps[-1]["version"] - 1))
        files = {f["path"]: f for f in steps.pop()["files"]}
        for step in [*reversed(steps)]:
            for path in step["remove"]:
                files.pop(path)
            files.update((f["path"], f) for f in step["add"])
        return {"version": version, "fields": self._load(version)["fields"], "files": list(files.values())}

    def _commit(self, add: list[dict], remove: set[str] = frozenset(), fields: tuple[dict, ...] | list[dict] = ()) -> dict | None:
        """The new manifest; None if another writer has rewritten the files to remove or brought one of the fields under another name or type."""
        while True:
            old = self.manifest()
            if not remove <= {f["path"] for f in old["files"]}:
                return None
            known = {(f["name"], f["nth"]): f for f in old["fields"] or []}
            if any(known.get((f["name"], f["nth"]), f) != f for f in fields):
                return None
            known |= {(f["name"], f["nth"]): f for f in fields}
            new = {"version": old["version"] + 1, "fields": [*known.values()], "files": [f for f in old["files"] if f["path"] not in remove] + add}
            written = new if new["version"] % self.full_every == 1 else {
                "version": new["version"], "fields": new["fields"], "add": add, "remove": sorted(remove)
            }
            draft = self._at("manifests", f".{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps(written).encode()))
            out.close()
            if self._claim(draft, self._at("manifests", f"v{new['version']:08d}.json")):
                return new

    def _claim(self, draft, final) -> bool:
        """Rename that never replaces: of two writers one succeeds."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False

    # Schema

    @staticmethod
    def _merged(old: list[dict], new: list[dict]) -> list[dict]:
        """The old fields and the new ones among ``new``; a type that the old one doesn't hold is refused."""
        known = {(f["name"], f["nth"]): f for f in old}
        out = [*old]
        for f in new:
            have = known.get((f["name"], f["nth"]))
            if have is None:
                out.append(f)
            elif not _holds(_parse_datatype_json_string(have["type"]), _parse_datatype_json_string(f["type"])):
                raise ValueError(f"column {f['name']} is {have['type']} in the store and {f['type']} in the arrival")
        return out

    def _fields(self, schema: StructType, old: list[dict]) -> list[dict]:
        """Fields of an arrival, under the stored names of those that the store has."""
        stored = {(f["name"], f["nth"]): f["stored"] for f in old}
        taken = {s.lower() for s in stored.values()}
        seen: dict[str, int] = {}
        out = []
        for field in schema:
            nth = seen[field.name] = seen.get(field.name, -1) + 1
            name = stored.get((field.name, nth))
            if name is None:
                name = field.name if not nth and field.name.lower() not in taken and field.name.lower() not in {
                    f.name.lower() for f in schema if f.name != field.name
                } else f"{field.name}#{uuid.uuid4().hex[:8]}"
                taken.add(name.lower())
            out.append({"name": field.name, "nth": nth, "stored": name, "type": field.dataType.json()})
        return out

    # Data

    def _write(self, df: DataFrame) -> list[dict]:
        run = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{run}")
        return [
            {
                "path": f"{run}/{s.getPath().getName()}", "bytes": s.getLen()
            } for s in self._fs.listStatus(self._at(run)) if s.getPath().getName().startswith("part-")
        ]

    def append(self, arrival: DataFrame) -> dict:
        """Add the rows of ``arrival`` as one version."""
        while True:
            old = self.manifest()["fields"] or []
            fields = self._fields(arrival.schema, old)
            types = {f["stored"]: f["type"] for f in self._merged(old, fields)}
            plain = arrival.toDF(*[f"c{i}" for i in range(len(fields))])
            columns = [F.col(f"c{i}").cast(_parse_datatype_json_string(types[f["stored"]])).alias(f["stored"]) for i, f in enumerate(fields)]
            files = self._write(plain.select(*columns))
            if done := self._commit(files, fields=[f | {"type": types[f["stored"]]} for f in fields]):
                return done
            self._delete(files)  # another writer brought a new column meanwhile

    def _frame(self, files: list[dict], fields: list[dict]) -> DataFrame:
        kind = StructType([StructField(f["stored"], _parse_datatype_json_string(f["type"])) for f in fields])
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f['path']}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["fields"]:
            raise ValueError("nothing was appended yet")
        return self._frame(found["files"], found["fields"]).toDF(*[f["name"] for f in found["fields"]])

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base, self.fanout)) + 1)

    def plan(self, files: list[dict]) -> list[list[dict]]:
        """Runs of one tier to merge: as many as are there, if they are enough; target-sized files stay."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            if 4 * f["bytes"] < 3 * self.target:
                tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.min_runs]

    def compact(self) -> dict:
        """Merge until no tier holds enough runs. What was merged stays for readers until ``expire``."""
        found = self.manifest()
        while work := self.plan(found["files"]):
            for runs in work:
                size = sum(f["bytes"] for f in runs)
                merged = self._write(self._frame(runs, found["fields"]).coalesce(max(1, round(size / self.target))))
                if not self._commit(merged, {f["path"] for f in runs}):
                    self._delete(merged)  # another writer merged some of them first
            found = self.manifest()
        return found

    def _delete(self, files: list[dict]) -> None:
        for run in {f["path"].rpartition("/")[0] for f in files}:
            self._fs.delete(self._at(run), True)

    def expire(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Delete files that none of the last ``keep`` versions names, and older versions themselves; the number of files.

        Files younger than ``older_than`` seconds stay: a job may be about to commit them, or a reader still have them open.
        """
        versions = self.versions()
        kept = versions[-keep:]
        named = {f["path"] for v in kept for f in self.manifest(v)["files"]}
        before, gone = 1000 * (time.time() - older_than), 0
        for run in self._fs.listStatus(self._at("data")):
            files = list(self._fs.listStatus(run.getPath()))
            for s in files:
                path = f"data/{run.getPath().getName()}/{s.getPath().getName()}"
                if path not in named and s.getModificationTime() <= before and s.getPath().getName().startswith("part-"):
                    self._fs.delete(s.getPath(), False)
                    gone += 1
            if not any(s.getPath().getName().startswith("part-") for s in self._fs.listStatus(run.getPath())) and run.getModificationTime() <= before:
                self._fs.delete(run.getPath(), True)
        # The oldest version that is kept builds on the last full list before it.
        first = next((v for v in reversed(versions) if v <= kept[0] and "files" in self._load(v)), 0) if kept else 0
        for v in versions:
            if v < first:
                self._fs.delete(self._at("manifests", f"v{v:08d}.json"), False)
        return gone
