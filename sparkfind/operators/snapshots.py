"""Several tables under one commit: a manifest names the folders that hold each table's rows, and is written last.

A snapshot's folder has ``manifests/<number>`` (JSON: what each table is made of) and ``data/`` with the rows. Rows are
written first, each to a new folder; then the next manifest is created, which fails where another writer was faster, so
readers see all tables of one state, and a crash before that leaves the state as it was. Names of folders are never used again.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the state that a change was made from."""


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, there at once with all its text; ``Conflict`` where there is one already."""
    fs, where = hadoop(spark, path)
    _, part = hadoop(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the file; a link doesn't
            of = spark.sparkContext._jvm.java.nio.file.Path.of
            made = False
            if not fs.exists(where):
                spark.sparkContext._jvm.java.nio.file.Files.createLink(of(fs.makeQualified(where).toUri()), of(fs.makeQualified(part).toUri()))
                made = True
        else:
            made = not fs.exists(where) and fs.rename(part, where)
    except Py4JJavaError as e:
        if not fs.exists(where):
            raise
        raise Conflict(path) from e
    finally:
        if fs.exists(part):
            fs.delete(part, False)
    if not made:
        raise Conflict(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, deleted when Python ends: in ``spark.checkpoint.dir``, or a local one on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkfind-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch[path] = spark
    return path


_scratch: dict[str, SparkSession] = {}


@atexit.register
def _free() -> None:
    for path, spark in _scratch.items():
        try:
            fs, where = hadoop(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class Snapshots:
    """The states of a set of tables at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        """Numbers of the committed states, ascending."""
        fs, where = hadoop(self.spark, f"{self.path}/manifests")
        found = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(x) for x in found if x.isdigit())

    def latest(self) -> tuple[int, dict]:
        """Number and manifest of the current state; 0 and an empty one before the first commit."""
        have = self.numbers()
        return (have[-1], self.manifest(have[-1])) if have else (0, {})

    def manifest(self, number: int) -> dict:
        fs, where = hadoop(self.spark, f"{self.path}/manifests/{number:012d}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def new_folder(self, name: str) -> str:
        return f"data/{name}-{uuid.uuid4().hex}"

    def commit(self, base: int, manifest: dict) -> int:
        """Makes ``manifest`` the state after ``base``; ``Conflict`` if there is a later one already."""
        create(self.spark, f"{self.path}/manifests/{base + 1:012d}", json.dumps(manifest, sort_keys=True))
        return base + 1

    # -------------------------------------------------------------- whole tables
    def read(self, *names: str) -> list[DataFrame | None]:
        """Tables of the current state, all of the same one; None for those that it lacks."""
        _, manifest = self.latest()
        tables = manifest.get("tables", {})
        return [self.spark.read.schema(tables[n]["schema"]).parquet(f"{self.path}/{tables[n]['folder']}") if n in tables else None for n in names]

    def write(self, change: Callable[..., dict[str, DataFrame]], *names: str) -> int:
        """Commits what ``change`` makes of the tables ``names`` (a DataFrame for each table that changes), as one state.

        Tables that it doesn't give stay as they are. A single writer wins: the others get ``Conflict``, and their rows are unnamed."""
        number, manifest = self.latest()
        tables = dict(manifest.get("tables", {}))
        for name, rows in change(*self.read(*names)).items():
            folder = self.new_folder(name)
            rows.write.parquet(f"{self.path}/{folder}")
            tables[name] = {"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)}
        return self.commit(number, manifest | {"tables": tables})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all states but the last ``keep``, and folders that none of those names; their readers and writers must have ended."""
        have = self.numbers()
        named = json.dumps([self.manifest(n) for n in have[-keep:]])
        for n in have[:-keep]:
            fs, where = hadoop(self.spark, f"{self.path}/manifests/{n:012d}")
            fs.delete(where, False)
        fs, where = hadoop(self.spark, f"{self.path}/data")
        gone = [x.getPath() for x in (fs.listStatus(where) if fs.exists(where) else []) if x.getPath().getName() not in named]
        for x in gone:
            fs.delete(x, True)
        return len(gone)
