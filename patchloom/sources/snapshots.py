"""A keyed table whose appends are atomic.

Every append writes its data files to a folder of its own, below ``_data``. What belongs to the table says a versioned
list of those folders: version n + 1 is put in place by a rename that fails if another writer was first. The loser keeps
its files, checks their keys against what the other one added, and tries the version after that. So a reader sees all
rows of an append or none, an append that dies leaves only files that no list names, and two writers never give one key
two rows. An append may carry a batch name; a batch that a list already names adds nothing, without a look at its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.session import materialize
from patchloom.sources.sinks import BUCKETS, DETAIL_KEY, _bucketed, existing_table, touched_rows, unseen_rows


@dataclass(frozen=True)
class Snapshot:
    """A version of the table: its data folders, rows, and the batches that it holds (the last one of each writer)."""

    version: int = 0
    folders: tuple[str, ...] = ()
    rows: int = 0
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """The table at ``path``; ``buckets`` folders by a hash of the first key let an append read only what it may clash with."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = DETAIL_KEY, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path("").getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _path(self, name: str):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list_name(self, version: int) -> str:
        return f"_versions/{version:012d}.json"

    def current(self) -> Snapshot:
        """The newest version; version 0 without rows before the first append."""
        folder = self._path("_versions")
        if not self._files.exists(folder):
            return Snapshot()
        names = sorted(s.getPath().getName() for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return self.at(int(names[-1].split(".")[0])) if names else Snapshot()

    def at(self, version: int) -> Snapshot:
        """A version by its number; every one stays readable."""
        lines = self.spark.read.text(str(self._path(self._list_name(version))), wholetext=True).first()
        found = json.loads(lines[0])
        return Snapshot(version, tuple(found["folders"]), found["rows"], found["batches"])

    def read(self, snapshot: Snapshot | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default) with their bucket column, None before the first append."""
        snapshot = snapshot or self.current()
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in snapshot.folders]
        if not parts:
            return None
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def rows(self, snapshot: Snapshot | None = None) -> DataFrame | None:
        found = self.read(snapshot)
        return None if found is None else found.drop(f"bucket_{self.buckets}")

    def publish(self, snapshot: Snapshot) -> bool:
        """Put a version in place; False if that number is taken."""
        draft = self._path(f"_versions/.{uuid.uuid4().hex}")
        text = json.dumps({"folders": list(snapshot.folders), "rows": snapshot.rows, "batches": snapshot.batches})
        out = self._files.create(draft, False)
        out.write(text.encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        options[0] = getattr(self._fs, "Options$Rename").NONE
        try:
            self._context.rename(draft, self._path(self._list_name(snapshot.version)), options)
            return True
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.toString():
                return False
            raise

    def append(self, incoming: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Add the rows with unseen keys, all or none of them, and return their number.

        Of incoming rows with one key the least stays. ``writer`` and ``batch`` (a number that grows) name the append: a batch
        that the table already holds, or one before it, adds nothing."""
        column = f"bucket_{self.buckets}"
        rows, checked, lost = incoming, Snapshot(), None
        while True:
            base = self.current()
            if writer is not None and base.batches.get(writer, -1) >= batch:
                self._drop(lost)
                return 0
            folder = f"_data/{uuid.uuid4().hex}"
            known = self.read(Snapshot(base.version, tuple(f for f in base.folders if f not in checked.folders)))
            held = None if known is None else touched_rows(known, _bucketed(rows, self.keys[0], self.buckets), self.buckets)
            unseen_rows(rows, held, self.keys, self.buckets).write.partitionBy(column).parquet(f"{self.path}/{folder}")
            self._drop(lost)
            written = existing_table(self.spark, f"{self.path}/{folder}")
            added = 0 if written is None else written.count()
            if not added:
                self._drop(folder)
                if writer is None:
                    return 0
            batches = base.batches | ({writer: batch} if writer is not None else {})
            folders = (*base.folders, folder) if added else base.folders
            if self.publish(Snapshot(base.version + 1, folders, base.rows + added, batches)):
                return added
            if added:
                rows, checked, lost = written, base, folder
            else:
                lost = None

    def _drop(self, folder: str | None) -> None:
        if folder is not None:
            self._files.delete(self._path(folder), True)

    def leftovers(self) -> list[str]:
        """Data folders that no version names: of appends that died, or that run now."""
        if not self._files.exists(self._path("_data")):
            return []
        named = set(self.current().folders)
        return sorted(f"_data/{s.getPath().getName()}" for s in self._files.listStatus(self._path("_data")) if f"_data/{s.getPath().getName()}" not in named)


def counted(table: SnapshotTable, incoming: DataFrame) -> DataFrame:
    """Append and tell: rows given, rows added, rows of the table."""
    given = materialize(incoming, "incoming")
    added = table.append(given)
    return given.agg(F.count("*").alias("incoming")).withColumn("added", F.lit(added).cast("long")).withColumn("table_rows", F.lit(table.current().rows).cast("long"))
