"""The graph on disk: immutable snapshots behind a manifest.

A commit writes the tables it changes into a new snapshot folder and then adds one manifest
file that names each table's folder; readers follow the highest complete manifest, so a
failed commit leaves the last state in force.  Of two writers that begin from the same state
the second to commit gets a StoreError, as a manifest's name is its number and no file is
replaced.  Data and manifests go through Spark and its file systems, so any store that Spark
reaches will do, where renaming onto a name in use fails."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wovengraph.schema import TABLES, empty

VERSION = 1


class StoreError(Exception):
    """The store is of another version or another repository, or another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.base: int | None = None

    def begin(self) -> None:
        """From now to the next commit, no other writer's commit may come in between."""
        self.base = (self.manifest() or {}).get("number", 0)

    def manifest(self) -> dict | None:
        """The state in force; None for a new store."""
        try:
            rows = self.spark.read.text(f"{self.folder}/manifests").collect()
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        found = [json.loads(r.value) for r in rows if r.value]
        return max(found, key=lambda m: m["number"]) if found else None

    def initialize(self, root: str, rebuild: bool = False) -> None:
        """Claim the store for a repository; refuses another one's unless `rebuild`."""
        state = self.manifest()
        if state is None or rebuild:
            self._put({"number": (state or {}).get("number", 0) + 1, "version": VERSION, "root": root, "tables": {}, "graph_dirty": True, "vector_dirty": True})
        elif state["version"] != VERSION or state["root"] != root:
            raise StoreError(f"the store is of {state['root']} in version {state['version']}; rebuild it for {root}")

    def root(self) -> str:
        state = self.manifest()
        if state is None or state["version"] != VERSION:
            raise StoreError("the store is outdated; rebuild it")
        return state["root"]

    def _put(self, state: dict) -> None:
        """Add the manifest under its number: written aside, then renamed, which fails if the name is in use."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        folder = fs.Path(f"{self.folder}/manifests")
        store = folder.getFileSystem(conf)
        folder = store.makeQualified(folder)
        store.mkdirs(folder)
        aside, final = fs.Path(folder, f".{uuid.uuid4().hex}"), fs.Path(folder, f"{state['number']:012d}.json")
        out = store.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state).encode() + b"\n"))
        finally:
            out.close()
        files = fs.FileContext.getFileContext(folder.toUri(), conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            files.rename(aside, final, never)
        except Py4JJavaError as e:
            store.delete(aside, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise StoreError(f"another writer has committed state {state['number']}; run again") from e
        finally:
            self.base = None

    def read(self, table: str) -> DataFrame:
        state = self.manifest() or {"tables": {}}
        if table not in state["tables"]:
            return empty(self.spark, table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{state['tables'][table]}")

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def vector_index(self) -> str | None:
        """The folder of the vector index in force; None without one."""
        at = (self.manifest() or {}).get("index")
        return at and f"{self.folder}/{at}"

    def commit(self, changed: dict[str, DataFrame], graph_dirty: bool | None = None, vector_dirty: bool | None = None, index: str | None = None) -> None:
        """Write the tables given and put them in force together; nothing changes if one fails.
        `index` puts a folder in force as the vector index; new chunks drop the one in force."""
        state = self.manifest()
        if state is None:
            raise StoreError("initialize the store first")
        if self.base not in (None, state["number"]):
            self.base = None
            raise StoreError(f"another writer has committed state {state['number']}; run again")
        made = f"snapshots/{uuid.uuid4().hex}"
        for table, frame in changed.items():
            want = empty(self.spark, table).schema
            frame.select(*want.fieldNames()).write.parquet(f"{self.folder}/{made}/{table}")
        state = state | {"number": state["number"] + 1, "tables": state["tables"] | {t: f"{made}/{t}" for t in changed}}
        if index is not None or "chunks" in changed:
            state["index"] = index
        for flag, value in (("graph_dirty", graph_dirty), ("vector_dirty", vector_dirty)):
            if value is not None:
                state[flag] = value
        self._put(state)

    def dirty(self, which: str) -> bool:
        """Whether the `graph` or the `vector` side has changed since it was last derived."""
        return bool((self.manifest() or {}).get(f"{which}_dirty", True))
