"""Snapshots of modules as Parquet folders, with writes as new versions.

Every commit writes whole new folders for what it touches, then a manifest that names the current folders, by a
rename: readers see the state before or after, never between. One writer at a time holds a lock file that names it; a
lock older than LEASE is taken to be of a writer that died, and one whose lock was taken may not commit. The file
system is Hadoop's, so that any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.ir import Conflict
from brindle.sources.catalog import Catalog, Field, Module, Relation


#: Seconds after which a lock no longer counts.
LEASE = 3600


class Files:
    """The few file operations that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written whole under another name, then renamed over the old."""
        path, fs = self._at(f"{name}.{uuid.uuid4().hex}")
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        final, _ = self._at(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(path, final, options)

    def create(self, name: str, text: str = "") -> bool:
        """False if it is there already."""
        path, fs = self._at(name)
        try:
            stream = fs.create(path, False)
            stream.write(bytearray(text.encode()))
            stream.close()
        except Exception as e:  # the file system's own class says what was wrong
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def age(self, name: str) -> float:
        """Seconds since it was written."""
        path, fs = self._at(name)
        return time.time() - fs.getFileStatus(path).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)


def module_json(module: Module) -> dict[str, Any]:
    plain = lambda x: {k: list(v) if isinstance(v, tuple) else v for k, v in vars(x).items() if v not in (None, (), False) or k in ("nullable", "localized")}
    return {**{k: v for k, v in vars(module).items() if k not in ("fields", "relations", "id_field")}, "id_field": plain(module.id_field), "fields": [plain(f) for f in module.fields], "relations": [plain(r) for r in module.relations]}


def module_of(data: dict[str, Any]) -> Module:
    field = lambda d: Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
    return Module(**{**data, "id_field": field(data["id_field"]), "fields": tuple(map(field, data["fields"])), "relations": tuple(Relation(**r) for r in data["relations"])})


class Store:
    """A catalog kept in a folder."""

    def __init__(self, spark: SparkSession, root: str, lease: float = LEASE):
        self.spark, self.files, self.lease = spark, Files(spark, root), lease
        self.manifest: dict[str, Any] = json.loads(self.files.read("manifest.json")) if self.files.exists("manifest.json") else {"version": 0, "modules": {}, "rows": {}, "links": {}, "versions": {}, "ids": {}}

    def load(self) -> Catalog:
        """All modules, then all links."""
        catalog = Catalog()
        for name, data in self.manifest["modules"].items():
            module = module_of(data)
            links = {r.name: self._read(self.manifest["links"][f"{name}.{r.name}"]) for r in module.relations if f"{name}.{r.name}" in self.manifest["links"]}
            catalog.register(module, self._read(self.manifest["rows"][name]), links)
        catalog.versions, catalog.stored = dict(self.manifest["versions"]), self.manifest["version"]
        if "files" in self.manifest["rows"]:
            catalog.files = self._read(self.manifest["rows"]["files"])
        return catalog

    def _read(self, folder: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.files.root}/{folder}")
        df.folder = folder  # what the manifest calls it
        return df

    def put(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """A new folder with the rows, not yet named by the manifest."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.files.root}/{folder}")
        return folder, self._read(folder)

    def current(self) -> dict[str, Any]:
        """The manifest as it is now in the folder."""
        if self.files.exists("manifest.json"):
            self.manifest = json.loads(self.files.read("manifest.json"))
        return self.manifest

    def refresh(self, catalog: Catalog) -> None:
        """Brings a catalog to the manifest last read, if others have written since it was loaded."""
        if catalog.stored != self.manifest["version"]:
            catalog.become(self.load())

    def _lock(self, token: str) -> None:
        if self.files.create("lock", token):
            return
        try:
            old = self.files.age("lock") > self.lease
        except Exception:  # it has just gone
            old = False
        if old:
            self.files.delete("lock")
        if not old or not self.files.create("lock", token):
            raise Conflict("another write is under way")

    def _holds(self, token: str) -> bool:
        return self.files.exists("lock") and self.files.read("lock") == token

    @contextmanager
    def writing(self, catalog: Catalog | None = None):
        """The one writer's turn. The manifest is read anew, and the catalog brought to it; the draft is changed by the
        caller and renamed into place at the end, if it was changed. An error leaves all as it was."""
        token = f"{uuid.uuid4().hex} {time.time():.0f}"
        self._lock(token)
        try:
            draft = json.loads(json.dumps(self.current()))
            if catalog is not None:
                self.refresh(catalog)
            yield draft
            if draft != self.manifest:
                draft["version"] += 1
                if not self._holds(token):
                    raise Conflict("the lock was taken by another writer")
                self.files.write("manifest.json", json.dumps(draft))
                self.manifest = draft
                if catalog is not None:
                    catalog.stored = draft["version"]
        finally:
            if self._holds(token):
                self.files.delete("lock")

    def vacuum(self) -> list[str]:
        """Deletes folders that the manifest doesn't name; call it when no reader is left on an older version."""
        named = {*self.manifest["rows"].values(), *self.manifest["links"].values()}
        path, fs = self.files._at("data")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        gone = [f"data/{n}" for n in found if f"data/{n}" not in named]
        for folder in gone:
            self.files.delete(folder)
        return gone
