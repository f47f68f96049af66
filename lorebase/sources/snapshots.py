"""Tables that change by versions: a new version is seen whole or not at all, and old ones can be read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lorebase.sources.scratch import exists


class Conflict(RuntimeError):
    """Somebody else has made the version that was to be made."""


class Snapshots:
    """Named tables under ``root``, in any store that Spark reads.

    A version is one small file, ``manifest-N.json``, that names the folder and the schema of each table.  A change
    writes new folders first and then creates the file of the next version, which only one writer can; until then
    readers see the version before, and a run that dies leaves folders that no version names.  Tables that a change does not
    touch keep their folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> dict | None:
        """The tables of a version; None while its file is not whole."""
        place, store = self._path(f"manifest-{version}.json")
        stream = store.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def version(self) -> int:
        """The newest whole version; 0 before the first."""
        place, store = self._path("")
        if not exists(self.spark, self.root):
            return 0
        names = [f.getPath().getName() for f in store.listStatus(place)]
        found = sorted((int(n[9:-5]) for n in names if n.startswith("manifest-")), reverse=True)
        return next((v for v in found if self._manifest(v) is not None), 0)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        held = self._manifest(self.version() if version is None else version)[name]
        return self.spark.read.schema(held["schema"]).parquet(f"{self.root}/{held['folder']}")

    def commit(self, changed: dict[str, DataFrame], base: int | None = None) -> int:
        """Make the version after ``base`` (the newest) with new rows for some tables; ``Conflict`` if it is there already."""
        base = self.version() if base is None else base
        tables = dict(self._manifest(base)) if base else {}
        for name, rows in changed.items():
            folder = f"{name}-{base + 1}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            tables[name] = {"folder": folder, "schema": ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)}
        place, store = self._path(f"manifest-{base + 1}.json")
        if store.exists(place):
            raise Conflict(f"version {base + 1} is there already")
        try:
            out = store.create(place, False)
        except Exception as e:
            raise Conflict(f"version {base + 1} is there already") from e
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        return base + 1
