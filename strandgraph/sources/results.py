"""Results of algorithms in a shared folder, seen only once they are committed."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ENTRY = "name string, version int, data string, rows bigint, layout string"


class Results:
    """Tables by name and version under a folder.

    A commit writes the table to a folder of its own, counts it, and then renames a manifest entry into place, which fails
    if another commit has taken the version; until then no reader sees anything of it. What failed commits leave is deleted
    by `prune`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._path(self.folder).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def listed(self) -> DataFrame:
        """name, version, data, rows, layout of every commit."""
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.folder}/manifest/*.json").filter("name IS NOT NULL")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ENTRY)

    def commit(self, name: str, table: DataFrame) -> int:
        """Write the table as the next version of `name`; the version."""
        data = f"data/{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{data}")
        rows = self.spark.read.schema(table.schema).parquet(f"{self.folder}/{data}").count()
        jvm, system = self.spark._jvm, self._system()
        found = self.listed().filter(self._of(name)).agg({"version": "max"}).first()[0]
        version = (found or 0) + 1
        entry = json.dumps({"name": name, "version": version, "data": data, "rows": rows, "layout": table.schema.json()})
        made = self._path(f"{self.folder}/manifest/_{uuid.uuid4().hex}")
        out = system.create(made)
        out.write(bytearray(entry.encode()))
        out.close()
        # a rename that never replaces: two commits can't both be the same version
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.isAbsolute() and made.toUri().getScheme() else system.getUri(), system.getConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, self._path(f"{self.folder}/manifest/{self._file(name)}-{version}.json"), none)
        except Exception:
            system.delete(made, False)
            raise
        return version

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """A committed table, the newest by default. Raises if there is none, or if it no longer has its rows."""
        found = self.listed().filter(self._of(name))
        found = found.filter(f"version = {int(version)}") if version is not None else found.orderBy("version", ascending=False)
        entry = found.first()
        if entry is None:
            raise KeyError(f"no committed result {name}" + (f" of version {version}" if version is not None else ""))
        table = self.spark.read.schema(StructType.fromJson(json.loads(entry.layout))).parquet(f"{self.folder}/{entry.data}")
        if (rows := table.count()) != entry.rows:
            raise ValueError(f"{name} {entry.version} has {rows} rows, {entry.rows} were committed")
        return table

    def load_all(self, *names: str) -> tuple[DataFrame, ...]:
        """The newest tables of all names, or, if one was never committed, an error that names all such."""
        have = {r["name"] for r in self.listed().select("name").distinct().collect()}
        if missing := [n for n in names if n not in have]:
            raise KeyError(f"no committed results: {', '.join(missing)}")
        return tuple(self.load(n) for n in names)

    def prune(self) -> int:
        """Delete tables that no commit has; how many. Not while commits are going on."""
        kept, system = {r.data for r in self.listed().select("data").collect()}, self._system()
        top, gone = self._path(f"{self.folder}/data"), 0
        for status in system.listStatus(top) if system.exists(top) else []:
            if f"data/{status.getPath().getName()}" not in kept:
                gone += system.delete(status.getPath(), True)
        return gone

    @staticmethod
    def _of(name: str):
        from pyspark.sql import functions as F

        return F.col("name") == F.lit(name)

    @staticmethod
    def _file(name: str) -> str:
        return name.encode().hex()
