"""Tables that are written in stages and published by one atomic manifest: caches of vectors and frozen rankings.

Data files are written into new folders, which nobody reads until a manifest names them.  Manifests are numbered; a new one is renamed into its place, which fails where another writer was first.  A reader
sees the newest manifest, so a write that is interrupted leaves nothing but an unlisted folder.  A part that isn't written anew keeps its folder, and so its bytes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Published:
    """A table below ``root`` in parts by name; each part is a folder of Parquet files, or several where rows were added."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def number(self) -> int:
        """That of the newest manifest; 0 where nothing was published."""
        folder = self._path("_manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def parts(self) -> dict[str, list[str]]:
        """Folders of each part, by the newest manifest."""
        n = self.number()
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/_manifests/{n:08d}.json", wholetext=True).collect())) if n else {}

    def _publish(self, parts: dict[str, list[str]], after: int) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        staged, place = self._path(f"_manifests/_{uuid.uuid4().hex}"), self._path(f"_manifests/{after + 1:08d}.json")
        out = self.fs.create(staged)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(staged, place, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))  # an error where the place is taken

    def _stage(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def replace(self, new: dict[str, DataFrame]) -> None:
        """Writes the given parts anew; all others stay as they are, byte for byte."""
        after = self.number()
        parts = self.parts() | {name: [self._stage(df)] for name, df in new.items()}
        self._publish(parts, after)

    def add(self, name: str, df: DataFrame) -> None:
        """Adds rows to a part."""
        after = self.number()
        parts = self.parts()
        self._publish(parts | {name: [*parts.get(name, []), self._stage(df)]}, after)

    def read(self, name: str | None = None) -> DataFrame | None:
        """The rows of a part, or of all parts; None where there are none."""
        parts = self.parts()
        folders = [f"{self.root}/{f}" for k, fs in sorted(parts.items()) if name in (None, k) for f in fs]
        return self.spark.read.parquet(*folders) if folders else None


class Cache:
    """Values by key, made once: ``get`` returns what is there and makes, adds and returns what isn't."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Published(spark, root)

    def missing(self, keys: DataFrame) -> DataFrame:
        """Different keys (key) that the cache doesn't have."""
        have = self.table.read("values")
        keys = keys.select("key").where("key is not null").distinct()
        return keys if have is None else keys.join(have, "key", "left_anti")

    def get(self, keys: DataFrame, make) -> DataFrame:
        """(key, value) of different ``keys`` (key, ...); ``make`` turns rows of ``keys`` with keys that are missing, one for each, into (key, value)."""
        lacking = keys.join(self.missing(keys), "key", "left_semi").dropDuplicates(["key"])
        if not lacking.isEmpty():
            self.table.add("values", make(lacking).select("key", "value"))
        return self.table.read("values").join(keys.select("key").distinct(), "key", "left_semi") if self.table.number() else make(lacking).select("key", "value")


def freeze(table: Published, rankings: DataFrame, by: str = "retriever") -> None:
    """Freezes rankings, a part for each value of ``by`` (some retrievers); those of other retrievers stay byte for byte."""
    names = [r[0] for r in rankings.select(by).distinct().collect()]  # a row for each retriever
    table.replace({str(n): rankings.where(F.col(by) == n) for n in names})
