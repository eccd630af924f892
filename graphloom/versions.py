"""Versions of tables below a folder: each is written whole and then committed by one small file that says what it was made from.

Readers see committed versions only, so a write that fails changes nothing, and what a reader has stays while the next version is made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_COMMIT = "commit.json"


class Versions:
    """Versions below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folders(self) -> dict[str, int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        return {n: int(n.split("-")[1]) for n in names if n.startswith("v-")}

    def meta(self, folder: str) -> dict | None:
        """What a version was made from; None if it is not committed."""
        at = self._at(f"{folder}/{_COMMIT}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # the commit itself was cut off
            return None
        finally:
            stream.close()

    def head(self) -> tuple[str, dict] | None:
        """The greatest committed version and what it was made from."""
        for folder, _ in sorted(self._folders().items(), key=lambda x: (x[1], x[0]), reverse=True):
            found = self.meta(folder)
            if found is not None:
                return folder, found
        return None

    def read(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}/{name}")

    def committed(self) -> list[str]:
        """All committed versions, the oldest first."""
        return [f for f, _ in sorted(self._folders().items(), key=lambda x: (x[1], x[0])) if self.meta(f) is not None]

    def write(self, parts: dict[str, DataFrame], meta: dict, prune: bool = True) -> str:
        """A new version. With prune, what lies behind the one before it is removed after the commit."""
        before = self._folders()
        folder = f"v-{max(before.values(), default=0) + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in parts.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        stream = self._fs.create(self._at(f"{folder}/{_COMMIT}"), False)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        if not prune:
            return folder
        held = [f for f in sorted(before, key=before.get) if self.meta(f) is not None][-1:]
        for old in before.keys() - set(held):
            self._fs.delete(self._at(old), True)
        return folder
