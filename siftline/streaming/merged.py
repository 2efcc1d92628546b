"""A table that is merged as it grows: sorted runs by key, named by a manifest, and compacted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MergedTable:
    """The latest row a key of all batches written to a folder.

    A batch is reduced to a row a key and written as a run; then a manifest that names the live runs is renamed into place, so a batch counts
    wholly or not at all. Manifests are numbered; the last one counts. A batch of a number that the manifest has already merged is passed over,
    so a repeated batch changes nothing. `most` runs are merged into one; runs that it replaced are removed with the next
    merge, so that a reader of the manifest before still finds them. One writer at a time, as a stream has.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], version: str | None = None, most: int = 8):
        self.spark, self.path, self.keys, self.version, self.most = spark, path.rstrip("/"), keys, version, most
        self.rest = [f for f in schema.fields if f.name not in keys]
        self.schema = T.StructType([*[schema[k] for k in keys], *self.rest, T.StructField("_batch", T.LongType())])
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, *names: str):
        return self._path("/".join([self.path, *names]))

    def manifest(self) -> dict:
        """{number, last, runs, stale}: the last manifest; last is the largest batch merged."""
        folder = self._file("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "last": -1, "runs": [], "stale": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(numbers)}.json", wholetext=True).first()[0])

    def _commit(self, found: dict) -> None:
        number = found["number"] + 1
        draft, done = self._file(f"_draft-{number}"), self._file("manifest", f"{number}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(found | {"number": number}).encode()))
        out.close()
        self._fs.mkdirs(self._file("manifest"))
        if not self._fs.rename(draft, done):
            raise RuntimeError(f"another writer has made manifest {number} of {self.path}")
        self._fs.delete(self._file("manifest", f"{number - 2}.json"), False)

    def _latest(self, rows: DataFrame) -> DataFrame:
        order = F.struct(*([self.version] if self.version else []), "_batch")
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[f.name for f in self.rest], "_batch"), order).alias("r"))
        return best.select(*self.keys, *[F.col(f"r.{f.name}").alias(f.name) for f in self.rest], F.col("r._batch").alias("_batch"))

    def _rows(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def _run(self, rows: DataFrame, name: str) -> str:
        self._latest(rows).sortWithinPartitions(*self.keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def write(self, batch: DataFrame, number: int) -> None:
        """Merge a batch of the table's columns."""
        found = self.manifest()
        if number <= found["last"]:
            return
        run = self._run(batch.withColumn("_batch", F.lit(number).cast("long")), f"run-{number}")
        found |= {"last": number, "runs": [*found["runs"], run]}
        self._commit(found)
        if len(found["runs"]) > self.most:
            self.compact()

    def compact(self) -> None:
        """Merge all live runs into one."""
        found = self.manifest()
        if len(found["runs"]) < 2:
            return
        whole = self._run(self._rows(found["runs"]), f"whole-{found['last']}-{found['number']}")
        self._commit(found | {"runs": [whole], "stale": found["runs"]})
        for run in found["stale"]:
            self._fs.delete(self._file(run), True)

    def read(self) -> DataFrame:
        """The latest row a key: of equal versions that of the later batch. Only live runs are read."""
        return self._latest(self._rows(self.manifest()["runs"])).drop("_batch")
