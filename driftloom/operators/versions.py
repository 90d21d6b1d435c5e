"""Versioned tables: what readers see is what a committed manifest lists.

A table is dealt into buckets by key; a commit writes new files for the buckets that it changes and then, in one rename, a
manifest that says which version each bucket has. A writer that stops before the rename leaves files that no manifest
names: readers go on with the manifest before, and the next commit of that number writes over them. Compaction rewrites
the buckets in few files; clean-up deletes what the last manifests do not name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass
class Manifest:
    """A committed state of the table: the version whose files each bucket has, and what the writer wants to remember."""

    number: int = -1
    buckets: dict[int, int] = field(default_factory=dict)
    schema: str | None = None
    note: dict = field(default_factory=dict)


class VersionedTable:
    """A table of rows with unique keys at a path in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        """Numbers of the committed manifests, ascending; a few, as clean-up leaves the last ones."""
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The last committed manifest, or that of a number."""
        numbers = self._numbers()
        if number is None and not numbers:
            return Manifest()
        at = self._at(f"_manifests/{numbers[-1] if number is None else number:020d}.json")
        stream = self._fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["number"], {int(b): v for b, v in found["buckets"].items()}, found["schema"], found["note"])

    def _publish(self, made: Manifest) -> None:
        """The rename is the commit: it fails if that number is there."""
        draft, final = self._at(f"_manifests/.draft-{made.number:020d}"), self._at(f"_manifests/{made.number:020d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": made.number, "buckets": made.buckets, "schema": made.schema, "note": made.note}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise ValueError(f"manifest {made.number} of {self.path} is there")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, made: Manifest, only: list[int] | None = None) -> DataFrame:
        parts = [f"{self.path}/v={v}/_bucket={b}" for b, v in made.buckets.items() if only is None or b in only]
        schema = T.StructType.fromJson(json.loads(made.schema))
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows as of the last manifest, or of a number that clean-up has left."""
        made = self.manifest(number)
        if made.schema is None:
            raise ValueError(f"nothing is committed at {self.path}")
        return self._rows(made)

    def upsert(self, rows: DataFrame, note: dict | None = None) -> Manifest:
        """Commits rows in place of those with their keys; buckets without a row of these keep their files."""
        last = self.manifest()
        given = rows.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = [r[0] for r in given.select("_bucket").distinct().collect()]  # at most `buckets` numbers
            there = [b for b in touched if b in last.buckets]
            made = given
            if there:
                kept = self._rows(last, there).join(rows, self.keys, "left_anti").select(*rows.columns)
                made = kept.withColumn("_bucket", self._bucket()).unionByName(given)
            return self._commit(made, last, {**last.buckets, **dict.fromkeys(touched, last.number + 1)}, rows.schema, last.note | (note or {}))
        finally:
            given.unpersist()

    def _commit(self, made: DataFrame, last: Manifest, buckets: dict[int, int], schema: T.StructType, note: dict) -> Manifest:
        number = last.number + 1
        made.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v={number}")
        new = Manifest(number, buckets, schema.json(), note)
        self._publish(new)
        return new

    def compact(self) -> Manifest:
        """Commits the same rows with all buckets in one version, so that older versions can go."""
        last = self.manifest()
        rows = self.read()
        return self._commit(rows.withColumn("_bucket", self._bucket()), last, dict.fromkeys(last.buckets, last.number + 1), rows.schema, last.note)

    def clean(self, keep: int = 1) -> list[int]:
        """Deletes all but the last `keep` manifests, and the versions that these do not name, started ones among them;
        gives the deleted versions. Readers of older manifests must be done."""
        numbers = self._numbers()
        for number in numbers[:-keep]:
            self._fs.delete(self._at(f"_manifests/{number:020d}.json"), False)
        held = {v for number in numbers[-keep:] for v in self.manifest(number).buckets.values()}
        gone = []
        for status in self._fs.listStatus(self._at("")):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) not in held:
                self._fs.delete(status.getPath(), True)
                gone.append(int(name[2:]))
        return sorted(gone)
