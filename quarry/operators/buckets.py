"""A base in buckets with pending changes: compaction rewrites the buckets that changes touch and no others.

Rows lie in buckets by a hash of their id; changes are routed to the same buckets as they are appended, so a bucket and its
pending changes can be compacted without the rest. A manifest, one small file, says which version of each bucket counts,
how many rows it has, and which deltas are pending with how many changes for each bucket. It is written under a new name
and then renamed, so a reader sees the state before or after a step and a step that is lost leaves the old one. Steps bear
the number of their micro-batch: one that is run again rewrites its delta and is told from what is folded already.

Readers merge what is pending: buckets without changes are read as they are, those with changes are compacted on the fly.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.maintenance import LINK, compact
from quarry.operators.storage import remove_folder

#: Buckets of a store that names no other number; a bucket should be what one task can compact.
BUCKETS = 16


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = LINK, columns: tuple[str, ...] = ("size",)):
        self.spark, self.folder, self.key, self.columns = spark, folder, key, columns

    # ---- the manifest

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        top = self._path("manifests")
        return sorted(s.getPath().getName() for s in self._fs().listStatus(top) if not s.getPath().getName().startswith(".")) if self._fs().exists(top) else []

    def manifest(self) -> dict:
        """The state that counts; empty before there is a base."""
        names = self._manifests()
        if not names:
            return {}
        stream = self._fs().open(self._path(f"manifests/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        fs, names = self._fs(), self._manifests()
        name = f"{int(names[-1].split('.')[0]) + 1 if names else 0:012d}.json"
        draft = self._path(f"manifests/.{name}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not fs.rename(draft, self._path(f"manifests/{name}")):
            raise RuntimeError(f"manifest {name} of {self.folder} is there already: two writers")
        for old in names[:-1]:  # the one before stays for those that are reading
            fs.delete(self._path(f"manifests/{old}"), False)

    # ---- rows and deltas

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, place: str) -> dict[str, int]:
        """Writes rows (with _bucket) by bucket and counts them."""
        n = self.manifest().get("n", BUCKETS)
        # by the bucket alone: one file each, whose size the number of buckets sets
        rows.repartition(n, "_bucket").sortWithinPartitions("_bucket", "id").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{place}")
        return self._counts(place)

    def _counts(self, place: str) -> dict[str, int]:
        if not self._fs().exists(self._path(place)) or not any(s.isDirectory() for s in self._fs().listStatus(self._path(place))):
            return {}
        return {str(r["_bucket"]): r["count"] for r in self.spark.read.parquet(f"{self.folder}/{place}").groupBy("_bucket").count().collect()}

    def create(self, base: DataFrame, buckets: int = BUCKETS) -> None:
        """The first version of all buckets."""
        schema = base.schema.json()
        base.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "id").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/rows/v0")
        counts = self._counts("rows/v0")
        self._publish({"n": buckets, "schema": schema, "buckets": {k: ["v0", c] for k, c in counts.items()}, "pending": [], "folded": -1})

    def append(self, changes: DataFrame, number: int) -> bool:
        """Keeps a micro-batch as a delta; says whether there was anything in it. A number that is folded is passed over."""
        state = self.manifest()
        if number <= state["folded"]:
            return False
        place = f"deltas/{number:012d}"
        counts = self._write(changes.withColumn("_bucket", self._bucket(state["n"])), place)
        state["pending"] = sorted([d for d in state["pending"] if d[0] != number] + ([[number, counts]] if counts else []))
        state["changes"] = changes.schema.json()
        self._publish(state)
        return bool(counts)

    def n_pending(self) -> int:
        return sum(c for _, counts in self.manifest().get("pending", []) for c in counts.values())

    def _schema(self, state: dict, what: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(state[what]))

    def _rows(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = self._schema(state, "schema")
        places = [f"{self.folder}/rows/{v}/_bucket={k}" for k, (v, n) in sorted(state["buckets"].items()) if n and (buckets is None or k in buckets)]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _changes(self, state: dict) -> DataFrame:
        places = [f"{self.folder}/deltas/{number:012d}/_bucket={k}" for number, counts in state["pending"] for k in counts]
        return self.spark.read.schema(self._schema(state, "changes")).parquet(*places)

    @staticmethod
    def _touched(state: dict) -> set[str]:
        return {k for _, counts in state["pending"] for k in counts}

    def read(self) -> DataFrame:
        """The rows as of the last change: what is pending is merged in, bucket by bucket."""
        state = self.manifest()
        touched = self._touched(state)
        if not touched:
            return self._rows(state)
        merged = compact(self._rows(state, touched), self._changes(state), self.key, self.columns)
        return self._rows(state, set(state["buckets"]) - touched).unionByName(merged)

    def compact(self) -> set[str]:
        """Folds all that is pending into new versions of the buckets it touches; says which. The others' files stay."""
        state = self.manifest()
        touched = self._touched(state)
        if not touched:
            return set()
        last = state["pending"][-1][0]
        version = f"v{last + 1}"
        merged = compact(self._rows(state, touched), self._changes(state), self.key, self.columns)
        counts = self._write(merged.withColumn("_bucket", self._bucket(state["n"])), f"rows/{version}")
        stale = [f"rows/{state['buckets'][k][0]}/_bucket={k}" for k in touched if k in state["buckets"]] + [f"deltas/{number:012d}" for number, _ in state["pending"]]
        for k in touched:
            state["buckets"][k] = [version, counts.get(k, 0)]
        state["pending"], state["folded"] = [], last
        self._publish(state)
        for place in stale:
            remove_folder(self.spark, f"{self.folder}/{place}")
        return touched

    def n_rows(self) -> int:
        """Rows of the compacted base, from the manifest alone."""
        return sum(n for _, n in self.manifest()["buckets"].values())
