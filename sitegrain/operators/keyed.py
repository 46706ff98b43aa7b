"""Parquet tables kept by key: a batch rewrites the buckets that it touches, and nothing else.

Rows lie in buckets by a hash of their key. A batch writes new files for its buckets beside the
old ones and then a manifest that names the files of every bucket. The manifest is renamed
into place, so all tables of a batch change at once: whoever reads sees the state before it or after
it, and a job that dies before the rename has changed nothing. The manifest also says which
batch of which query came last; one that comes again is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Change = Callable[[dict[str, DataFrame], DataFrame], Mapping[str, DataFrame]]


class KeyedTables:
    """Tables that share their key columns, under ``path``. One writer at a time.

    ``buckets`` is fixed when the tables are made: the cost of a batch is that of the buckets it
    touches, so there should be many more of them than keys in a batch, or as many as keep a
    bucket small. The driver holds a name per bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schemas: Mapping[str, T.StructType], buckets: int = 64):
        self.spark, self.path, self.keys, self.schemas, self.buckets = spark, path.rstrip("/"), list(keys), dict(schemas), buckets

    # --- files -----------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[str]:
        fs, folder = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The last one: ``n``, ``buckets``, ``done`` (query: last batch) and ``files`` (table: bucket: version)."""
        names = self._manifests()
        if not names:
            return {"n": 0, "buckets": self.buckets, "done": {}, "files": {t: {} for t in self.schemas}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        name = f"{self.path}/manifest/{manifest['n']:012d}.json"
        fs, draft = self._fs(f"{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, self._fs(name)[1]):
            raise RuntimeError(f"{name} is there already: two writers")

    # --- reading ---------------------------------------------------------------------

    def read(self, table: str, only: Sequence[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """Current rows; ``only`` those of some buckets."""
        files = (manifest or self.manifest())["files"][table]
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, v in files.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- writing ---------------------------------------------------------------------

    def apply(self, batch: DataFrame, change: Change, query: str, batch_id: int) -> bool:
        """Change the buckets that hold a key of ``batch``: ``change`` gets their rows and the batch, and
        gives the rows they hold from now on. False if this batch was applied before."""
        before = self.manifest()
        if before["buckets"] != self.buckets:
            raise ValueError(f"the tables have {before['buckets']} buckets")
        if before["done"].get(query, -1) >= batch_id:
            return False
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        after = change({t: self.read(t, touched, before) for t in self.schemas}, batch)
        version = f"{query}-{batch_id}"
        files = {t: dict(before["files"][t]) for t in self.schemas}
        for t, rows in after.items():
            placed = rows.select(*self.schemas[t].fieldNames()).withColumn("bucket", self.bucket())
            placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{t}/{version}")
            fs, folder = self._fs(f"{self.path}/{t}/{version}")
            made = {s.getPath().getName() for s in fs.listStatus(folder)}
            for b in touched:
                if f"bucket={b}" in made:
                    files[t][str(b)] = version
                else:
                    files[t].pop(str(b), None)
        self._commit({"n": before["n"] + 1, "buckets": self.buckets, "done": {**before["done"], query: batch_id}, "files": files})
        self._clean(before)
        return True

    def _clean(self, before: dict) -> None:
        """Files that neither the last two manifests name. A reader may still be at the one before the last."""
        names = self._manifests()
        if len(names) < 3:
            return
        old = json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-3]}", wholetext=True).first()[0])
        for t, buckets in old["files"].items():
            for b, v in buckets.items():
                if before["files"][t].get(b) != v:
                    fs, folder = self._fs(f"{self.path}/{t}/{v}/bucket={b}")
                    fs.delete(folder, True)
        fs, last = self._fs(f"{self.path}/manifest/{names[-3]}")
        fs.delete(last, False)
