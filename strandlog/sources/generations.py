"""Immutable generations of a table below one folder, and the manifests that say which are live.

    gen=3-5fb1c2d0/ ...      Parquet, written once, sorted by key if compacted
    manifest-00000003.json   {"version": 3, "live": [{"gen": "3-5fb1c2d0", "priority": 3, "sorted": true}, ...]}

Readers union the live generations of the manifest of the greatest version, by priority. A writer makes the manifest of the next
version by a rename that fails if there is one, so that of two writers one must begin again from what the other made; what a
writer that died left behind has a name of its own and is in nobody's way. The folder is reached through Hadoop's file system,
hence may lie on any of its stores.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.live import latest
from strandlog.sources.shared import drop_path, list_names

#: How often a writer begins again because another one was first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Generations:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        return sorted(int(x[9:-5]) for x in list_names(self.spark, self.root) if x.startswith("manifest-") and x.endswith(".json"))

    def manifest(self) -> dict:
        made = self._versions()
        if not made:
            return {"version": 0, "live": []}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest-{made[-1]:08d}.json", wholetext=True).collect()))

    def _swap(self, live: list[dict], version: int) -> None:
        """Makes the manifest after ``version``; raises Conflict if there is one."""
        fs, tmp = self._fs(f"{self.root}/_manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"version": version + 1, "live": live}).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/manifest-{version + 1:08d}.json")
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if "://" in self.root or self.root.startswith("file:") else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, final, options)
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(final):
                raise Conflict(f"version {version + 1} was made by another writer") from e
            raise

    def _commit(self, change) -> None:
        """Swaps to ``change(live, next version)`` of the newest manifest, again if another writer was first."""
        for _ in range(TRIES):
            m = self.manifest()
            try:
                return self._swap(change(m["live"], m["version"] + 1), m["version"])
            except Conflict:
                continue
        raise Conflict(f"no swap in {TRIES} tries")

    def append(self, log: DataFrame) -> str:
        """Adds a generation of records (key, idx, value, ...); later ones take precedence."""
        gen = f"{self.manifest()['version'] + 1}-{uuid.uuid4().hex[:8]}"
        log.write.parquet(f"{self.root}/gen={gen}")
        self._commit(lambda live, version: [*live, {"gen": gen, "priority": version, "sorted": False}])
        return gen

    def _live(self, m: dict) -> DataFrame | None:
        out = None
        for x in m["live"]:
            part = self.spark.read.parquet(f"{self.root}/gen={x['gen']}").withColumn("priority", F.lit(x["priority"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, m: dict | None = None) -> DataFrame:
        """The newest record per key over all live generations; a single sorted one is returned as it is."""
        m = m or self.manifest()
        rows = self._live(m)
        if rows is None:
            return self.spark.createDataFrame([], "key string, idx long, value string")
        if len(m["live"]) == 1 and m["live"][0]["sorted"]:
            return rows.select("key", "idx", "value")
        return latest(rows.withColumnRenamed("idx", "_i").withColumn("idx", F.struct("priority", "_i")), "value").select("key", F.col("idx._i").alias("idx"), "value")

    def compact(self) -> str:
        """Rewrites all live generations as one, sorted by key, in their place; those that come meanwhile stay. May be repeated at any time."""
        m = self.manifest()
        old, gen = {x["gen"] for x in m["live"]}, f"{m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        self.read(m).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.root}/gen={gen}")
        priority = max((x["priority"] for x in m["live"]), default=0)

        def change(live: list[dict], version: int) -> list[dict]:
            if not old <= {x["gen"] for x in live}:
                raise RuntimeError("another compaction has replaced these generations")
            return [{"gen": gen, "priority": priority, "sorted": True}, *(x for x in live if x["gen"] not in old)]

        self._commit(change)
        return gen

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the manifests but the newest ``keep``, and the generations that none of these names; not while others read or write."""
        kept = self._versions()[-keep:]
        live = set()
        for v in kept:
            text = "".join(r.value for r in self.spark.read.text(f"{self.root}/manifest-{v:08d}.json", wholetext=True).collect())
            live |= {f"gen={x['gen']}" for x in json.loads(text)["live"]}
        names = {f"manifest-{v:08d}.json" for v in kept} | live
        gone = [x for x in list_names(self.spark, self.root) if x not in names and x.startswith(("gen=", "manifest-", "_manifest-"))]
        for x in gone:
            drop_path(self.spark, f"{self.root}/{x}")
        return gone
