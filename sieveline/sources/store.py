"""Results kept by key in a folder that many writers share: staged commits, an atomic claim, first put wins.

    store = ArtifactStore(spark, "hdfs:///kept")
    store.put(rows)                 # rows (artifact_key, json)
    store.get(keys)                 # keys (artifact_key) with their json

A put writes its rows into a staging folder, in a folder for each prefix of keys, and then claims the next number of the
log by renaming that folder, which the file system does whole or not at all and never onto a folder that is there; a
writer that comes too late takes the next number. Of a key that two commits hold, the one with the lower number counts, for
every reader and for good. Nothing that was not renamed is ever read, so a writer that dies leaves no half of a put. A
lookup reads the prefixes of its keys alone. `compact` writes one commit of many: readers see the old ones or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "artifact_key string, json string"
#: Hexadecimal digits of a key that are its folder's name.
PREFIX = 2


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        here = self._path(self.root)
        self._fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
        self._root = self._fs.makeQualified(here)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._never_onto = spark.sparkContext._gateway.new_array(rename, 1)
        self._never_onto[0] = rename.NONE
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    def commits(self) -> list[str]:
        """Names of the commits that count, in order: those from the last compacted one on. A name is a number, or
        low-high for one that was made of those."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        made = [n for n in names if "-" in n]
        last = max(made, key=lambda n: int(n.split("-")[1])) if made else None
        top = int(last.split("-")[1]) if last else -1
        return ([last] if last else []) + [n for n in names if "-" not in n and int(n) > top]

    def _claim(self, staged: str, name: str) -> bool:
        """Whether the staged folder is now the commit of this name: false if there is one."""
        from py4j.protocol import Py4JJavaError

        try:
            self._context.rename(self._path(staged), self._path(f"{self.root}/log/{name}"), self._never_onto)
        except Py4JJavaError as x:
            if "FileAlreadyExists" in str(x.java_exception):
                return False
            raise
        return True

    def _staged(self, rows: DataFrame) -> str:
        to = f"{self.root}/staged/{uuid.uuid4().hex}"
        keyed = rows.filter("artifact_key is not null and json is not null").select("artifact_key", "json", F.left("artifact_key", F.lit(PREFIX)).alias("prefix"))
        keyed.groupBy("prefix", "artifact_key").agg(F.min("json").alias("json")).write.partitionBy("prefix").parquet(to)
        return to

    def put(self, rows: DataFrame) -> str:
        """Commit rows (artifact_key, json); of a key's rows one. The name of the commit."""
        staged = self._staged(rows)
        while True:
            n = 1 + max([-1, *(int(c.split("-")[-1]) for c in self.commits())])
            if self._claim(staged, f"{n:08d}"):
                return f"{n:08d}"

    def rows(self) -> DataFrame:
        """(prefix, artifact_key, json, commit): all that is kept, also what an earlier commit outweighs."""
        out = None
        for i, name in enumerate(self.commits()):
            part = self.spark.read.schema("artifact_key string, json string, prefix string").parquet(f"{self.root}/log/{name}").withColumn("commit", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "artifact_key string, json string, prefix string, commit int")

    def get(self, keys: DataFrame) -> DataFrame:
        """(artifact_key, json) of those of keys (artifact_key, ...) that are kept; folders of other prefixes are not read
        where the keys are few."""
        asked = keys.select("artifact_key").distinct().withColumn("prefix", F.left("artifact_key", F.lit(PREFIX)))
        few = [r.prefix for r in asked.select("prefix").distinct().limit(65).collect()]
        held = self.rows()
        held = held.filter(F.col("prefix").isin(few)) if len(few) <= 64 else held
        return held.join(asked, ["prefix", "artifact_key"], "left_semi").groupBy("artifact_key").agg(F.min_by("json", "commit").alias("json"))

    def compact(self) -> str | None:
        """Put the commits that count now into one; puts of others that come meanwhile stand behind it. Their folders
        stay for readers that have begun, until `clean`."""
        names = self.commits()
        if len(names) < 2:
            return names[0] if names else None
        staged = self._staged(self.rows().groupBy("artifact_key").agg(F.min_by("json", "commit").alias("json")))
        name = f"{names[0].split('-')[0]}-{names[-1].split('-')[-1]}"
        self._claim(staged, name)  # false if another compacted the same: it holds the same
        return name

    def clean(self) -> int:
        """Delete commits that a compacted one holds; how many went."""
        keep, gone = set(self.commits()), 0
        for s in self._fs.listStatus(self._path(f"{self.root}/log")):
            if s.getPath().getName() not in keep and int(s.getPath().getName().split("-")[-1]) <= max([-1, *(int(n.split("-")[1]) for n in keep if "-" in n)]):
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
