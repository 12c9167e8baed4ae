"""What the operators share: the cluster's shared folder, cut lineage, row ids, the fixed split of documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch: texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all run in one process,
    as in tests, a local folder is taken; on a cluster that would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder. Results that read it must have been computed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: its lineage is cut, and a lost executor costs no
    earlier stage. codec: another than the session's, where bytes on disk weigh more than time."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch. Results are computed when they are read, so the two settings stay as
    they are here in the caller's session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % parts == part, F.lit(False))


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have yet, whatever its case."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_sized(left: DataFrame, right: DataFrame, on, how: str, rows: int = 100_000, size: int = 16 << 20) -> DataFrame:
    """Join with a right side that is already materialized: broadcast if it has at most so many rows and characters, else
    by a shuffle whose hot partitions adaptive execution splits."""
    r = right.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*(F.col(c) for c in right.columns))))).alias("size")).first()
    return left.join(F.broadcast(right) if r.n <= rows and (r.size or 0) <= size else right.hint("merge"), on, how)
