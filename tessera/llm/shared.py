"""The folder that driver and executors share, and bounded samples to learn from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

_OWN: dict[str, str] = {}
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder of spark.checkpoint.dir; where that is unset, one of our own if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="tessera-")
        found = _OWN["dir"]
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark).rstrip("/").split(":", 1)[1].lstrip("/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def renamed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with all columns under names that nothing else uses, in order, and a copy of its text as `text`."""
    own = [f"own {i}" for i in range(len(df.columns))]
    return df.toDF(*own).withColumn("text", F.col(f"`{own[df.columns.index('text')]}`")), own


def narrow(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame marked for broadcast if its rows come to no more than `limit` bytes, as counted; else as it is."""

    def width(name: str, kind) -> Column:
        if isinstance(kind, ArrayType):
            return 16 + F.coalesce(F.size(name), F.lit(0)) * 32
        if isinstance(kind, (StringType, BinaryType)):
            return 16 + F.coalesce(F.octet_length(name), F.lit(0))
        return F.lit(16)

    total = sum((width(f.name, f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(total.cast("long"))).first()[0] or 0) <= limit else df


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key's text modulo divisor; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % divisor


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled ids, those with the lowest hashes.

    An id with several labels counts once, with the largest; null ids and labels are left out.
    """
    picked = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        picked = picked.where(where)
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
