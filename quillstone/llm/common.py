"""What several operators share: the cluster's shared folder, staged tables, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where it is unset and all is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut and its partitions pinned, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """pyarrow's file system for uri, and the path in it; Hadoop's names of object stores are told in pyarrow's."""
    from pyarrow import fs

    for name, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if uri.startswith(name):
            uri = own + uri[len(name) :].lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


ROW = "__quillstone_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs written once with a number of each row, so that a row can be named again."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def by_number(docs: DataFrame, named: DataFrame, keep: bool) -> DataFrame:
    """Rows of numbered docs whose number is (or, without keep, is not) in the column row of named; docs are not shuffled.

    A number tells the partition that it was given in, so numbers are written in files by partitions (64 to a file), and a
    task reads the files that its own rows may be named in.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/named"
    files = named.select("row", F.shiftright("row", 33 + 6).alias("file"))
    files.repartition("file").sortWithinPartitions("file").write.partitionBy("file").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = file_system(path)
        known: dict[int, np.ndarray] = {}
        for b in batches:
            row = b.column("number").to_numpy()
            file = row >> 39
            hit = np.zeros(len(row), bool)
            for k in np.unique(file).tolist():
                if k not in known:
                    parts = [x.path for x in store.get_file_info(fs.FileSelector(f"{root}/file={k}", allow_not_found=True)) if x.path.endswith(".parquet")]
                    known[k] = np.concatenate([np.zeros(0, np.int64), *(pq.ParquetFile(store.open_input_file(x)).read(["row"]).column(0).to_numpy() for x in parts)])
                hit |= (file == k) & np.isin(row, known[k])
            yield b.filter(pa.array(hit == keep))

    packed = docs.select(F.col(ROW).alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, T.StructType([T.StructField("number", T.LongType()), T.StructField("row", docs.schema)])).select("row.*")


def over_tasks(df: DataFrame, size: int, most: int) -> DataFrame:
    """Rows that stand for `size` bytes of work in all, in a stated number of partitions: 128 MB each, some for every core, no more than rows.

    Their own few bytes would let adaptive execution join them into one task.
    """
    n = min(most, max(-(-size // (128 << 20)), 4 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(max(1, n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over many tasks."""
    holder = sys.modules.setdefault("_quillstone_worker", types.ModuleType("_quillstone_worker"))
    return holder.__dict__.setdefault(name, {})


def text_bytes(df: DataFrame, column: str):
    """UTF-8 bytes of a text column, null as empty."""
    return F.encode(F.coalesce(df[column], F.lit("")), "UTF-8")
