"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are laid out in id order over range partitions. Each partition's total (one small row) gives
every partition its global byte offset; the running sum inside a partition then places each row,
so no task ever sees more than its own range. A row goes to the shard in which the middle of its
bytes lies, so that a shard misses its target by at most one row's size.

Defined results: null ids sort first, a null text counts as empty, repeated rows are kept as
separate rows in arbitrary order among themselves, an empty table gives no rows, further columns
are ignored. A hot id is dealt over several range partitions by the last sort keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, checkpointed, numbered, staged, table

LAID = "doc_id long, size long, text_crc32 long, pid int"


def _placer(offsets: dict[int, tuple[int, int]], total: int, n_shards: int, carried: tuple[str, ...] = ()) -> Callable:
    # A row's middle is at least at the k-th cut, in half bytes; whole numbers of Python, so nothing overflows before 2**62 bytes.
    cuts = np.array([-(-2 * total * k // n_shards) for k in range(1, n_shards)], np.int64)

    def place(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at = list(offsets[b.column("pid")[0].as_py()])
            size = b.column("size").to_numpy()
            start = at[0] + np.cumsum(size) - size
            shard = np.searchsorted(cuts, 2 * start + size, "right")
            position = at[1] + np.arange(b.num_rows)
            at = [int(start[-1] + size[-1]), at[1] + b.num_rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard.astype("int32")), pa.array(start), pa.array(position), *(b.column(c) for c in carried)],
                names=["doc_id", "size", "text_crc32", "shard", "start", "position", *carried],
            )

    return place


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in a shard), start (global byte offset), and the carried long columns."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *carried)
    order = ["doc_id", "size", "text_crc32", "tie"]
    # Texts are read once: range bounds are sampled from the sizes.
    laid = staged(rows, "sizes").withColumn("tie", F.monotonically_increasing_id() % 1024).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = checkpointed(laid.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("pid"), *carried))
    # One row for each range partition: bounded by spark.sql.shuffle.partitions.
    totals = sorted(laid.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    offsets, b0, n0 = {}, 0, 0
    for pid, b, n in totals:
        offsets[pid] = (b0, n0)
        b0, n0 = b0 + b, n0 + n
    placed = laid.mapInArrow(_placer(offsets, max(b0, 1), n_shards, carried), "doc_id long, size long, text_crc32 long, shard int, start long, position long" + "".join(f", {c} long" for c in carried))
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"), "start", *carried)


def _free(name: str, columns: list[str]) -> str:
    """The name with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Every row of docs, in its own columns, once under path/shard=k in slot order, with its slot.

    Rows are told apart by a number of their own, so null and repeated ids are kept. Where docs has a column shard or slot,
    that of the layout has an underscore before its name.
    """
    whole, shard, slot = numbered(docs), _free("shard", docs.columns), _free("slot", docs.columns)
    where = shard_by_bytes(whole, n_shards, id_col, text_col, (ROW,)).select(ROW, F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = whole.join(where, ROW).drop(ROW)
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op1_shard_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_shard_prefix_sums": op1_shard_prefix_sums}
#: DuckDB has no crc32 over text, so the query is held against a brute-force version in tests/llm.
ORACLES: dict[str, str] = {}
