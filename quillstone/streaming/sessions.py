"""Session state over a stream of scored events (an addition: the batch operators need no stream)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, event_id long, value double, rank long"
STATE = "ids array<long>, values array<double>"


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (shared or tempfile.mkdtemp(prefix="spark-")).rstrip("/") + "/stream-" + uuid.uuid4().hex


def best_of_stream(spark: SparkSession, path: str, k: int = 3) -> DataFrame:
    """The k best events of each user, as they stand after all files of path have been read once."""

    def keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in rows:
            best += list(zip(pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True))
            best = sorted(best, key=lambda x: (-x[1], x[0]))[:k]
        state.update(([i for i, _ in best], [v for _, v in best]))
        yield pd.DataFrame({"user_id": [key[0]] * len(best), "event_id": [i for i, _ in best], "value": [v for _, v in best], "rank": range(1, len(best) + 1)})

    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1] + "*")
    rows = stream.select("user_id", "event_id", "value").filter("user_id is not null and value is not null")
    states = rows.groupBy("user_id").applyInPandasWithState(keep, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    folder = _folder(spark)
    numbered = lambda df, n: df.selectExpr("*", f"{n} as batch").write.mode("append").parquet(f"{folder}/out")
    states.writeStream.foreachBatch(numbered).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("user_id").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return out.join(last, ["user_id", "batch"], "left_semi").drop("batch")
