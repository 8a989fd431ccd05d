"""Best scores and their places over a stream of arriving k-mers, held in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "branch int, code long, score double, node_order long, position int"


def best_scores(kmers: DataFrame) -> DataFrame:
    """``kmers(branch, code, score)``, batch or streaming -> the best score so far (output mode ``update`` or ``complete``)."""
    return kmers.groupBy("branch", "code").agg(F.max("score").alias("score"))


class FirstBest(StatefulProcessor):
    """Of each (branch, code): the best score, and of equal ones the first node and position. A row that comes again changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "score double, node_order long, position int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.best.get() if self.best.exists() else None
        now = held
        for frame in rows:
            first = frame.sort_values(["score", "node_order", "position"], ascending=[False, True, True]).iloc[0]
            new = (float(first["score"]), int(first["node_order"]), int(first["position"]))
            if now is None or (-new[0], *new[1:]) < (-now[0], *now[1:]):
                now = new
        if now is not None and now != held:
            self.best.update(now)
            yield pd.DataFrame({"branch": [key[0]], "code": [key[1]], "score": [now[0]], "node_order": [now[1]], "position": [now[2]]}).astype({"branch": "int32", "position": "int32"})

    def close(self) -> None:
        pass


def first_best(kmers: DataFrame) -> DataFrame:
    """A stream ``kmers(branch, code, score, node_order, position)`` -> changes of each pair's best score and its first place (output mode ``update``)."""
    spark = kmers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return kmers.groupBy("branch", "code").transformWithStateInPandas(FirstBest(), OUT, "Update", "None")


def run_to_end(spark: SparkSession, files: str, path: str, files_a_batch: int = 1) -> DataFrame:
    """Run over all Parquet ``files`` of k-mers there now, in batches, and return the state's last word on each pair.

    The changes of a batch go to a folder of its own under ``path``; a batch that is run again replaces it. A later
    run over the same ``path`` goes on where this one ended.
    """
    source = spark.readStream.schema(OUT).option("maxFilesPerTrigger", files_a_batch).parquet(files)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    query = first_best(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(f"{OUT}, batch long").parquet(f"{path}/changes")
    last = F.struct("score", "node_order", "position")
    return changes.groupBy("branch", "code").agg(F.max_by(last, "batch").alias("last")).select("branch", "code", "last.*")
