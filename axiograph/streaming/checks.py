"""Rule checks over a stream of triples: what has come so far is kept as a store, and reported on as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from axiograph.operators import report


def check_stream(triples: DataFrame, path: str, checkpoint: str, profile: dict[str, str] | None = None, once: bool = False) -> StreamingQuery:
    """Start a query that adds each micro-batch to a store at path/store and writes the violations of the whole store as Parquet to
    path/report/batch=N, so that the last report doesn't depend on how the stream was cut. A batch that is run again after
    a failure overwrites its own folders."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/store/batch={number}")
        whole = spark.read.schema(batch.schema).parquet(f"{path}/store")
        report.report(whole, profile).write.mode("overwrite").parquet(f"{path}/report/batch={number}")

    writer = triples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
