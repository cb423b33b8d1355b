"""The resumable result log as a stream: new work arrives as files, finished ids are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.results import append_predictions


def answer_new_work(spark: SparkSession, inbox: str, schema: str, log: str, checkpoint: str,
                    answer: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process everything in ``inbox`` once and stop; run again to continue.

    A batch that is replayed after a failure finds its finished ids in the log and appends the
    rest only.
    """
    work = spark.readStream.schema(schema).json(inbox)

    def handle(batch: DataFrame, _: int) -> None:
        append_predictions(batch.dropDuplicates(["id"]), log, answer)

    return (
        work.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
