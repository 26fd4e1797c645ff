"""Files of turns that keep arriving, appended to the bronze log turn by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from turnlake.schemas import TURNS
from turnlake.sources.turn_log import append_unseen


# Set by Spark for the jobs of a stream; the id is stored in the stream's checkpoint.
QUERY_ID = "sql.streaming.queryId"


def load_arrivals(
    spark: SparkSession,
    arrivals: str,
    bronze: str,
    checkpoint: str,
    stream: str,
    bytes_per_batch: int = 64 << 30,
) -> StreamingQuery:
    """Load every file that has not been loaded, then stop.

    ``stream`` names this stream among the loads of the log. A batch that is run again after
    a failure has the same load id and rewrites what it wrote before. A new checkpoint has
    load ids of its own, even under an old name. A backlog is loaded in batches of at most
    ``bytes_per_batch``.
    """

    def load(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        append_unseen(batch, bronze, f"{stream}-{query}-{number}")

    return (
        spark.readStream.schema(TURNS)
        .option("maxBytesPerTrigger", str(bytes_per_batch))
        .parquet(arrivals)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
