"""Structured Streaming: announcements that refresh a consumer, and mutation events that feed a producer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators.dataset import Dataset
from ..operators.lifecycle import Consumer, Producer


def follow_announcements(spark: SparkSession, consumer: Consumer, checkpoint: str, then: Callable[[Dataset], None] | None = None) -> StreamingQuery:
    """Refresh the consumer as manifests appear; each batch goes to the version that is announced by then."""
    stream = spark.readStream.schema("version long, base long, snapshot boolean").json(f"{consumer.store.root}/manifest")

    def batch(df: DataFrame, _: int) -> None:
        state = consumer.refresh()
        if then and state is not None:
            then(state)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def apply_mutations(events: DataFrame, producer: Producer, t: str, keys: Sequence[str], checkpoint: str, sequence: str = "seq", action: str = "action") -> StreamingQuery:
    """Each micro-batch of keyed mutations becomes an incremental cycle; a batch that is replayed changes nothing a second time."""
    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        if not df.limit(1).isEmpty():
            producer.run_incremental(t, df, keys, sequence, action)
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def change_rates(events: DataFrame, time: str, action: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Mutations by action and time window, late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), action).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), action, "n")
