"""The ingestion run as a stream: landed entries become items in micro-batches, each checked against the whole store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import changes, ingest
from ..operators.store import Store
from ..schema import NEWS_ITEMS
from ..service import Busy, Service

LANDED = "source_id int, source_rank bigint, entry_pos bigint, title string, url string, content string, published_at string, image_url string"


def start(
    spark: SparkSession, landing: str, sources: DataFrame, store: Store, checkpoint: str, now: Callable[[], datetime], complete: Callable[[dict], str | None] | None = None,
    cap: int = 0, every: str | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """A query from the Parquet files in ``landing`` to the store's items; once through what is there, or on and on with ``every``.

    A hash is never forgotten as long as its item is stored, so there is no watermark: each batch is held against the stored items.
    A batch that is run again after a failure finds its items stored and adds nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        stored = store.read("items", NEWS_ITEMS)
        run = ingest.ingest(df, sources, stored, now(), complete, cap)
        new = changes.next_ids(run.items, stored, ["source_rank", "entry_pos"]).select(*stored.columns)
        store.append("items", new)

    source = spark.readStream.schema(LANDED)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    out = source.parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def scheduled(service: Service, checkpoint: str, every: str = "1 hour", complete: Callable[[dict], str | None] | None = None, settings: Settings | None = None) -> StreamingQuery:
    """A query that has the service fetch its due sources now and again after each ``every``; a tick while a run is going on is passed over."""

    def tick(_: DataFrame, number: int) -> None:
        try:
            service.ingest(complete, settings=settings)
        except Busy:
            return

    clock = service.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
