"""Exactly-once ingestion of a stream of messages delivered at least once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veridraft.operators.exactly_once import SeenStore, accepted


def ingest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Passes to ``sink`` the rows of each micro-batch whose identifier was not seen before, one for each
    identifier, and every row without one. The store under ``state`` remembers identifiers across batches and
    restarts.

    A batch is handed to the sink before the store commits it. A batch repeated after a failure between the two
    reaches the sink again with the same number, so the sink must be idempotent in it.
    """

    def each(batch: DataFrame, number: int) -> None:
        store = SeenStore(batch.sparkSession, state)
        result = store.ingest(batch, keys, order, commit=False)
        sink(accepted(batch, result), number)
        store.commit()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
