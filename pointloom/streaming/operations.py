"""A stream of operations applied to a collection, one version a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pointloom.sources.collection import Collection

OPERATIONS = "seq long, kind string, id long, vector array<double>, payload string"


def apply_operations(operations: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """operations: rows (seq, kind `upsert` or `delete`, id, vector, payload), of which an id's last in a micro-batch, by
    seq, is what counts. Takes what is there, then stops. The collection keeps the number of each micro-batch with its
    version, under the checkpoint's name, so one that is run again after a failure changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        collection.apply(batch, source=checkpoint, epoch=epoch)

    return operations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
