"""Detections of finished tasks into zones, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborscan.plans import zone_merge


def merge_stream(detections: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Run the zone merge on every micro-batch; tasks merged before are skipped."""

    def save(batch: DataFrame, number: int) -> None:
        zone_merge.save_tasks(batch.sparkSession, folder, batch, **options)

    return (detections.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
