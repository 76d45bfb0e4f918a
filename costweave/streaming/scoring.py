"""Scoring of requests as they arrive: the batch scoring, applied to each micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from costweave.plans.scoring import score, valid_requests
from costweave.sources.state import TrainingState


def score_stream(
    requests: DataFrame, state: TrainingState, out_folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start a query that writes scored requests below out_folder, one folder per micro-batch.

    A repeated batch overwrites its own folder, so every request is written once; another checkpoint counts
    its batches from 0 again, and writes to folders of its own. Scoring keeps no state between batches.
    """
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        score(valid_requests(batch), state).write.mode("overwrite").parquet(f"{out_folder}/run={run}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
