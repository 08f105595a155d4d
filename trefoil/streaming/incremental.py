"""Place arriving rows into a fitted map: rows are independent, so every micro-batch is one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trefoil.operators.tsne import TSNEEmbedding


def transform_stream(embedding: TSNEEmbedding, arriving: DataFrame, path: str, checkpoint: str,
                     **options) -> StreamingQuery:
    """Append ``id, y0..`` of each micro-batch of ``arriving(id, features)`` to Parquet under ``path``.

    A batch is written to its own folder, so a retried batch replaces itself.
    """

    def place(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            embedding.transform(batch, **options).positions.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        arriving.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
