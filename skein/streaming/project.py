"""Placing a stream's rows with a fitted model, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skein.plans.embed import Model, transform


def project_stream(stream: DataFrame, model: Model, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, n_epochs: int = 0) -> StreamingQuery:
    """Starts a query that hands (key, y) of each batch to sink. Placing is frozen: a row's place does not depend on its batch. n_epochs 0
    places rows at their neighbours' mean."""

    def one(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            sink(transform(model, batch, key, n_epochs=n_epochs, frozen=True), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
