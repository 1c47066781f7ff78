"""A stream of responses to two sinks, the client's replies and the store, from one pass over each micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from larder.operators import cache
from larder.plans.store import VersionedStore


def tee_batches(responses: DataFrame, folder: str, marks: str, store: VersionedStore, name: str, stream: str, order: Sequence[str], may: Column) -> StreamingQuery:
    """Starts a stream of responses (key, body, the columns of ``order``), run until all are read.

    A micro-batch is read once. All of it goes to ``folder``/batch=N, written anew if the batch is repeated; the last body, in
    ``order``, of each key among the responses that ``may`` be stored is put to the store under the batch's name, which the
    store takes once. So a batch that fails between the sinks, or after both, leaves them as one run would have.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            store.put(name, cache.latest(batch.where(may), order), part=f"{stream}-{number}")
        finally:
            batch.unpersist()

    return responses.writeStream.foreachBatch(apply).option("checkpointLocation", marks).trigger(availableNow=True).start()
