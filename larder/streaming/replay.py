"""Replay of a request stream with keyed state.

The state of a key is the last ok body that is not null. The rows of a key in a micro-batch are sorted by arrival; a row that comes in a
later batch is applied then, whatever its time. State has no expiry, as the batch replay has none: it grows with the
number of keys.

``replay_batches`` spreads a key's rows over periods, as the batch replay does, so a key may have any share of a
micro-batch; its state is kept in bucketed files, of which a batch reads and writes those of its keys (see ``state``). ``replay_stream`` is a streaming DataFrame with Spark's own keyed state; one task holds all rows that a key
has in a micro-batch, so it is for sources whose batches are small for every key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import cache
from larder.streaming.state import BucketedState

OUTPUT = "req_id long, key string, cached double, served double"


def replay_key(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(parts).sort_values(["arrival", "req_id"])
    cached, served = [], []
    for outcome, body in zip(rows["outcome"], rows["body"].astype(object).where(rows["body"].notna(), None), strict=True):
        cached.append(last)
        served.append(last if last is not None else None if outcome == "rejected" else body)
        if outcome == "ok" and body is not None:
            last = float(body)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame({"req_id": rows["req_id"], "key": rows["key"], "cached": pd.Series(cached, index=rows.index, dtype=float), "served": pd.Series(served, index=rows.index, dtype=float)})


def replay_stream(requests: DataFrame) -> DataFrame:
    """A streaming DataFrame of replies from GET requests req_id, arrival, key, outcome, body (double)."""
    return requests.groupBy("key").applyInPandasWithState(replay_key, OUTPUT, "last double", "append", "NoTimeout")


def replay_batches(requests: DataFrame, folder: str, marks: str, order: Sequence[str], clock: Column, buckets: int = 64) -> StreamingQuery:
    """Starts a stream of replies to GET requests (key, outcome, body and the columns of ``order``), run until all are read.

    Each micro-batch is replayed by ``cache.replay`` with ``order`` and ``clock`` on top of the state before it, of which only
    the buckets of the batch's keys are read. Replies go to ``folder``/replies/batch=N and the buckets with new values to
    ``folder``/state, both written anew if a batch is repeated. ``folder`` and ``marks`` belong together: a later run goes on
    from both.
    """

    def apply(batch: DataFrame, number: int) -> None:
        state = BucketedState(batch.sparkSession, f"{folder}/state", buckets)
        batch = batch.withColumn("bucket", state.bucket(F.col("key"), number)).persist()
        try:
            stored = batch.where((F.col("outcome") == "ok") & F.col("body").isNotNull())
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            before = state.read(number, touched, stored.select("key", "body").schema)
            rows = cache.replay(batch, order, clock, "key", "outcome", "body", before)
            rows.drop("bucket", "hit").write.mode("overwrite").parquet(f"{folder}/replies/batch={number}")
            # What the changed buckets held and what the batch stored, the batch's last value first.
            last = cache.latest(stored, order).select("key", "body", F.lit(1).alias("_new"))
            bucket = state.bucket(F.col("key"), number)
            changed = stored.select("bucket").distinct()
            held = before.withColumn("bucket", bucket).join(F.broadcast(changed), "bucket", "left_semi").select("key", "body", F.lit(0).alias("_new"))
            both = held.unionByName(last).groupBy("key").agg(F.max_by("body", "_new").alias("body"))
            state.write(number, both.withColumn("bucket", bucket))
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", marks).trigger(availableNow=True).start()
