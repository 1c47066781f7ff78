"""Keyed state between micro-batches as bucketed files, of which a batch rewrites only the buckets that it changes.

``<folder>/data/<batch>/bucket=<n>`` holds the keys of a bucket as that batch left them, ``<folder>/versions/<batch>`` which
batch wrote each bucket last: a short text, written at once after the data. A batch that is repeated reads the version before
it and writes its own anew, so a failure at any point leaves the same state. The last ``keep`` versions and what they name
stay, older files go, so the folder holds about ``keep`` times what changed besides the state itself.

A null key is a key like any other. A bucket should fit a task: ``buckets`` is chosen once, when the state is first written,
and is read from the versions from then on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.plans.log import Files


class BucketedState:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.files, self.buckets, self.keep = spark, Files(spark, folder), buckets, max(2, keep)

    def _versions(self) -> list[int]:
        return [int(x) for x in self.files.list("versions")]

    def _version(self, number: int) -> dict:
        return json.loads(self.files.read(f"versions/{number:012d}"))

    def before(self, batch: int) -> dict:
        """buckets, and at: bucket to the batch that wrote it last, as they were before ``batch``."""
        earlier = [n for n in self._versions() if n < batch]
        return self._version(earlier[-1]) if earlier else {"buckets": self.buckets, "at": {}}

    def bucket(self, key: Column, batch: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.before(batch)["buckets"])).cast("int")

    def read(self, batch: int, touched: list[int], schema: StructType | str) -> DataFrame:
        """The state before ``batch`` in the buckets ``touched``."""
        at = self.before(batch)["at"]
        paths = [self.files.uri(f"data/{at[str(b)]:012d}/bucket={b}") for b in touched if str(b) in at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, batch: int, rows: DataFrame) -> list[int]:
        """Put ``rows``, with their ``bucket``, in place of all that their buckets held; returns the buckets."""
        data, version = f"data/{batch:012d}", self.before(batch)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.files.uri(data))
        changed = [int(x.removeprefix("bucket=")) for x in self.files.list(data)]
        self.files.replace(f"versions/{batch:012d}", json.dumps(version | {"at": version["at"] | {str(b): batch for b in changed}}))
        self._clear(batch)
        return changed

    def _clear(self, batch: int) -> None:
        versions = [n for n in self._versions() if n <= batch]
        named = {(n, int(b)) for v in versions[-self.keep :] for b, n in self._version(v)["at"].items()}
        for v in versions[: -self.keep]:
            self.files.delete(f"versions/{v:012d}")
        for folder in self.files.list("data"):
            n = int(folder)
            if n >= batch:
                continue
            here = [int(x.removeprefix("bucket=")) for x in self.files.list(f"data/{folder}")]
            for b in here:
                if (n, b) not in named:
                    self.files.delete(f"data/{folder}/bucket={b}")
            if not any((n, b) in named for b in here):
                self.files.delete(f"data/{folder}")
