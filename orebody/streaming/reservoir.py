"""Algorithm R (Vitter 1985) as a stateful processor: a reservoir and the counts of its tags, group by group."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_OUT = "shard bigint, seen bigint, tag string, n bigint"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlgorithmR(StatefulProcessor):
    """Keeps `size` of the records of a group, each equally likely, and how often each tag stands in them.

    State: the number of records seen and the tags of each kept one, so a tag leaves the counts with
    its record. Draws depend on the seed, the group and the number seen: a repeated batch repeats them.
    """

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        self.kept = handle.getMapState("kept", "slot int", "tags array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        changed: dict[int, list[str]] = {}
        rng = np.random.default_rng([self.seed, int(key[0]), seen])
        for part in rows:
            for tags in part["tags"]:
                slot = seen if seen < self.size else int(rng.integers(seen + 1))
                if slot < self.size:
                    changed[slot] = list(tags)
                seen += 1
        for slot, tags in changed.items():
            self.kept.updateValue((slot,), (tags,))
        self.seen.update((seen,))
        counts = Counter(tag for _, (tags,) in self.kept.iterator() for tag in tags)
        yield pd.DataFrame([(key[0], seen, t, n) for t, n in sorted(counts.items())], columns=["shard", "seen", "tag", "n"])

    def close(self) -> None:
        pass


def reservoir_counts(stream: DataFrame, *, key: str, tags: str, size: int = 150, shards: int = 1, seed: int = 42) -> DataFrame:
    """Streaming (shard, seen, tag, n): after each batch the tags in the reservoir of each shard that got rows.

    `tags` is an array of strings; rows without a key or without tags, and nulls among the tags, are
    left out. One shard is one reservoir of the whole stream; several take the keys by hash, each its
    own. The state of a shard has at most `size` records, whatever it has seen.
    """
    # the worker beside the driver does not see files shipped to executors
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    rows = stream.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.array_compact(tags).alias("tags")).where(F.size("tags") > 0)
    return rows.groupBy("shard").transformWithStateInPandas(AlgorithmR(size, seed), _OUT, "Update", "None")


def write_counts(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the counts after each batch to `path/batch=N`, with the time of writing."""

    def step(rows: DataFrame, batch: int) -> None:
        rows.withColumn("time", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
