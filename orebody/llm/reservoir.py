"""Uniform sample of fixed size from data of unknown length: a geometric file per shard.

Method (Jermaine, Pol and Arumugam 2004): each shard keeps its reservoir as subsamples on disk.
Accepted records gather in a buffer; a full buffer is shuffled and written as one subsample, cut
into segments that shrink by a constant factor, over the largest segments that older subsamples
give up. How many records each older subsample really loses is hypergeometric; the difference to
its given-up segment is evened out on a small stack of records. Shards are merged in a tree by
drawing, for each, a hypergeometric number of records according to its population.
"""

from __future__ import annotations

import io
import os
import pickle
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orebody.session import cut, shared_dir

SHARD, POPULATION = "_shard", "_population"


class SegmentStore:
    """Numbered places in one file, each rewritten in place while its content fits.

    The file lies in `folder` (the one the cluster shares) once it exceeds `memory` bytes; where
    that folder is no file system path it stays in memory, bounded by the reservoir's size.
    """

    def __init__(self, folder: str | None, memory: int = 16 << 20):
        self._file = tempfile.SpooledTemporaryFile(max_size=memory, dir=folder) if folder else io.BytesIO()
        self._at: dict[int, tuple[int, int, int]] = {}
        self._end = 0

    def put(self, slot: int, records: list) -> None:
        data = pickle.dumps(records, protocol=5)
        start, room, _ = self._at.get(slot, (0, -1, 0))
        if len(data) > room:
            start, room = self._end, len(data) * 5 // 4
            self._end += room
        self._file.seek(start)
        self._file.write(data)
        self._at[slot] = (start, room, len(data))

    def get(self, slot: int) -> list:
        start, _, size = self._at[slot]
        self._file.seek(start)
        return pickle.loads(self._file.read(size))

    def close(self) -> None:
        self._file.close()


class _Subsample:
    def __init__(self) -> None:
        self.segments: list[tuple[int, int]] = []  # slot and number of records, the largest first
        self.tail: list = []
        self.stack: list = []

    def __len__(self) -> int:
        return sum(n for _, n in self.segments) + len(self.tail) + len(self.stack)


class GeometricFile:
    """Reservoir of `capacity` records on disk; every record offered is equally likely to be in it."""

    def __init__(self, capacity: int, rng: np.random.Generator, folder: str | None = None, buffer: int | None = None, least_segment: int = 4):
        self.capacity, self.rng, self.least = capacity, rng, least_segment
        self.room = max(1, min(buffer or max(capacity // 8, min(capacity, 64)), capacity))
        self.seen = 0
        self.buffer: list = []
        self.subsamples: list[_Subsample] = []
        self.store = SegmentStore(folder)
        self._slots = 0

    def accept(self, n: int) -> np.ndarray:
        """Which of the next `n` records go into the sample; the caller offers those by `insert`."""
        order = np.arange(self.seen + 1, self.seen + n + 1, dtype=np.float64)
        taken = self.rng.random(n) * order < self.capacity
        self.seen += n
        return np.flatnonzero(taken)

    def insert(self, record: object) -> None:
        held = len(self.buffer)
        if self._filled() and held and self.rng.random() * self.capacity < held:
            self.buffer[int(self.rng.integers(held))] = record
            return
        self.buffer.append(record)
        if len(self.buffer) >= (self.room if self._filled() else min(self.room, self.capacity - self._on_disk())):
            self._flush()

    def _on_disk(self) -> int:
        return sum(map(len, self.subsamples))

    def _filled(self) -> bool:
        return self._on_disk() >= self.capacity

    def _flush(self) -> None:
        fresh, self.buffer = self.buffer, []
        self.rng.shuffle(fresh)
        free = self._evict(len(fresh)) if self._filled() else []
        new, share, rest = _Subsample(), self.room / self.capacity, fresh
        while len(rest) > self.least:
            n = max(self.least, round(len(rest) * share)) if share < 1 else len(rest)
            slot = free.pop(0) if free else self._slots
            self._slots = max(self._slots, slot + 1)
            self.store.put(slot, rest[:n])
            new.segments.append((slot, min(n, len(rest))))
            rest = rest[n:]
        new.tail = rest
        self.subsamples = [s for s in self.subsamples if len(s)] + [new]

    def _evict(self, n: int) -> list[int]:
        """Drops `n` random records; returns the slots of the segments given up, the largest first."""
        lost = self.rng.multivariate_hypergeometric([len(s) for s in self.subsamples], n)
        free = []
        for s, victims in zip(self.subsamples, map(int, lost)):
            if s.segments:
                slot, held = s.segments.pop(0)
                free.append((held, slot))
                keep = max(0, held - victims)
                if keep:
                    s.stack += self.store.get(slot)[:keep]
                victims = max(0, victims - held)
            while victims:
                pile = s.stack or s.tail
                if not pile:
                    slot, held = s.segments.pop(0)
                    free.append((held, slot))
                    s.stack += self.store.get(slot)
                    continue
                cut = min(victims, len(pile))
                del pile[len(pile) - cut :]
                victims -= cut
        return [slot for _, slot in sorted(free, reverse=True)]

    def sample(self) -> list:
        """The records now in the sample; the file is used up."""
        if self.buffer and self._filled():
            self._evict(len(self.buffer))
        out = list(self.buffer)
        for s in self.subsamples:
            out += s.tail + s.stack
            for slot, _ in s.segments:
                out += self.store.get(slot)
        self.store.close()
        return out


def population_draw(populations: list[int], n: int, rng: np.random.Generator) -> list[int]:
    """How many of `n` draws without replacement come from each population, whatever their size."""
    left, counts = list(populations), [0] * len(populations)
    for _ in range(min(n, sum(left))):
        at, total = 0, sum(left)
        ticket = int(rng.integers(total)) if total < 1 << 62 else int(rng.random() * total)
        while ticket >= left[at]:
            ticket -= left[at]
            at += 1
        left[at] -= 1
        counts[at] += 1
    return counts


def fixed_size_sample(df: DataFrame, size: int, *, seed: int = 42, fan_in: int = 64) -> DataFrame:
    """`size` rows of `df`, every row equally likely; all rows if there are fewer.

    Nulls, repeated rows and clashing names need no care: rows are sampled whole, as delivered, a
    repeated row as often as it stands there. An empty table gives no rows. One pass over the
    input; what moves is at most `size` rows a shard, and no task holds more than `fan_in` samples.
    """
    if size < 1:
        raise ValueError("size must be positive")
    names = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*names)
    kept = T.StructType([*flat.schema.fields, T.StructField(SHARD, T.LongType()), T.StructField(POPULATION, T.LongType())])
    where = urlparse(shared_dir(df.sparkSession))
    folder = where.path if where.scheme in ("", "file") else None
    arrow = to_arrow_schema(kept)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        file = GeometricFile(size, np.random.default_rng([seed, number]), folder if folder and os.path.isdir(folder) else None)
        for batch in batches:
            for i in file.accept(batch.num_rows):
                file.insert(tuple(column[int(i)].as_py() for column in batch.columns))
        rows = file.sample()
        if rows:
            columns = [*map(list, zip(*rows)), [number] * len(rows), [file.seen] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def merge(key: tuple, rows: pa.Table, level: int) -> pa.Table:
        rng = np.random.default_rng([seed, level, rows.num_rows, key[0].as_py()])
        ids, pops = rows[SHARD].to_numpy(), rows[POPULATION].to_numpy()
        order = np.argsort(ids, kind="stable")
        shards, starts, lens = np.unique(ids[order], return_index=True, return_counts=True)
        sizes = [int(pops[order[s]]) for s in starts]
        picked = [order[s + rng.permutation(n)[:k]] for s, n, k in zip(starts, lens, population_draw(sizes, size, rng))]
        out = rows.take(pa.array(np.concatenate(picked)))
        n = out.num_rows
        return out.set_column(out.num_columns - 2, SHARD, pa.array([key[0].as_py()] * n, pa.int64())).set_column(out.num_columns - 1, POPULATION, pa.array([sum(sizes)] * n, pa.int64()))

    sample = cut(flat.mapInArrow(shard, kept))
    # as many rounds as the shards that did come out need, however the input was partitioned
    shards, level = (sample.agg(F.max(SHARD)).first()[0] or 0) + 1, 1
    while level == 1 or shards > 1:

        def merging(key: tuple, rows: pa.Table) -> pa.Table:
            return merge(key, rows, level)

        sample = sample.groupBy(F.floor(F.col(SHARD) / fan_in).cast("bigint").alias("_group")).applyInArrow(merging, kept)
        shards, level = -(-shards // fan_in), level + 1
    return sample.select(*names).toDF(*df.columns)
