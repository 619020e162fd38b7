"""Has this key been seen before? Elias-Fano sets of hash partitions.

A key becomes a 64-bit hash. Its leading bits name a hash partition; the rest of the earlier
hashes of a partition are kept sorted in an Elias-Fano code: the high bits in unary, the low bits
packed. A probe finds the successor of its hash; the key was seen if the successor is the hash
itself. The stream is worked off in pieces of its order; after each piece its new hashes are merged
into the code of their partition. Each piece is a quarter larger than the last, so that merges cost a
fixed number of steps a key however long the stream is; a few probes of a large code start at
sampled places of its unary bits, many decode it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EliasFano:
    """Sorted distinct numbers below 2**bits in about 2 + bits - log2(n) bits each."""

    def __init__(self, values: np.ndarray, bits: int):
        values = np.asarray(values, dtype=np.uint64)
        self.n, self.bits = len(values), bits
        self.low_bits = max(0, min(56, bits - max(0, int(np.log2(max(self.n, 1))))))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if self.n else 0
        unary = np.zeros(self.n + self.buckets, dtype=np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = np.concatenate([np.packbits(unary), np.zeros(1, np.uint8)])
        # the first value of every 64th bucket: with the number of zeros before it, a place in the unary bits
        self.sampled = np.searchsorted(high, np.arange(0, self.buckets + 1, 64)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        self.low = np.concatenate([np.packbits(((low[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if self.low_bits else np.zeros(0, np.uint8) for i in range(0, max(self.n, 1), 65536)] + [np.zeros(8, np.uint8)])

    @property
    def size_in_bytes(self) -> int:
        return len(self.high) + len(self.low) + self.sampled.nbytes

    def _starts(self) -> np.ndarray:
        """Index of the first value of each bucket, and n at the end (select of the zeros)."""
        zeros = np.flatnonzero(np.unpackbits(self.high, count=self.n + self.buckets) == 0)
        return np.concatenate([[0], zeros - np.arange(self.buckets)]).astype(np.int64)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word |= self.low[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        starts = self._starts()
        high = np.repeat(np.arange(self.buckets, dtype=np.uint64), np.diff(starts)) if self.n else np.zeros(0, np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(np.arange(self.n))

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value not below each probe, and whether there is one."""
        probes = np.asarray(probes, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(probes), np.uint64), np.zeros(len(probes), bool)
        return self._sampled_successor(probes) if len(probes) * 256 < self.n else self._decoded_successor(probes)

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.high[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1

    def _sampled_successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the sampled place before each probe's bucket, bit by bit; all probes step together."""
        length = self.n + self.buckets
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        bucket = np.minimum(high, self.buckets) >> 6 << 6
        place = self.sampled[bucket >> 6] + bucket
        open_ = np.flatnonzero(place < length)
        while len(open_):
            at, inside = place[open_], bucket[open_]
            one = self._bit(at) == 1
            reached = one & (inside >= high[open_])
            reached[reached] = (inside[reached] > high[open_][reached]) | (self._lows((at - inside)[reached]) >= low[open_][reached])
            bucket[open_[~one]] += 1
            open_ = open_[~reached]
            place[open_] += 1
            open_ = open_[place[open_] < length]
        found = place < length
        value = np.zeros(len(probes), np.uint64)
        value[found] = (bucket[found].astype(np.uint64) << np.uint64(self.low_bits)) | self._lows((place - bucket)[found])
        return value, found

    def _decoded_successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._starts()
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < self.buckets
        h = np.minimum(high, self.buckets - 1)
        at, end = np.where(inside, starts[h], self.n), np.where(inside, starts[h + 1], self.n)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):  # buckets hold about one value each, as the numbers are hashes
            behind = self._lows(at[open_]) < low[open_]
            at[open_[behind]] += 1
            open_ = open_[behind]
            open_ = open_[at[open_] < end[open_]]
        found = at < self.n
        where = np.minimum(at, self.n - 1)
        bucket = np.searchsorted(starts, where, side="right") - 1
        return (bucket.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(where), found

    def contains(self, probes: np.ndarray) -> np.ndarray:
        value, found = self.successor(probes)
        return found & (value == np.asarray(probes, dtype=np.uint64))

    def merged(self, fresh: np.ndarray) -> EliasFano:
        """With more sorted numbers, none of them held yet."""
        old = self.values()
        return EliasFano(np.insert(old, np.searchsorted(old, fresh), fresh), self.bits)


def _known(key: str) -> Column:
    return F.col(key).isNotNull() & F.col(key).cast("string").rlike(r"\S")


def mixed(key: Column, bits: int) -> Column:
    """The leading bits, at most 64, of a fast hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits < 64 else F.xxhash64(key)


def digested(key: Column, bits: int) -> Column:
    """The leading bits, at most 60, of a hash that any database can compute."""
    return F.shiftrightunsigned(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), 60 - bits)


def _pieces(stream: DataFrame, order: str, first: int, growth: float) -> tuple[Column, int]:
    """Number of the piece of a row by its place between the least and greatest order number, and the number of rows."""
    ends = stream.agg(F.min(order).cast("bigint").alias("low"), F.max(order).cast("bigint").alias("high"), F.count(order).alias("n")).first()
    if not ends["n"]:
        return F.lit(0).cast("bigint"), 0
    rank = (F.col(order).cast("bigint") - ends["low"]).cast("double") * (ends["n"] / (ends["high"] - ends["low"] + 1.0))
    return F.floor(F.log(1 + rank * ((growth - 1) / first)) / log(growth)).cast("bigint"), ends["n"]


def first_arrivals(stream: DataFrame, history: DataFrame, *, key: str, order: str, history_key: str | None = None, bits: int = 64, prefix_bits: int | None = None, piece: int = 1 << 17, growth: float = 1.25, hashed: Callable[[Column, int], Column] = mixed) -> DataFrame:
    """(_h, _first): hash of each key not in `history`, and the order number of its first row.

    The first piece has about `piece` rows, each further one `growth` times as many as the one before.
    What moves is one row a distinct key and piece, combined before the shuffle, so a key with a
    third of all rows costs one row a piece. A task streams through sorted hash partitions, by default
    as many as keep about 2**18 keys each, and holds one Elias-Fano code and one piece of it.
    """
    known = stream.where(_known(key) & F.col(order).isNotNull())
    number, n = _pieces(known, order, piece, growth)
    if prefix_bits is None:
        prefix_bits = min(bits - 1, max(8, ceil(log2(max(1, n + history.count()) / 2**18))))
    fresh = known.select(hashed(F.col(key).cast("string"), bits).alias("_h"), number.alias("_piece"), F.col(order).cast("bigint").alias("_first"))
    fresh = fresh.groupBy("_piece", "_h").agg(F.min("_first").alias("_first"))
    old = history.where(_known(history_key or key)).select(hashed(F.col(history_key or key).cast("string"), bits).alias("_h")).distinct().select(F.lit(None).cast("bigint").alias("_piece"), "_h", F.lit(None).cast("bigint").alias("_first"))
    rows = fresh.unionByName(old).withColumn("_part", F.shiftrightunsigned("_h", bits - prefix_bits))
    rows = rows.repartition("_part").sortWithinPartitions("_part", F.asc_nulls_first("_piece"), "_h")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, piece_no, waiting = None, None, None, []
        mask = np.uint64((1 << (bits - prefix_bits)) - 1)

        def settle() -> None:
            nonlocal code, waiting
            if waiting:
                code, waiting = code.merged(np.concatenate(waiting)), []

        for batch in batches:
            parts = batch.column(3).to_numpy()
            pieces = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            cuts = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1) | np.diff(pieces, prepend=pieces[:1]).astype(bool))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if parts[a] != part:
                    part, code, piece_no, waiting = parts[a], EliasFano(np.zeros(0), bits - prefix_bits), pieces[a], []
                elif pieces[a] != piece_no:
                    settle()
                    piece_no = pieces[a]
                own = hashes[a:b].view(np.uint64) & mask
                new = ~code.contains(own)
                waiting.append(own[new])
                if pieces[a] != np.iinfo(np.int64).min:
                    keep[a:b] = new
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(keep)), batch.column(2).filter(pa.array(keep))], names=["_h", "_first"])

    return rows.mapInArrow(probe, "_h bigint, _first bigint")


def seen_before(stream: DataFrame, history: DataFrame, *, key: str, order: str, bits: int = 64, hashed: Callable[[Column, int], Column] = mixed, **more) -> DataFrame:
    """(order, seen) of each row of `stream` with a key: whether the key is in `history` or an earlier row.

    A null or blank key or a null order number is no record and gives no row; rows with equal
    order number and key do not see each other; rows repeated as a whole come out once each. An
    empty history is allowed. A wrong answer needs two keys with equal hashes: its probability is
    (keys so far) / 2**bits a probe, and it can only be a false `true`.
    """
    first = first_arrivals(stream, history, key=key, order=order, bits=bits, hashed=hashed, **more)
    rows = stream.where(_known(key) & F.col(order).isNotNull()).select(F.col(order).cast("bigint").alias("_first"), hashed(F.col(key).cast("string"), bits).alias("_h"))
    return rows.join(first.withColumn("_new", F.lit(True)), ["_first", "_h"], "left").select(F.col("_first").alias(order), F.col("_new").isNull().alias("seen"))


def wrong_answer_rate(stream: DataFrame, history: DataFrame, *, key: str, order: str, bits: int = 64, hashed: Callable[[Column, int], Column] = mixed) -> DataFrame:
    """One row: records, how many were called seen, wrong answers by exact recount, their rate, and the rate expected."""
    known = stream.where(_known(key) & F.col(order).isNotNull())
    exact = known.groupBy(F.col(key).cast("string").alias("_k")).agg(F.min(order).cast("bigint").alias("_first"))
    exact = exact.join(history.where(_known(key)).select(F.col(key).cast("string").alias("_k")).distinct(), "_k", "left_anti")
    got = seen_before(stream, history, key=key, order=order, bits=bits, hashed=hashed)
    truly_new = exact.select(F.col("_first").alias(order), F.lit(True).alias("_new"))
    both = got.join(truly_new, order, "left")
    wrong = F.count_if(F.col("seen") == F.col("_new").isNotNull())
    keys = exact.count() + history.count()
    return both.agg(F.count("*").alias("records"), F.count_if("seen").alias("seen"), wrong.alias("wrong")).select(
        F.lit(bits).alias("bits"), "records", "seen", "wrong", F.coalesce(F.try_divide(F.col("wrong"), F.col("records")), F.lit(0.0)).alias("wrong_rate"),
        F.lit(keys / 2.0**bits).alias("expected_rate_of_new_keys"),
    )
