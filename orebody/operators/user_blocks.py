"""Weighted deviations of a user's neighbours, block of users by block of users.

Pairs of users with a common item are far more than ratings, so none is written: users to predict for
(left) and all users (right) fall into blocks, a task takes one block of each, forms the pairs' sums in
pieces of bounded size, turns them into correlations and these into the sums that the predictions need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.session import ship_package, written

#: Ratings that a block should hold at most, and pairs that are formed at a time.
BLOCK, ROOM = 1 << 21, 1 << 21


class Side:
    """Users of one block with their ratings, as flat arrays; `want` has the items to predict."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = {k: pa.concat_arrays(table[k].chunks) for k in ("items", "ratings", "want")}
        self.ids = table["u"].to_numpy()
        self.sizes = np.diff(lists["items"].offsets.to_numpy())
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.items, self.ratings = lists["items"].flatten().to_numpy(), lists["ratings"].flatten().to_numpy()
        self.mean = np.bincount(self.owner, self.ratings, len(self.ids)) / np.maximum(self.sizes, 1)
        want = lists["want"].fill_null([])
        self.want, self.want_owner = want.flatten().to_numpy(), np.repeat(np.arange(len(self.ids)), np.diff(want.offsets.to_numpy()))

    def take_out(self, item: int) -> None:
        """Moves the ratings of `item` to `hub`, a number a user, NaN without one."""
        self.hub, at = np.full(len(self.ids), np.nan), self.items == item
        self.hub[self.owner[at]] = self.ratings[at]
        self.owner, self.items, self.ratings = self.owner[~at], self.items[~at], self.ratings[~at]


def _spans(work: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about `room` work each."""
    ends, at = np.cumsum(work), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
        yield at, to
        at = to


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places starts[row] ... starts[row] + counts[row] - 1."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[row]


def _weights(n: np.ndarray, x: np.ndarray, y: np.ndarray, xy: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """`recommend.pearson` in numpy."""
    vx, vy = np.maximum(n * xx - x * x, 0.0), np.maximum(n * yy - y * y, 0.0)
    flat = (vx < 1e-9) | (vy < 1e-9)
    return np.round(np.where(flat, 0.0, (n * xy - x * y) / np.sqrt(np.where(flat, 1.0, vx * vy))), 9)


def deviations(left: Side, right: Side, hub: int, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted item of the left users: the sum of w * (rating - mean) over its raters on the right, and of |w|.

    w is the correlation of two users with at least two common items. Those of `hub`, the item with the
    most raters, are not paired: they add to pairs that share another item too.
    """
    top, below = np.zeros(len(left.want)), np.zeros(len(left.want))
    left.take_out(hub)
    right.take_out(hub)
    users = len(right.ids)
    names, item = np.unique(right.items, return_inverse=True)
    order = np.argsort(item, kind="stable")
    raters, y_all = right.owner[order], right.ratings[order]
    counts = np.bincount(item, minlength=len(names))
    starts = np.cumsum(counts) - counts

    def found(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the raters of each item."""
        if not len(names):
            return np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(names, items), len(names) - 1)
        return starts[at], np.where(names[at] == items, counts[at], 0)

    start, count = found(left.items)
    want_start, want_count = found(left.want)
    want_hub = left.want == hub
    want_count[want_hub] = 0
    hub_place = np.full(len(left.ids), -1)
    hub_place[left.want_owner[want_hub]] = np.flatnonzero(want_hub)
    first, want_first = np.searchsorted(left.owner, np.arange(len(left.ids) + 1)), np.searchsorted(left.want_owner, np.arange(len(left.ids) + 1))
    work = np.bincount(left.owner, count, len(left.ids)).astype(np.int64)
    for a, b in _spans(work, room):
        own = slice(first[a], first[b])
        row, at = _spread(start[own], count[own])
        codes = left.owner[own][row] * users + raters[at]
        order = np.argsort(codes)
        codes = codes[order]
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        codes, n = codes[begin], np.diff(begin, append=len(codes))
        hx, hy = left.hub[codes // users], right.hub[codes % users]
        both = ~np.isnan(hx) & ~np.isnan(hy)
        keep = n + both >= 2
        order = order[np.repeat(keep, n)]
        codes, n, both = codes[keep], n[keep], both[keep]
        if not len(codes):
            continue
        hx, hy = np.where(both, hx[keep], 0.0), np.where(both, hy[keep], 0.0)
        x, y = left.ratings[own][row[order]], y_all[at[order]]
        begin = np.cumsum(n) - n
        total = lambda v, h: np.add.reduceat(v, begin) + h  # noqa: E731, B023
        w = _weights(n + both, total(x, hx), total(y, hy), total(x * y, hx * hy), total(x * x, hx * hx), total(y * y, hy * hy))
        codes, w = codes[w != 0], w[w != 0]
        if not len(codes):
            continue
        place, rater = hub_place[codes // users], codes % users
        of_hub = (place >= 0) & ~np.isnan(right.hub[rater])
        np.add.at(top, place[of_hub], w[of_hub] * (right.hub - right.mean)[rater[of_hub]])
        np.add.at(below, place[of_hub], np.abs(w[of_hub]))
        keys = np.arange(want_first[a], want_first[b])
        for c, d in _spans(want_count[keys], room):
            k = keys[c:d]
            row, at = _spread(want_start[k], want_count[k])
            wanted = left.want_owner[k][row] * users + raters[at]
            met = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            hit = codes[met] == wanted
            row, at, v = row[hit], at[hit], w[met[hit]]
            top[k] += np.bincount(row, v * (y_all[at] - right.mean[raters[at]]), len(k))
            below[k] += np.bincount(row, np.abs(v), len(k))
    return top, below


def _cells(hub: int, across: int, room: int):
    """The task: rows (cell, right, u, items, ratings, want), sorted by the first two, to (u, i, mean, top, below)."""

    def ended(cell: int, held: list[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        if not held[0]:
            return
        left = Side(held[0])
        mean, top, below = left.mean[left.want_owner], np.zeros(len(left.want)), np.zeros(len(left.want))
        if held[1]:
            top, below = deviations(left, Side(held[1]), hub, room)
        keep = np.flatnonzero((below > 0) | (cell % across == 0))  # the first cell of a left block has all its keys
        for k in range(0, len(keep), 65536):
            p = keep[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(v[p]) for v in (left.ids[left.want_owner], left.want, mean, top, below)], names=["u", "i", "mean", "top", "below"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], []]
        for batch in batches:
            cell, right = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(right) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                if a == b:
                    continue
                if cell[a] != now:
                    if now is not None:
                        yield from ended(now, held)
                    now, held = cell[a], [[], []]
                held[right[a]].append(batch.slice(a, b - a))
        if now is not None:
            yield from ended(now, held)

    return run


def neighbour_sums(ratings: DataFrame, keys: DataFrame, *, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """(u, i, mean, top, below) for each key (user, item) of a known user; u and i are hashes.

    mean is the user's; top and below are the sums of `deviations`. `ratings` is read once; if it comes
    partitioned by user, it is not shuffled again. Users and items are told apart by 64-bit hashes.
    """
    spark = ratings.sparkSession
    ship_package(spark)
    own = ratings.groupBy("user").agg(F.collect_list(F.struct(F.xxhash64("item").alias("i"), F.col("rating").alias("r"))).alias("own"))
    wanted = keys.groupBy("user").agg(F.collect_list(F.xxhash64("item")).alias("want"))
    users = written(own.join(wanted, "user", "left").select(F.xxhash64("user").alias("u"), F.col("own.i").alias("items"), F.col("own.r").alias("ratings"), "want"))
    most = users.select(F.explode("items").alias("i")).groupBy("i").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "i").first()
    size = users.agg(F.sum(F.when(F.col("want").isNotNull(), F.size("items"))).alias("left"), F.sum(F.size("items")).alias("all")).first()
    down, across = -(-(size["left"] or 1) // block), -(-(size["all"] or 1) // block)
    while down * across < 2 * spark.sparkContext.defaultParallelism:  # a row more repeats all ratings, a column more those of the left
        down, across = (down + 1, across) if (down + 1) * (size["left"] or 1) <= across * (size["all"] or 1) else (down, across + 1)
    place = lambda seed, n: F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(n)).cast("int")
    cells = lambda cell, side, want: [cell.alias("cell"), F.lit(side).alias("right"), "u", "items", "ratings", want.alias("want")]
    one = users.where(F.col("want").isNotNull()).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(*cells(place(1, down) * across + F.col("q"), 0, F.col("want")))
    two = users.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(*cells(F.col("p") * across + place(2, across), 1, F.lit(None).cast("array<bigint>")))
    met = one.unionByName(two).repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "right")
    out = met.mapInArrow(_cells(most["i"] if most else 0, across, room), "u bigint, i bigint, mean double, top double, below double")
    return out.groupBy("u", "i").agg(F.max("mean").alias("mean"), F.sum("top").alias("top"), F.sum("below").alias("below"))
