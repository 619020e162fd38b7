"""Items that appear together, by a blocked Gram matrix.

Baskets are the rows of a binary matrix A; the pair counts are the entries of A'A. Items fall into
blocks, and each basket into one sparse row an item block. The product is worked off by block rows:
block p meets itself and half of the other blocks, so that each pair of blocks is met once; a task
multiplies the sparse rows of one block row, record block by record block, and sums the products.
As all records of a block row are in one task, only counts that reach `min_both` leave it. A block
row with far more than its share of the cells is split by baskets, and its partial sums are added up
afterwards. Counts are held against the counts expected from the marginals. Three cuts lose no pair:
an item in fewer than `min_both` baskets can have no partner; nor one in more than baskets /
min_ratio, because a pair occurs at most as often as its rarer item; and the (min_both - 1) largest
baskets alone cannot make a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orebody.functions.skew import hot_buckets, salt_of
from orebody.session import cut, written

#: Most bytes of item names and numbers that are broadcast; beyond, the item table is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Cells of A that a block row should hold, and most sums that a task keeps before it passes them on.
ROW_CELLS, SUMS = 1 << 20, 1 << 22


def products(own: np.ndarray, own_sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray, room: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in `own`, in `other`) of all products of each record's two sparse rows, at most about `room` at a time."""
    ends = np.cumsum(own_sizes * other_sizes)
    own_start, other_start = np.cumsum(own_sizes) - own_sizes, np.cumsum(other_sizes) - other_sizes
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + room, "right")))
        n, m = own_sizes[at:to], other_sizes[at:to]
        row = np.repeat(np.arange(to - at), n * m)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        yield own_start[at:to][row] + k // m[row], other_start[at:to][row] + k % m[row]
        at = to


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


class BlockRow:
    """Sums of the products of one block row; `partial` once some were passed on before its end."""

    def __init__(self, most: int):
        self.most, self.parts, self.held, self.partial = most, [], 0, False

    def add(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes, counts = np.unique(codes, return_counts=True)
        self.parts.append((codes, counts))
        self.held += len(codes)
        if self.held > self.most:
            sums = _summed(self.parts)
            self.parts, self.held = [sums], len(sums[0])
            if self.held > self.most // 2:
                self.parts, self.held, self.partial = [], 0, True
                yield sums

    def rest(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is left; counts below `least` only if there may be more of them elsewhere."""
        if self.parts:
            codes, counts = _summed(self.parts)
            keep = counts >= (1 if self.partial else least)
            yield codes[keep], counts[keep]


def gram_rows(blocks: int, least: int, split: set[int], most: int):
    """The task of the product: rows (_p, _s, own, other), sorted by the first two, to (_i, _j, _n), _i < _j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, BlockRow(most)

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for codes, counts in found:
                for k in range(0, len(codes), 65536):
                    c = codes[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(c >> 32), pa.array(c & 0xFFFFFFFF), pa.array(counts[k : k + 65536].astype(np.int64))], names=["_i", "_j", "_n"])

        for batch in batches:
            p, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if len(p) else []
            for a, b in zip(starts, [*starts[1:], len(p)]):
                if (p[a], s[a]) != now:
                    yield from out(sums.rest(least))
                    now, sums = (p[a], s[a]), BlockRow(most)
                    sums.partial = int(p[a]) in split
                lists = [batch.column(k).slice(a, b - a) for k in (2, 3)]
                (own, n), (other, m) = ((x.flatten().to_numpy(), np.diff(x.offsets.to_numpy())) for x in lists)
                own, other = own.astype(np.int64), other.astype(np.int64)
                for x, y in products(own, n, other, m):
                    i, j = own[x], other[y]
                    keep = (i % blocks != j % blocks) | (i < j)  # within a block both orders meet
                    i, j = i[keep], j[keep]
                    yield from out(sums.add((np.minimum(i, j) << 32) | np.maximum(i, j)))
        yield from out(sums.rest(least))

    return run


def _meets(p: Column, q: Column) -> Column:
    """Whether block row p takes block q: of p < q it does if their sum is even, else q takes p."""
    even = (p + q) % 2 == 0
    return (p == q) | ((q > p) & even) | ((q < p) & ~even)


def cooccurring_pairs(rows: DataFrame, *, basket: str, item: str, min_both: int = 8, min_ratio: float = 5.0, block: int = 2048, blocks: int | None = None, most: int = SUMS) -> DataFrame:
    """(item_1, item_2, n_both, n_1, n_2, n_baskets, ratio) of items that meet often.

    A pair comes out if at least `min_both` baskets hold both and that number is at least
    `min_ratio` times the number expected by chance, n_1 * n_2 / n_baskets. Null baskets and items
    are left out, repeated rows count once, item_1 < item_2, and an empty table gives no rows;
    other columns are not read. Baskets are told apart by a 64-bit hash of their key: among 10^9
    of them, 0.03 pairs are expected to be taken for one.

    Rows of hot items are salted before they are made distinct. A basket of more than `block` items
    is cut into pieces that meet each other piece by piece. `blocks` item blocks are made, by default
    as many as give each core two block rows and none more than about ROW_CELLS cells.
    """
    base = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("_b"), F.xxhash64(F.col(basket).cast("string")).alias("_u"))
    salt = salt_of(hot_buckets(base, "_b"), ["_b"], ["_u"])
    cells = written(base.withColumn("_salt", salt).repartition("_b", "_salt").dropDuplicates(["_b", "_salt", "_u"]).select("_b", "_u"))

    sizes = cells.groupBy("_u").agg(F.count("*").alias("_k"))
    stat = sizes.agg(F.count("*").alias("n"), F.sum("_k").alias("cells"), F.count_if(F.col("_k") > block).alias("large")).first()
    baskets = stat["n"]
    if blocks is None:
        blocks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-(stat["cells"] or 0) // ROW_CELLS))
    marginals = cells.groupBy("_b").agg(F.count("*").alias("_n")).where((F.col("_n") >= min_both) & (F.col("_n") * F.lit(float(min_ratio)) <= baskets))
    marginals = marginals.withColumn("_g", F.pmod(F.xxhash64("_b"), F.lit(blocks)).cast("int"))
    number = F.row_number().over(Window.partitionBy("_g").orderBy("_b")) - 1
    items = cut(marginals.select("_b", "_n", "_g", (number.cast("bigint") * blocks + F.col("_g")).cast("int").alias("_i")))
    loads = items.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum(F.length(F.col("_b").cast("string")) + 48).alias("bytes")).collect()  # a row a block
    fair = max(ROW_CELLS, 4 * sum(r["n"] for r in loads) // blocks)
    slices = {r["_g"]: -(-r["n"] // fair) for r in loads if r["n"] > fair}
    cells = cells.join(F.broadcast(items) if sum(r["bytes"] for r in loads) <= BROADCAST_BYTES else items, "_b").select("_u", "_i")

    heavy = None
    piece = F.lit(0)
    if stat["large"]:
        large = sizes.where(F.col("_k") > block)
        top = F.broadcast(large.orderBy(F.desc("_k"), "_u").limit(min_both - 1).select("_u"))
        heavy = cut(cells.join(top, "_u"))
        cells = cells.join(top, "_u", "left_anti").join(large, "_u", "left")
        piece = F.coalesce(F.pmod(F.xxhash64("_i"), F.ceil(F.col("_k") * 2 / block)), F.lit(0)).cast("int")
    held = cells.select("_u", "_i", piece.alias("_a"), *[F.col("_k")] * bool(stat["large"]))
    if stat["large"]:
        parts = cut(held.groupBy("_u", "_a").agg(F.collect_list("_i").alias("own"), F.first("_k").alias("_k")))
        whole = parts.where(F.col("_k").isNull()).select("_u", "own", F.col("own").alias("other"))
        cut_up = parts.where(F.col("_k").isNotNull())
        mine = cut_up.select("_u", F.pmod("_a", F.lit(16)).alias("_x"), "own")
        theirs = cut_up.select("_u", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_x"), F.col("own").alias("other"))
        meeting = whole.unionByName(mine.join(theirs, ["_u", "_x"]).select("_u", "own", "other"))
    else:
        meeting = held.groupBy("_u").agg(F.collect_list("_i").alias("own")).where(F.size("own") > 1).withColumn("other", F.col("own"))
    p = F.col("_p")
    meeting = meeting.withColumn("_p", F.explode(F.array_distinct(F.transform("own", lambda i: i % blocks))))
    share = F.lit(0)
    for g, n in slices.items():  # at most blocks / 4
        share = F.when(p == g, F.pmod(F.xxhash64("_u"), F.lit(n)).cast("int")).otherwise(share)
    strips = meeting.select(p, share.alias("_s"), F.filter("own", lambda i: i % blocks == p).alias("own"), F.filter("other", lambda i: _meets(p, i % blocks)).alias("other"))
    strips = strips.where((F.size("other") > 1) | (F.get("own", F.lit(0)) != F.get("other", F.lit(0))))
    strips = strips.repartition("_p", "_s").sortWithinPartitions("_p", "_s")
    least = min_both if heavy is None else 1
    pairs = strips.mapInArrow(gram_rows(blocks, least, set(slices), most), "_i bigint, _j bigint, _n bigint").groupBy("_i", "_j").agg(F.sum("_n").alias("_both"))
    if heavy is not None:
        n_heavy = min(min_both - 1, stat["large"])
        pairs = pairs.where(F.col("_both") >= max(1, min_both - n_heavy))
        more = pairs.join(heavy, "_i").join(heavy.select("_u", F.col("_i").alias("_j")), ["_u", "_j"]).groupBy("_i", "_j").agg(F.count("*").alias("_more"))
        pairs = pairs.join(more, ["_i", "_j"], "left").withColumn("_both", F.col("_both") + F.coalesce("_more", F.lit(0))).drop("_more")
    pairs = pairs.where(F.col("_both") >= min_both)
    a = items.select("_i", F.col("_b").alias("a_b"), F.col("_n").alias("a_n"))
    b = items.select(F.col("_i").alias("_j"), F.col("_b").alias("b_b"), F.col("_n").alias("b_n"))
    pairs = pairs.join(a.hint("merge"), "_i").join(b.hint("merge"), "_j").where(F.col("_both").cast("double") * baskets >= F.col("a_n").cast("double") * F.col("b_n") * float(min_ratio))
    first = F.col("a_b") < F.col("b_b")
    return pairs.select(
        F.least("a_b", "b_b").alias("item_1"), F.greatest("a_b", "b_b").alias("item_2"), F.col("_both").alias("n_both"),
        F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("n_1"), F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("n_2"),
        F.lit(baskets).cast("bigint").alias("n_baskets"), (F.col("_both") * F.lit(float(baskets)) / (F.col("a_n") * F.col("b_n"))).alias("ratio"),
    )
