"""All similar pairs of set-valued records, by recursive chosen-path splitting.

Method (Christiani, Pagh and Sivertsen 2018, after the chosen-path tree of Christiani and Pagh
2017): each set becomes a fixed number of MinHash tokens. A tree node branches on token positions
drawn at random for the node, each with probability 1 / (threshold * positions), so that two sets
at the threshold share one branch on average; records go to the child of their own token. Small
nodes are compared pair by pair on a sketch, large ones branch again. Trees are repeated until
their number gives the wanted recall at the depth that nodes reached; every pair that passes the
sketch is verified exactly.

Equal sets are joined as one class, so a group of copies costs one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.skew import all_salts, bucket_of, hot_buckets, salt_of
from orebody.session import cut

POSITIONS = 64
_WORDS = ["_k0", "_k1", "_k2", "_k3"]


def sketch_cutoff(threshold: float, positions: int = POSITIONS, deviations: float = 5.0) -> int:
    """Least number of equal 4-bit sketch entries, `deviations` below what the threshold gives."""
    p = threshold + (1 - threshold) / 16
    return max(0, math.floor(positions * p - deviations * math.sqrt(positions * p * (1 - p))))


def tree_recall(similarity: float, threshold: float, trees: int, depth: int) -> float:
    """Probability that a pair of this similarity meets in a leaf at `depth` of any tree, were tokens drawn anew for each node."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - similarity * alive / (threshold * POSITIONS)) ** POSITIONS
    return 1 - (1 - alive) ** trees


def pair_recall(similarity: float, threshold: float, trees: int, depth: int) -> float:
    """The same for tokens drawn once for all trees: the mean over how many of them a pair has in common."""
    total = 0.0
    for same in range(POSITIONS + 1):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - (1 - min(1.0, alive / (threshold * POSITIONS))) ** same
        total += math.comb(POSITIONS, same) * similarity**same * (1 - similarity) ** (POSITIONS - same) * (1 - alive) ** trees
    return 1 - total


def trees_for(threshold: float, recall: float, depth: int) -> int:
    """Least number of trees by which a pair at the threshold is found with probability `recall` at `depth`."""
    trees = 1
    while pair_recall(threshold, threshold, trees, depth) < recall:
        trees += 1
    return trees


def _compare(threshold: float, cutoff: int):
    ones = np.uint64(0x1111111111111111)

    def pairs(node: np.ndarray, rid: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, step = np.arange(len(node)), 1
        while len(at):
            at = at[at < len(node) - step]
            at = at[node[at] == node[at + step]]
            a, b = at, at + step
            fits = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
            a, b = a[fits], b[fits]
            unequal = np.zeros(len(a), np.int64)
            for w in words:
                x = w[a] ^ w[b]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                unequal += np.bitwise_count(x & ones)
            near = (POSITIONS - unequal >= cutoff) & (rid[a] != rid[b])
            if near.any():
                a, b = rid[a[near]], rid[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["_a", "_b"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            start = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[start:] for c in cols]
            if start:
                yield from pairs(cols[0][:start], cols[1][:start], cols[2][:start], [c[:start].view(np.uint64) for c in cols[3:]])
        if rest is not None:
            yield from pairs(rest[0], rest[1], rest[2], [np.ascontiguousarray(c).view(np.uint64) for c in rest[3:]])

    return run


def _branches(path: Column, tokens: Column, threshold: float, seed: int) -> Column:
    """Paths of the children that a record goes to: positions are drawn for the node, not the record."""
    rate = int((1 << 20) / (threshold * POSITIONS))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.pmod(F.xxhash64(path, i, F.lit(seed)), F.lit(1 << 20)) < rate)
    return F.transform(drawn, lambda i: F.xxhash64(path, i, F.get(tokens, i)))


def set_records(rows: DataFrame, *, record: str, token: str, min_size: int) -> DataFrame:
    """(_s, _n, _x, _y, _sig): each record's number of distinct tokens, two fingerprints and MinHash tokens.

    One shuffle of (record, token hash); tokens of hot records are salted over several tasks first.
    """
    base = rows.where(F.col(record).isNotNull() & F.col(token).isNotNull()).select(F.col(record).alias("_s"), F.xxhash64(F.col(token).cast("string")).alias("_t"))
    hot = hot_buckets(base, "_s")
    cells = base.withColumn("_salt", salt_of(hot, ["_s"], ["_t"])).repartition("_s", "_salt").dropDuplicates(["_s", "_salt", "_t"])
    low = [F.min(F.xxhash64("_t", F.lit(i))).alias(f"_m{i}") for i in range(POSITIONS)]
    part = cells.groupBy("_s", "_salt").agg(F.count("*").alias("_n"), F.bit_xor("_t").alias("_x"), F.bit_xor(F.xxhash64("_t", F.lit(-1))).alias("_y"), *low)
    hot_set = bucket_of("_s").isin(hot) if hot else F.lit(False)
    part = part.where(hot_set | (F.col("_n") >= min_size)).select("_s", "_n", "_x", "_y", F.array(*[f"_m{i}" for i in range(POSITIONS)]).alias("_sig"))
    if hot:  # few rows of a hot record, each of fixed size; the others come alone
        lowest = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.array_min(F.transform("_sigs", lambda s: F.get(s, i))))
        part = part.groupBy("_s").agg(F.sum("_n").alias("_n"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.collect_list("_sig").alias("_sigs"))
        part = part.select("_s", "_n", "_x", "_y", lowest.alias("_sig")).where(F.col("_n") >= min_size)
    return part.withColumn("_sig", F.transform("_sig", lambda m: F.shiftright(F.xxhash64(m), 32).cast("int")))


def similar_classes(rows: DataFrame, *, record: str, token: str, threshold: float = 0.5, min_size: int = 1, trees: int = 12, leaf: int = 128, depth: int = 5, seed: int = 1, recall: float = 0.9995) -> tuple[DataFrame, DataFrame]:
    """Two tables: (record, class_id) for every record, and (class_1, class_2, n_1, n_2, n_both, jaccard) for similar classes.

    A record's set is its distinct tokens; nulls in either column and records of fewer than
    `min_size` tokens are left out; records with equal sets share a class. Pairs have Jaccard
    similarity at least `threshold`, counted exactly on 64-bit token hashes (a wrong count needs two
    of the tokens of one pair to collide). Each pair is found with probability at least `recall`:
    `trees` are grown first, and as many more as `trees_for` the deepest level that nodes needed.
    Nodes still large at `depth` are compared in blocks, so nothing is cut off.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if not 0 < recall < 0.999999:
        raise ValueError("recall must be in (0, 0.999999)")
    sets = cut(set_records(rows, record=record, token=token, min_size=min_size))
    one = F.min_by(F.struct("_s", "_sig"), "_s")
    reps = sets.groupBy("_n", "_x", "_y").agg(one.alias("_r"), F.count("*").alias("_members")).select("_n", "_x", "_y", "_members", "_r.*")
    reps = cut(reps.withColumn("_id", F.monotonically_increasing_id()))
    nibble = lambda i: F.shiftleft(F.get("_sig", F.lit(i)).bitwiseAND(F.lit(15)).cast("bigint"), 4 * (i % 16))
    words = []
    for k, name in enumerate(_WORDS):
        w = nibble(16 * k)
        for i in range(16 * k + 1, 16 * k + 16):
            w = w.bitwiseOR(nibble(i))
        words.append(w.alias(name))
    records = reps.select("_id", "_n", *words, "_sig")
    compare, small = _compare(threshold, sketch_cutoff(threshold)), ["_path", "_id", "_n", *_WORDS]
    done, grown, wanted, deepest = [], 0, trees, 0
    while grown < wanted:
        level = records.withColumn("_path", F.explode(F.sequence(F.lit(grown + 1).cast("bigint"), F.lit(wanted).cast("bigint"))))
        for d in range(1, depth + 1):
            deepest = max(deepest, d)
            level = level.select("_id", "_n", *_WORDS, "_sig", F.explode(_branches(F.col("_path"), F.col("_sig"), threshold, seed + d)).alias("_path"))
            wide = cut(level.groupBy("_path").agg(F.count("*").alias("_size")).where(F.col("_size") > leaf))
            if wide.isEmpty():
                done.append(level.select(*small))
                break
            done.append(level.join(wide, "_path", "left_anti").select(*small))
            level = level.join(wide, "_path")
            if d == depth:
                g = F.ceil(F.col("_size") / leaf).cast("int")
                own = F.pmod(F.xxhash64("_id"), g).cast("int")
                blocks = level.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), g - 1)))
                done.append(blocks.withColumn("_path", F.xxhash64("_path", F.least("_own", "_other"), F.greatest("_own", "_other"))).select(*small))
            else:
                level = cut(level.drop("_size"))
        grown, wanted = wanted, max(wanted, trees_for(threshold, recall, deepest))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    found = nodes.repartition("_path").sortWithinPartitions("_path").mapInArrow(compare, "_a bigint, _b bigint").distinct()

    name = reps.select("_id", F.col("_s"), F.col("_n"))
    found = found.join(name.toDF("_a", "s_1", "n_1"), "_a").join(name.toDF("_b", "s_2", "n_2"), "_b").select("s_1", "n_1", "s_2", "n_2")
    found = cut(found)
    wanted = found.select(F.col("s_1").alias("_s")).unionByName(found.select(F.col("s_2").alias("_s"))).distinct()
    cells = rows.where(F.col(record).isNotNull() & F.col(token).isNotNull()).select(F.col(record).alias("_s"), F.xxhash64(F.col(token).cast("string")).alias("_t"))
    cells = cut(cells.join(wanted, "_s", "left_semi").distinct())
    hot = hot_buckets(cells, "_s")  # a large record's tokens are looked up by several tasks
    mine = cells.select(F.col("_s").alias("s_1"), "_t", salt_of(hot, ["_s"], ["_t"]).alias("_salt"))
    found = found.withColumn("_salt", F.explode(all_salts(hot, ["s_1"])))
    both = found.join(mine, ["s_1", "_salt"]).join(cells.toDF("s_2", "_t"), ["s_2", "_t"]).groupBy("s_1", "n_1", "s_2", "n_2").agg(F.count("*").alias("n_both"))
    both = both.where(F.col("n_both") >= F.lit(threshold) * (F.col("n_1") + F.col("n_2") - F.col("n_both")))
    classes = both.select(F.col("s_1").alias("class_1"), F.col("s_2").alias("class_2"), "n_1", "n_2", "n_both", (F.col("n_both") / (F.col("n_1") + F.col("n_2") - F.col("n_both"))).alias("jaccard"))
    members = sets.select("_s", "_n", "_x", "_y").join(reps.select("_n", "_x", "_y", F.col("_s").alias("class_id"), F.col("_members").alias("n_members")), ["_n", "_x", "_y"])
    return members.select(F.col("_s").alias(record), "class_id", "n_members"), classes


def similar_pairs(rows: DataFrame, *, record: str, token: str, **options) -> DataFrame:
    """(record_1, record_2, jaccard), record_1 < record_2: `similar_classes` with its classes spelt out.

    The result holds every pair of equal records, so it is as long as the question makes it.
    """
    members, classes = similar_classes(rows, record=record, token=token, **options)
    members = members.withColumnRenamed(record, "_m")
    across = classes.join(members.select(F.col("class_id").alias("class_1"), F.col("_m").alias("a")), "class_1").join(members.select(F.col("class_id").alias("class_2"), F.col("_m").alias("b")), "class_2")
    several = members.where(F.col("n_members") > 1)
    within = several.select("class_id", F.col("_m").alias("a")).join(several.select("class_id", F.col("_m").alias("b")), "class_id").where(F.col("a") < F.col("b"))
    out = across.select("a", "b", "jaccard").unionByName(within.select("a", "b", F.lit(1.0).alias("jaccard")))
    return out.select(F.least("a", "b").alias("record_1"), F.greatest("a", "b").alias("record_2"), "jaccard")
