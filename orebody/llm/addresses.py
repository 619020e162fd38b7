"""Addresses that denote the same location, however they are written.

Addresses are cut into components. Street names are indexed by the deletion neighbourhood of each
word and of all words joined (the word and the word with one letter left out) inside blocks of one
town and of one postcode, the latter for addresses whose town is missing or misspelt; a missing town
comes from the postcode or, where that is met once only, from neighbouring ones. Streets that meet are
compared by the cheapest assignment of their name words to each other, in any order, or by
their letters where words are joined; type and direction must agree, a missing
type may be filled in if only one street fits. Addresses whose street comes out the same are held
apart by their building number, a hard veto. Unit, suite, floor and building name are parsed away:
here they do not distinguish locations, so there is no unit veto.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.skew import all_salts, hot_buckets, salt_of
from orebody.llm.address_parse import parse_address
from orebody.session import cut, written

_FORM = ["town", "street", "kind", "direction", "postcode"]


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _cheapest(cost: np.ndarray) -> int:
    """Least sum of a one-to-one assignment of all rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        reach, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            slack = np.concatenate([[np.inf], cost[owner[at] - 1] - row_price[owner[at]] - column_price[1:]])
            closer = ~done & (slack < reach)
            reach[closer], back[closer] = slack[closer], at
            following = int(np.where(done, np.inf, reach).argmin())
            step = reach[following]
            row_price[owner[done]] += step
            column_price[done] -= step
            reach[~done] -= step
            at = following
        while at:
            owner[at], at = owner[back[at]], back[at]
    return int(sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


def assignment_cost(a: list[str], b: list[str]) -> int:
    """Cheapest one-to-one assignment of words by edits; words left over cost their length.

    Names without digits of a different number of words may be joined instead: then the edits of all
    letters count. Words with a digit must be equal.
    """
    if a == b:
        return 0
    digits = any(c.isdigit() for x in a + b for c in x)
    joined = 99 if len(a) == len(b) or digits else edits("".join(a), "".join(b))
    # equal words stay together: edits obey the triangle inequality
    short, long = sorted((list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())), key=len)
    spare = sum(map(len, long))
    if not short:
        return min(joined, spare)
    # a word left over costs its length, so an assignment costs its edits less the lengths of the words it takes
    cost = np.array([[(99 if any(c.isdigit() for c in x + y) else edits(x, y)) - len(y) for y in long] for x in short])
    return min(joined, _cheapest(cost) + spare)


def _neighbourhood(word: Column) -> Column:
    """The word and, if it has no digit and over three letters, each result of leaving out one letter."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(word.rlike("[0-9]") | (F.length(word) <= 3), F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), cuts)))


def parse_addresses(df: DataFrame, *, key: str, address: str, city: str, postcode: str) -> DataFrame:
    """(key, number, form, spelling) of the rows with a number and a street.

    `form` joins town, street, type, direction and postcode, empty where unknown, by |, which no
    component holds; `spelling` is a hash of the address as it was written.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).cast("string") for c in (address, city, postcode)]).distinct()
    rows = rows.withColumn("spelling", F.xxhash64(*rows.columns[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_address(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            keep = pa.array([bool(p.number and p.street) for p in found], pa.bool_())
            found = [p for p in found if p.number and p.street]
            forms = ["|".join(getattr(p, c) or "" for c in _FORM) for p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([p.number for p in found], pa.string()), pa.array(forms, pa.string()), batch.column(4).filter(keep)], names=["_key", "number", "form", "spelling"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, number string, form string, spelling bigint")


def _resolved_towns(forms: DataFrame, rare: int, ratio: int) -> DataFrame:
    """`forms` with misspelt towns corrected, missing ones taken from postcodes, and `sure`: the town is well known."""
    towns = cut(forms.where(F.col("town").isNotNull()).groupBy("town").agg(F.sum("n").alias("n")))
    keys = towns.select("town", "n", F.explode(_neighbourhood(F.col("town"))).alias("v"))
    apart, sorted_letters = F.levenshtein("a.town", "b.town", 2), lambda c: F.array_sort(F.split(F.col(c), ""))
    slip = (apart == 1) | ((apart == 2) & (sorted_letters("a.town") == sorted_letters("b.town")))  # the latter: neighbours swapped
    pairs = keys.alias("a").join(keys.alias("b"), "v").where((F.col("b.n") >= ratio * F.col("a.n")) & slip)
    pairs = pairs.select(F.col("a.town").alias("town"), F.col("a.n").alias("n"), F.struct(F.col("b.n"), F.col("b.town").alias("right")).alias("best"))
    known = towns.select("town", "n", F.lit(None).cast("struct<n: bigint, right: string>").alias("best")).unionByName(pairs).groupBy("town", "n").agg(F.max("best").alias("best"))
    known = known.select("town", F.coalesce("best.right", "town").alias("right"), (F.col("best").isNotNull() | (F.col("n") > rare)).alias("sure"))
    held = forms.where(F.col("town").isNotNull()).join(known, "town").withColumn("town", F.col("right")).drop("right")
    held = cut(held)
    # neighbouring postcodes: the same but for the last sign, or the last two
    near = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(k.cast("string"), F.substring("postcode", F.lit(1), F.length("postcode") - k))))
    by_code = held.where(F.col("postcode").isNotNull()).select("town", "n", near.alias("far", "code")).groupBy("code", "town").agg(F.sum("n").alias("n"))
    by_code = by_code.groupBy("code").agg(F.max_by("town", F.struct("n", "town")).alias("there"))
    missing = forms.where(F.col("town").isNull() & F.col("postcode").isNotNull())
    found = missing.select("form", near.alias("far", "code")).join(by_code, "code").groupBy("form").agg(F.min_by("there", "far").alias("there"))
    missing = missing.join(found, "form").withColumn("town", F.col("there")).drop("there").withColumn("sure", F.lit(False))
    return held.unionByName(missing)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, other = batch.column("street").to_pylist(), batch.column("t_street").to_pylist()
        yield batch.append_column("cost", pa.array([assignment_cost(a.split(), b.split()) for a, b in zip(own, other)], pa.int32()))


def _street_links(forms: DataFrame, most_edits: int, rare: int, often: int) -> DataFrame:
    """(form, place) for each form: the street that it stands for."""
    place = F.concat_ws("|", "town", F.coalesce("direction", F.lit("")), "street", F.coalesce("kind", F.lit("")))
    forms = forms.withColumn("own", place)
    full = forms.where(F.col("kind").isNotNull())
    streets = cut(full.groupBy("own", "town", "street", "kind", "direction").agg(F.sum("n").alias("s_n"), F.collect_set("postcode").alias("codes")))
    names = lambda c: F.array_distinct(F.flatten(F.transform(F.array_append(F.split(F.col(c), " "), F.replace(F.col(c), F.lit(" "), F.lit(""))), _neighbourhood)))
    block = lambda mark, c, v: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(mark), F.col(c), v))
    f = forms.join(streets.select("own", "s_n"), "own", "left").withColumn("_v", F.explode(names("street")))
    f = f.withColumn("_block", F.explode(F.array_compact(F.array(block("t", "town", F.col("_v")), F.when(~F.col("sure"), block("p", "postcode", F.col("_v"))))))).drop("_v")
    t = streets.toDF("t_own", "t_town", "t_street", "t_kind", "t_direction", "t_n", "t_codes").withColumn("_v", F.explode(names("t_street")))
    t = t.withColumn("_block", F.explode(F.concat(F.array(F.xxhash64(F.lit("t"), "t_town", "_v")), F.transform("t_codes", lambda c: F.xxhash64(F.lit("p"), c, F.col("_v")))))).drop("_v")
    same_code = F.coalesce(F.array_contains("t_codes", F.col("postcode")), F.lit(False))
    town = (F.col("t_town") == F.col("town")) | (~F.col("sure") & same_code)
    code = same_code | F.col("postcode").isNull() | (F.size("t_codes") == 0)
    kind = F.col("kind").isNull() | (F.col("kind") == F.col("t_kind"))
    letters = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    near = F.abs(letters("street") - letters("t_street")) <= most_edits  # no assignment is cheaper than the letters left over
    met = f.join(t, "_block").where(near & town & code & kind & F.col("direction").eqNullSafe(F.col("t_direction")))
    met = met.withColumn("same_code", same_code).select("form", "own", "kind", "town", "street", "n", "s_n", "t_own", "t_town", "t_street", "t_n", "same_code")
    met = met.repartition("form").dropDuplicates(["form", "t_own"])
    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in met.schema) + ", cost int"
    met = cut(met.mapInArrow(_costs, fields).where(F.col("cost") <= most_edits))

    # a street's own spelling against more frequent ones of the same type; two rounds reach the most frequent
    same = F.col("t_own") == F.col("own")
    # streets one letter apart do exist; a slip is rare, both as such and beside its street
    n = F.coalesce("s_n", "n")
    more = (F.col("t_n") > n) | ((F.col("t_n") == n) & (F.col("t_street") < F.col("street")))
    # the same words in another order, or joined, are no other street however frequent they are
    rewritten = ~same & (F.col("cost") == 0) & (F.col("t_town") == F.col("town"))
    better = same | ((rewritten | (n <= rare)) & more) | (n * often <= F.col("t_n"))
    typed = met.where(F.col("kind").isNotNull() & better).groupBy("form", "own").agg(F.max(F.struct(~same, rewritten, "same_code", "t_n", "t_street", "t_town", "t_own", "n")).alias("r"))
    typed = cut(typed.select("form", "own", F.col("r.t_own").alias("right"), F.col("r.n").alias("n")))
    hop = typed.groupBy("own").agg(F.max_by("right", F.struct("n", "right")).alias("hop")).withColumnRenamed("own", "right")

    # without a type: the one street that fits, first among equal names, then among near ones
    bare = met.where(F.col("kind").isNull()).select("form", F.col("t_own").alias("right"), "cost")
    both = typed.select("form", "right", F.lit(-1).alias("cost")).unionByName(bare).join(hop, "right", "left").select("form", F.coalesce("hop", "right").alias("right"), "cost")
    both = both.groupBy("form", "right").agg(F.min("cost").alias("cost")).groupBy("form", "cost").agg(F.count("*").alias("c"), F.first("right").alias("right"))
    best = both.groupBy("form").agg(F.min_by(F.struct("c", "right"), "cost").alias("b")).where(F.col("b.c") == 1).select("form", F.col("b.right").alias("place"))
    return forms.select("form", "own").join(best, "form", "left").select("form", F.coalesce("place", "own").alias("place"))


def same_locations(df: DataFrame, *, key: str, address: str, city: str, postcode: str, most_edits: int = 1, slip_rows: int = 2, slip_ratio: int = 50, town_rows: int = 3, town_ratio: int = 4) -> DataFrame:
    """(key, location) of every row whose address has a building number, a street and a town.

    Rows with equal `location` stand at the same number of the same street of the same town. Null,
    blank and unreadable addresses and null keys give no row; repeated rows count once; a key with
    several addresses comes out with each; other columns are not read. A town missing from both city
    and address is taken from the postcode or its neighbours; if those are unknown too, there is no row.

    Streets one letter apart exist, so a spelling is taken for a slip of a more frequent one only if
    it was written in at most `slip_rows` ways or `slip_ratio` times less often; a town is taken for a
    slip of one `town_ratio` times as frequent, and is well known beyond `town_rows`. What is counted are
    distinct ways of writing whole addresses: copies of a table or of its rows change nothing.

    Text is parsed once a row; all matching runs over distinct street spellings with their counts, so
    a building or street with a third of all rows costs no more than a rare one.
    """
    parsed = cut(parse_addresses(df, key=key, address=address, city=city, postcode=postcode))
    part = lambda k: F.nullif(F.split("form", r"\|")[k], F.lit(""))
    forms = parsed.groupBy("form", "spelling").agg(F.lit(1).alias("one")).groupBy("form").agg(F.count("*").alias("n"))
    forms = cut(forms.select("form", *[part(k).alias(c) for k, c in enumerate(_FORM)], "n"))
    links = _street_links(cut(_resolved_towns(forms, town_rows, town_ratio)), most_edits, slip_rows, slip_ratio)
    placed = parsed.select("_key", "number", "form").join(links, "form").select(F.col("_key").alias(key), F.concat_ws("|", "place", "number").alias("location"))
    return written(placed.distinct())


def location_pairs(located: DataFrame, *, key: str) -> DataFrame:
    """(key_1, key_2), key_1 < key_2, of different keys at one location: as many rows as the question asks for.

    A location with very many keys is split by one side's keys, so that no task joins all of it.
    """
    hot = hot_buckets(located, "location")
    a = located.select("location", salt_of(hot, ["location"], [key]).alias("_salt"), F.col(key).alias("key_1"))
    b = located.select("location", F.explode(all_salts(hot, ["location"])).alias("_salt"), F.col(key).alias("key_2"))
    return a.join(b, ["location", "_salt"]).where(F.col("key_1") < F.col("key_2")).select("key_1", "key_2").distinct()
